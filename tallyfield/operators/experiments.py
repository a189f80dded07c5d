"""Do match-up chains and denial plans say something about matches they have not seen? Leave-one-match-out by subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.seasons import season_of
from . import season
from .matchup import CLIP
from .scoring import replicate_weight

MODELS = ("own", "strength", "defence", "matchup")
USUAL_LEAST, CLIP_USE = 0.002, (-1.0, 3.0)  # fixed values: least usual share of a link, bounds of its relative use
FLOOR = 1e-9  # fixed value: least share in a log likelihood


def _zone_counts(counts: DataFrame, starts: DataFrame) -> DataFrame:
    shots = counts.where(F.col("out") == pitch.SHOT).select("match_id", "team_id", "opp_id", "z0", F.col("n").alias("shots"), "xg", F.lit(0).cast("long").alias("ns"))
    return shots.unionByName(starts.select("match_id", "team_id", "opp_id", "z0", F.lit(0).cast("long").alias("shots"), F.lit(0.0).alias("xg"), F.col("n").alias("ns"))).groupBy("match_id", "team_id", "opp_id", "z0").agg(*(F.sum(c).alias(c) for c in ("shots", "xg", "ns")))


def matchup_rows(counts: DataFrame, starts: DataFrame, kappa: float, least_matches: int = 10, least_possessions: int = 20) -> DataFrame:
    """For each match and attacker: xg for each possession and entries by lane, and what four models say of them that have
    not seen the match: own chain, own scaled by what the opponent concedes, the opponent's conceded chain, both together."""
    played = counts.groupBy("team_id").agg(F.countDistinct("match_id").alias("m")).where(F.col("m") >= least_matches).select("team_id")
    begun = starts.groupBy("match_id", "team_id", "opp_id").agg(F.sum("n").alias("possessions")).where(F.col("possessions") >= least_possessions)
    units = begun.join(played, "team_id", "left_semi").join(played.withColumnRenamed("team_id", "opp_id"), "opp_id", "left_semi").select("match_id", "team_id", "opp_id", "possessions")
    key = ["match_id", "team_id", "opp_id"]
    cells = season._lanes(counts.sparkSession)
    whole = counts.sparkSession.range(season.N * (season.N + 2)).selectExpr(f"cast(id div {season.N + 2} as int) as z0", f"cast(id % {season.N + 2} as int) as out")

    # Totals of each side less the match: what is left is the model's data. Missing cells of the match are zero.
    def rest(of: DataFrame, by: str | None, value: str, at: list[str]) -> DataFrame:
        group, of = by or "season", of.withColumn("season", season_of())
        total = of.groupBy(group, *at).agg(F.sum(value).alias("t"))
        here = of.groupBy("match_id", group, *at).agg(F.sum(value).alias("h"))
        grid = units.select(*key, season_of().alias("season")).crossJoin(F.broadcast(whole if "out" in at else whole.select("z0").distinct()))
        j = grid.join(total, [group, *at], "left").join(here, ["match_id", group, *at], "left")
        return j.select(*key, *at, (F.coalesce("t", F.lit(0)) - F.coalesce("h", F.lit(0))).alias(f"{value}_{by or 'league'}"))

    c = None
    for by in ("team_id", "opp_id", None):
        r = rest(counts, by, "n", ["z0", "out"])
        c = r if c is None else c.join(r, [*key, "z0", "out"])
    row = lambda col: F.sum(col).over(Window.partitionBy(*key, "z0"))
    c = c.withColumn("l", F.col("n_league") + (F.col("out") == pitch.LOSS).cast("int")).withColumn("pl", F.col("l") / row("l"))
    c = c.withColumn("pa", (F.col("n_team_id") + kappa * F.col("pl")) / (row("n_team_id") + kappa)).withColumn("pb", (F.col("n_opp_id") + kappa * F.col("pl")) / (row("n_opp_id") + kappa))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.least(F.greatest(F.col(a) / F.col(b), F.lit(CLIP[0])), F.lit(CLIP[1]))).otherwise(1.0)
    c = c.withColumn("w", F.col("pa") * ratio("pb", "pl")).withColumn("pm", F.col("w") / row("w"))
    zc, z = _zone_counts(counts, starts), None
    for by in ("team_id", "opp_id", None):
        for v in ("shots", "xg", "ns"):
            r = rest(zc, by, v, ["z0"])
            z = r if z is None else z.join(r, [*key, "z0"])
    all_of = lambda col: F.sum(col).over(Window.partitionBy(*key))
    z = z.withColumn("gl", F.coalesce(F.try_divide("xg_league", "shots_league"), F.lit(0.0))).withColumn("sl", F.coalesce(F.try_divide(F.col("ns_league"), all_of("ns_league")), F.lit(1.0 / season.N)))
    for side, by in (("a", "team_id"), ("b", "opp_id")):
        z = z.withColumn(f"g{side}", (F.col(f"xg_{by}") + season.KAPPA_XG * F.col("gl")) / (F.col(f"shots_{by}") + season.KAPPA_XG)).withColumn("w", F.col(f"ns_{by}") + kappa * F.col("sl")).withColumn(f"s{side}", F.col("w") / all_of("w"))
    z = z.withColumn("gm", F.col("ga") * ratio("gb", "gl")).withColumn("w", F.col("sa") * ratio("sb", "sl")).withColumn("sm", F.col("w") / all_of("w"))
    pick = lambda df, at, *cols: None if df is None else df.selectExpr(*key, *at, f"stack(4, {', '.join(f'{chr(39)}{m}{chr(39)}, ' + ', '.join(f'{x}{s}' for x in cols) for m, s in (('own', 'a'), ('defence', 'b'), ('matchup', 'm'), ('league', 'l')))}) as (model, {', '.join({'p': 'p', 'g': 'g', 's': 'start'}[x] for x in cols)})")
    mc, mz = pick(c, ["z0", "out"], "p"), pick(z, ["z0"], "g", "s")
    solved = season.once(season.solved(mc, mz, *key, "model"))
    threat = season.threats(solved, *key, "model").groupBy(*key).pivot("model", ["own", "defence", "matchup", "league"]).agg(F.first("threat"))
    lanes = season.entry_lanes(mc, solved, *key, "model")
    seen = counts.join(F.broadcast(cells), ["z0", "out"]).groupBy(*key, "lane").agg(F.sum("n").alias("n"))
    ll = lanes.join(seen, [*key, "lane"]).groupBy(*key, "model").agg(F.sum(F.col("n") * F.log(F.greatest("share", F.lit(FLOOR)))).alias("ll"))
    ll = ll.groupBy(*key).pivot("model", ["own", "defence", "matchup", "league"]).agg(F.first("ll")).select(*key, *(F.coalesce(m, F.lit(0.0)).alias(f"ll_{m}") for m in ("own", "defence", "matchup", "league")))
    made = counts.groupBy(*key).agg(F.sum("xg").alias("xg"))
    entries = seen.groupBy(*key).agg(F.sum("n").alias("entries"))
    out = units.join(threat, key).join(made, key, "left").join(entries, key, "left").join(ll, key, "left")
    preds = {"own": F.col("own"), "strength": F.col("own") * F.col("defence") / F.col("league"), "defence": F.col("defence"), "matchup": F.col("matchup")}
    return out.select(*key, "possessions", (F.coalesce("xg", F.lit(0.0)) / F.col("possessions")).alias("y"), F.coalesce("entries", F.lit(0)).alias("entries"), *(v.alias(f"pred_{k}") for k, v in preds.items()), *(F.coalesce(f"ll_{m}", F.lit(0.0)).alias(f"ll_{m}") for m in ("league", "own", "defence", "matchup")))


def crossfit(rows: DataFrame, pred: str | None) -> Column:
    """y as a line of a prediction, weighted by possessions, fitted on the matches of one parity and read on the other's;
    without prediction, their mean. For use on rows with `half`."""
    other = Window.partitionBy(F.lit(1))
    part = lambda e, k: F.sum(F.when(F.col("half") == k, e)).over(other)
    w, y = F.col("possessions"), F.col("y")
    out = None
    for k in (0, 1):
        sw, sy = part(w, k), part(w * y, k)
        if pred is None:
            line = F.try_divide(sy, sw)
        else:
            x = F.col(pred)
            sx, sxx, sxy = part(w * x, k), part(w * x * x, k), part(w * x * y, k)
            slope = F.coalesce(F.try_divide(sw * sxy - sx * sy, sw * sxx - sx * sx), F.lit(0.0))
            line = F.try_divide(sy - slope * sx, sw) + slope * x
        out = F.when(F.col("half") != k, line) if out is None else out.when(F.col("half") != k, line)
    return out


def matchup_summary(rows: DataFrame, reps: int = 200) -> DataFrame:
    """Skill and correlation of each model's threat, its log likelihood for each entry, and intervals of the gaps that matter."""
    r = rows.withColumn("half", (F.col("match_id") % 2).cast("int"))
    for m in (None, *MODELS):
        r = r.withColumn(f"e_{m or 'const'}", F.pow(F.col("y") - crossfit(r, m and f"pred_{m}"), 2) * F.col("possessions"))
    sums = ["e_const", *(f"e_{m}" for m in MODELS), "ll_league", "ll_own", "ll_defence", "ll_matchup", "entries"]
    m = r.groupBy("match_id").agg(F.count("*").alias("units"), *(F.sum(c).alias(c) for c in sums))
    d = m.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(replicate_weight("match_id", "rep")))
    g = d.groupBy("rep").agg(F.sum(F.expr("case when rep = 0 then units end")).alias("units"), *(F.sum(F.col("w") * F.col(c)).alias(c) for c in sums))
    over = lambda a, b, by: F.try_divide(F.col(a) - F.col(b), F.col(by))
    gaps = {"threat_matchup_vs_strength": over("e_strength", "e_matchup", "e_const"), "threat_matchup_vs_own": over("e_own", "e_matchup", "e_const"), "lane_own_vs_league": over("ll_own", "ll_league", "entries"), "lane_matchup_vs_own": over("ll_matchup", "ll_own", "entries")}
    skills = {f"skill_{k}": 1 - F.try_divide(f"e_{k}", "e_const") for k in MODELS} | {f"lane_{k}": F.try_divide(f"ll_{k}", "entries") for k in ("league", "own", "defence", "matchup")}
    one = g.select("rep", "units", *(c.alias(k) for k, c in (gaps | skills).items()))
    end = lambda k, q: F.round(F.percentile(F.when(F.col("rep") > 0, F.col(k)), F.lit(q)), 6)
    corr = rows.agg(*(F.round(F.try_divide(F.covar_pop("y", f"pred_{k}"), F.stddev_pop("y") * F.stddev_pop(f"pred_{k}")), 6).alias(f"corr_{k}") for k in MODELS))
    out = one.agg(F.max("units").alias("units"), *(F.round(F.max(F.when(F.col("rep") == 0, F.col(k))), 6).alias(k) for k in skills), *(x for k in gaps for x in (end(k, 0.05).alias(f"{k}_lo"), end(k, 0.95).alias(f"{k}_hi"))))
    return out.crossJoin(F.broadcast(corr))


def link_use(counts: DataFrame) -> DataFrame:
    """For each match and attacker, and each link between different regions that the attacker ever used: n, all moves of the match, and
    usual, the link's share in the attacker's other matches."""
    region = lambda z: f"(case when floor({z} / 5) < 2 then 0 when floor({z} / 5) < 4 then 1 else 2 end * 5 + {z} % 5)"
    key = ["match_id", "team_id", "opp_id"]
    m = counts.where(F.col("out") < season.N).groupBy(*key, F.expr(region("z0")).cast("int").alias("r0"), F.expr(region("out")).cast("int").alias("r1")).agg(F.sum("n").alias("n"))
    total = m.groupBy(*key).agg(F.sum("n").alias("all"))
    own = Window.partitionBy("team_id")
    total = total.withColumn("rest", F.sum("all").over(own) - F.col("all"))
    links = m.where("r0 <> r1").withColumn("of_link", F.sum("n").over(Window.partitionBy("team_id", "r0", "r1")))
    every = links.select("team_id", "r0", "r1", "of_link").distinct()
    j = total.join(every, "team_id").join(links.select(*key, "r0", "r1", "n"), [*key, "r0", "r1"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumn("usual", F.try_divide((F.col("of_link") - F.col("n")).cast("double"), F.col("rest").cast("double")))


def link_rows(counts: DataFrame, least_possessions: int = 20, starts: DataFrame | None = None) -> DataFrame:
    """For each match, attacker and link between regions: y, xg over what both sides' other matches let expect, less 1, and u,
    how much more than usual the link was used."""
    key = ["match_id", "team_id", "opp_id"]
    j = link_use(counts).where(F.col("usual") >= USUAL_LEAST)
    u = F.least(F.greatest(F.col("n") / F.col("all") / F.col("usual") - 1, F.lit(CLIP_USE[0])), F.lit(CLIP_USE[1]))
    return j.join(outcome_rows(counts, starts, least_possessions), key).select(*key, "r0", "r1", F.round("y", 6).alias("y"), F.round(u, 6).alias("u"))


def outcome_rows(counts: DataFrame, starts: DataFrame, least_possessions: int = 20) -> DataFrame:
    """match_id, team_id, opp_id, y: xg of a possession over what both sides' other matches let expect, less 1."""
    key = ["match_id", "team_id", "opp_id"]
    xg = counts.groupBy(*key).agg(F.sum("xg").alias("xg")).join(starts.groupBy(*key).agg(F.sum("n").alias("p")), key).where(F.col("p") >= least_possessions)
    loo = lambda by: F.try_divide(F.sum("xg").over(Window.partitionBy(*by)) - F.col("xg"), (F.sum("p").over(Window.partitionBy(*by)) - F.col("p")).cast("double"))
    xg = xg.withColumn("season", season_of())
    every = xg.groupBy("season").agg(F.sum("xg").alias("all_xg"), F.sum("p").alias("all_p"))
    of = lambda c: F.sum(c).over(Window.partitionBy("match_id"))
    xg = xg.join(every, "season").withColumn("made", loo(["team_id"])).withColumn("allowed", loo(["opp_id"])).withColumn("league", F.try_divide(F.col("all_xg") - of("xg"), (F.col("all_p") - of("p")).cast("double")))
    return xg.withColumn("y", F.try_divide(F.col("xg") / F.col("p"), F.col("made") * F.try_divide("allowed", "league")) - 1).where("y is not null").select(*key, "y")


def link_slopes(rows: DataFrame) -> DataFrame:
    """By link: slope of y on u, each alone, and the number of matches."""
    g = rows.groupBy("r0", "r1").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("y", "u"), F.var_pop("u")).alias("slope"))
    return g.select("r0", "r1", "n", F.round("slope", 6).alias("slope"))


def spearman(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """Correlation of ordinal ranks; ties are not averaged but go by `tie`."""
    w = lambda c: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(c, tie))
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("ra", w(a)).withColumn("rb", w(b))
    return r.agg(F.count("*").alias("n"), F.round(F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")), 6).alias("rho"))


def denial_agreement(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Do links whose denial should cost most also go with most xg when used more? Rank agreement of slopes with mean drops."""
    drop = plan.where("side = 'attack' and region_from >= 0").groupBy(F.col("region_from").alias("r0"), F.col("region_to").alias("r1")).agg(F.avg((F.col("drop_adapting") + F.col("drop_losing")) / 2).alias("drop"))
    j = link_slopes(rows).join(drop, ["r0", "r1"]).withColumn("link", F.format_string("%02d-%02d", "r0", "r1"))
    return spearman(j, "slope", "drop", "link")
