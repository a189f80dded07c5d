"""24 features of each team-match, what was known of them before each match, and how well that calls them.

Features are kept long: (match_id, match_date, team_id, opp_id, feature, v), v null where its denominator is empty.
Everything after the table is windows by feature over a few rows for each team-match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.seasons import season_of
from .matchup import _middle, graph_measures, middle_crossing
from .replay import earlier
from .scoring import PSEUDO, TIER_LEAD, TIER_USABLE, replicate_weight

N = pitch.ZONES
ENTRY = ("left_flank", "left_halfspace", "centre", "right_halfspace", "right_flank")
# Features as sum(num) / sum(den) over the cells (z0, out, n, xg) and starts of a team-match.
_final, _lane = "x0 >= 80", "(z0 % 5)"
PLAIN = (
    ("final_third_share", f"case when {_final} then n else 0 end", "n"), ("left_right_balance", f"case when {_lane} <= 1 then n when {_lane} >= 3 then -n else 0 end", "n"),
    ("width_final_third", f"case when {_final} and {_lane} in (0, 4) then n else 0 end", f"case when {_final} then n else 0 end"),
    ("directness", "case when move then n * dx else 0 end", "case when move then n else 0 end"), ("long_forward_share", "case when move and dx >= 40 then n else 0 end", "case when move then n else 0 end"),
    ("switch_share", f"case when move and abs((out % 5) - {_lane}) >= 2 then n else 0 end", "case when move then n else 0 end"), ("turnover_rate", "case when loss then n else 0 end", "n"),
    ("own_third_turnover_share", "case when loss and x0 < 40 then n else 0 end", "case when loss then n else 0 end"), ("xg_per_shot", "case when shot then xg else 0 end", "case when shot then n else 0 end"),
    ("lever_share", "case when move and r0 in (11, 13) and r1 = 12 then n else 0 end", "case when move then n else 0 end"),
)
PER_START = (("shots_per_possession", "case when shot then n else 0 end"), ("xg_per_possession", "case when shot then xg else 0 end"), ("central_entries_per_possession", "case when move and r1 = 12 and r0 <> 12 then n else 0 end"))
FEATURES = tuple(f"entry_{k}" for k in ENTRY) + tuple(k for k, _, _ in PLAIN) + tuple(k for k, _ in PER_START) + ("start_height", "possession", "entropy_rate", "spectral_gap", "reciprocity", "hodge_circulation")
SOLVED_FEATURES = ("spectral_gap", "hodge_circulation")  # these need an eigenvalue or least squares
SQL_FEATURES = tuple(f for f in FEATURES if f not in SOLVED_FEATURES)
REGION = "(case when floor({z} / 5) < 2 then 0 when floor({z} / 5) < 4 then 1 else 2 end * 5 + {z} % 5)"
KEYS = ["match_id", "team_id", "opp_id"]
# Rules (name, who, feature, direction) with the league as reference, for set pieces, and against a normal week
# of the team. Their order breaks ties.
RULES = (
    ("without_ball", "we", "possession", -1), ("with_ball", "we", "possession", 1), ("press_high", "they", "own_third_turnover_share", 1), ("hold_block", "they", "own_third_turnover_share", -1),
    ("beat_press", "we", "own_third_turnover_share", 1), ("protect_centre", "they", "central_entries_per_possession", 1), ("long_balls", "they", "long_forward_share", 1),
    ("centre_open", "we", "central_entries_per_possession", 1), ("centre_shut", "we", "central_entries_per_possession", -1), ("high_regain", "they", "start_height", 1), ("patterned", "they", "entropy_rate", -1),
)
SETPIECE_RULES = (("defend_corners", "they", "corners", 1), ("win_corners", "we", "corners", 1), ("defend_set_pieces", "they", "sp_shots", 1), ("attack_set_pieces", "we", "sp_shots", 1))
GAME_RULES = (
    ("less_ball", "we", "possession", -1), ("more_ball", "we", "possession", 1), ("pressed_deep", "we", "own_third_turnover_share", 1), ("sloppier", "we", "turnover_rate", 1),
    ("centre_tighter", "we", "central_entries_per_possession", -1), ("centre_looser", "we", "central_entries_per_possession", 1), ("fewer_shots", "we", "shots_per_possession", -1), ("more_shots", "we", "shots_per_possession", 1),
    ("forced_long", "we", "long_forward_share", 1), ("pinned_back", "we", "start_height", -1), ("win_more_corners", "we", "corners", 1), ("press_them", "they", "own_third_turnover_share", 1),
    ("leave_them", "they", "own_third_turnover_share", -1), ("they_go_long", "they", "long_forward_share", 1), ("they_come_central", "they", "central_entries_per_possession", 1), ("they_regain_high", "they", "start_height", 1),
    ("they_are_readable", "they", "entropy_rate", -1), ("more_corners_against", "they", "corners", 1),
)
SETPIECE_FEATURES = ("corners", "att_free_kicks", "sp_shots", "sp_xg", "sp_xg_share", "shots_per_corner")
#: Rules of a game that say what to do: the feature that shows whether it was done, by whom, and which way. The outcome is xg less xg
#: conceded for 90 minutes. All are measured while the score is level.
ACTIONS = (("press_them", "press", "we", 1), ("leave_them", "press", "we", -1), ("pressed_deep", "long", "we", 1), ("centre_tighter", "width", "we", 1), ("they_come_central", "lever", "they", -1))
LEVEL_FEATURES, OUTCOME = ("press", "long", "width", "lever", "xg_difference_90"), "xg_difference_90"
THRESHOLD = {"league": 0.5, "usual": 0.4}


def with_geometry(counts: DataFrame) -> DataFrame:
    """Cells with what their zones say: kind of outcome, middles, regions, lane of an entry."""
    out, move = "least(out, 29)", f"out < {N}"
    c = counts.withColumn("move", F.expr(move)).withColumn("shot", F.col("out") == pitch.SHOT).withColumn("loss", F.col("out") == pitch.LOSS)
    c = c.withColumn("x0", F.expr(_middle("z0", "x"))).withColumn("x1", F.expr(_middle(out, "x"))).withColumn("dx", F.col("x1") - F.col("x0"))
    c = c.withColumn("r0", F.expr(REGION.format(z="z0"))).withColumn("r1", F.expr(REGION.format(z=out)))
    enters = F.expr(f"{move} and x0 < 80 and x1 >= 80")
    return c.withColumn("entry", F.when(enters, F.expr(pitch.lane(middle_crossing("z0", out, 80)))))


def _over(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def season_table(counts: DataFrame, starts: DataFrame, least_matches: int = 10, least_possessions: int = 20) -> DataFrame:
    """One row for each team-match with all features, of teams with enough matches and matches with enough possessions."""
    c = with_geometry(counts)
    total = lambda e: F.sum(F.expr(e))
    entries = F.sum(F.when(F.col("entry").isNotNull(), F.col("n")))
    one = c.groupBy(*KEYS).agg(
        *(_over(F.sum(F.when(F.col("entry") == k, F.col("n")).otherwise(0)), entries).alias(f"entry_{name}") for k, name in enumerate(ENTRY)),
        *(_over(total(n), total(d)).alias(k) for k, n, d in PLAIN), *(total(n).alias(f"n_{k}") for k, n in PER_START), total("case when move then n else 0 end").alias("moves"),
    )
    s = starts.groupBy(*KEYS).agg(F.sum("n").alias("starts"), _over(F.sum(F.col("n") * F.expr(_middle("z0", "x"))), F.sum("n")).alias("start_height"))
    other = one.select("match_id", F.col("team_id").alias("opp_id"), F.col("moves").alias("opp_moves"))
    one = one.join(s, KEYS).where(F.col("starts") >= least_possessions).join(other, ["match_id", "opp_id"], "left").withColumn("possession", _over(F.col("moves"), F.col("moves") + F.coalesce("opp_moves", F.lit(0))))
    one = one.select(*KEYS, *(k for k in FEATURES if k in one.columns), *(_over(F.col(f"n_{k}"), F.col("starts")).alias(k) for k, _ in PER_START))
    played = counts.groupBy("team_id").agg(F.countDistinct("match_id").alias("m")).where(F.col("m") >= least_matches).select("team_id")
    one = one.join(F.broadcast(played), "team_id", "left_semi").join(F.broadcast(played.withColumnRenamed("team_id", "opp_id")), "opp_id", "left_semi")
    return one.join(graph_features(c.where("move")), ["match_id", "team_id"], "left").select(*KEYS, *FEATURES)


def graph_features(moves: DataFrame) -> DataFrame:
    """Entropy, reciprocity, spectral gap and circulation of each team-match's moves between regions."""
    r = moves.groupBy("match_id", "team_id", "r0", "r1").agg(F.sum("n").alias("n"))
    unit = ["match_id", "team_id"]
    row, t = F.sum("n").over(Window.partitionBy(*unit, "r0")), F.sum("n").over(Window.partitionBy(*unit))
    entropy = r.withColumn("row", row).withColumn("t", t).groupBy(*unit).agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("row")))).alias("entropy_rate"))
    g = r.where("r0 <> r1").groupBy(*unit, F.least("r0", "r1").alias("a"), F.greatest("r0", "r1").alias("b"))
    g = g.agg(F.sum("n").alias("gross"), F.abs(F.sum(F.when(F.col("r0") < F.col("r1"), F.col("n")).otherwise(-F.col("n")))).alias("net"))
    back = g.groupBy(*unit).agg((1 - _over(F.sum("net"), F.sum("gross"))).alias("reciprocity"))
    known = F.when(~F.isnan("circulation"), F.col("circulation"))  # undefined without net flow
    solved = graph_measures(r, unit).withColumn("hodge_circulation", known).drop("circulation")
    return entropy.join(back, unit, "left").join(solved, unit, "left")


def long_form(table: DataFrame, dates: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """match_id, match_date, team_id, opp_id, feature, v."""
    rows = ", ".join(f"'{k}', cast({k} as double)" for k in features)
    return table.join(dates.select("match_id", "match_date").distinct(), "match_id").selectExpr("match_id", "match_date", "team_id", "opp_id", f"stack({len(features)}, {rows}) as (feature, v)")


def setpiece_form(pieces: DataFrame, dates: DataFrame) -> DataFrame:
    """Set-piece figures (stats.setpieces) in the long form, for matches in which both sides have some."""
    other = pieces.select("match_id", F.col("team_id").alias("opp_id"))
    both = pieces.join(other, "match_id").where("team_id <> opp_id")
    return long_form(both, dates, SETPIECE_FEATURES)


def asof(long: DataFrame, pseudo: float | DataFrame = PSEUDO, least_prior: int = 5, start_fraction: float = 0.5) -> DataFrame:
    """What was known before each match, by strictly earlier dates: league mean and deviation, the team's own mean and what
    its opponents' opponents did, both shrunk by `pseudo` matches, the call of both, and whether the row is scored:
    later part of the team's fixtures with enough matches before. pseudo is a number, or the table of `pseudo_asof`."""
    d = long.withColumn("day", F.datediff("match_date", F.lit("2000-01-01").cast("date")))
    past = lambda *by: Window.partitionBy(*by).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    # Sums by day first: the league's running window then has one row for each feature and day. Squares are of departures from
    # a middle value of the feature, so that no digits are lost where it is far from 0.
    d = d.withColumn("season", season_of())
    middle = d.groupBy("season", "feature").agg(F.avg("v").alias("middle"))
    off = F.col("v") - F.col("middle")
    day = d.join(middle, ["season", "feature"]).groupBy("season", "feature", "day", "middle").agg(F.count("v").alias("n"), F.sum(off).alias("s"), F.sum(off * off).alias("q"))
    n, s, q = (F.sum(c).over(past("season", "feature")) for c in "nsq")
    day = day.select("season", "feature", "day", (F.col("middle") + _over(s, n)).alias("league"), F.sqrt(F.greatest(_over(q, n) - F.pow(_over(s, n), 2), F.lit(0.0))).alias("league_sd"))
    d = d.join(day, ["season", "feature", "day"])
    k_own = k_opp = F.lit(pseudo) if not isinstance(pseudo, DataFrame) else None
    if k_own is None:
        d = d.join(pseudo, ["season", "feature", "match_date"], "left")
        k_own, k_opp = F.col("k_own"), F.col("k_opp")
    mean = lambda side, k: (F.coalesce(F.sum("v").over(past("feature", side)), F.lit(0.0)) + k * F.col("league")) / (F.count("v").over(past("feature", side)) + k)
    place = Window.partitionBy("feature", "team_id")
    d = d.withColumn("own", mean("team_id", k_own)).withColumn("against", mean("opp_id", k_opp)).withColumn("n_prior", F.count("*").over(past("feature", "team_id")))
    later = F.row_number().over(place.orderBy("match_date", "match_id")) - 1 >= F.floor(F.count("*").over(place) * start_fraction)
    d = d.withColumn("scored", later & (F.col("n_prior") >= least_prior))
    return d.select("match_id", "team_id", "opp_id", "feature", F.col("v").alias("actual"), "league", "league_sd", "own", (F.col("own") + F.col("against") - F.col("league")).alias("call"), "n_prior", "scored")


def pseudo_asof(long: DataFrame, lo: float = 1.0, hi: float = 30.0) -> DataFrame:
    """season, feature, match_date, k_own, k_opp: pseudo matches that the data before each date ask for, by team and by opponent, as
    `pseudo_matches` has them over all. Numbers, sums and squares of each group run over the dates; no match meets another."""
    keys = ["season", "feature"]
    long, off = long.withColumn("season", season_of()), F.col("v") - F.col("middle")
    v = long.where("v is not null").join(long.groupBy(*keys).agg(F.avg("v").alias("middle")), keys)
    out = dates = long.select(*keys, "match_date").distinct()
    for side, name in (("team_id", "k_own"), ("opp_id", "k_opp")):
        rows = v.select(*keys, "match_date", F.col(side).alias("side"), F.lit(1).cast("long").alias("n"), off.alias("s"), (off * off).alias("q"))
        g = earlier(rows, dates, keys, ["side"], ["n", "s", "q"]).where("n >= 2")
        f = g.groupBy(*keys, "match_date").agg(F.count("*").alias("groups"), _over(F.sum(F.expr("q - s * s / n")), F.sum(F.col("n") - 1)).alias("within"), F.var_samp(F.col("s") / F.col("n")).alias("between"), F.avg(1 / F.col("n")).alias("noise"))
        tau = F.col("between") - F.col("within") * F.col("noise")
        k = F.when((F.col("groups") >= 3) & (tau > 0) & (F.col("within") > 0), F.least(F.greatest(F.col("within") / tau, F.lit(lo)), F.lit(hi))).otherwise(hi)
        out = out.join(f.select(*keys, "match_date", k.alias(name)), [*keys, "match_date"], "left")
    return out.fillna(hi, ["k_own", "k_opp"])


def pseudo_matches(long: DataFrame, lo: float = 1.0, hi: float = 30.0) -> DataFrame:
    """feature, k: pseudo matches that the data ask for, variance within teams over variance between their true levels,
    the latter being that of team means less what noise gives. `hi` where there is no real spread or under three teams."""
    g = long.groupBy("feature", "team_id").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2")).where("n >= 2")
    f = g.groupBy("feature").agg(F.count("*").alias("teams"), _over(F.sum(F.col("s2") * (F.col("n") - 1)), F.sum(F.col("n") - 1)).alias("within"), F.var_samp("m").alias("between"), F.avg(1 / F.col("n")).alias("noise"))
    tau = F.col("between") - F.col("within") * F.col("noise")
    k = F.when((F.col("teams") >= 3) & (tau > 0) & (F.col("within") > 0), F.least(F.greatest(F.col("within") / tau, F.lit(lo)), F.lit(hi))).otherwise(hi)
    return long.select("feature").distinct().join(f, "feature", "left").select("feature", F.coalesce(k, F.lit(hi)).alias("k"))


def loo(long: DataFrame) -> DataFrame:
    """League, team, and team with opponent means of every feature without the match itself, shrunk by pseudo matches."""
    of = lambda *by: Window.partitionBy("season", "feature", *by)
    long, v = long.withColumn("season", season_of()), F.col("v")
    rest = lambda c, w, own: F.coalesce(c.over(w), F.lit(0.0)) - own
    got = F.when(v.isNotNull(), 1).otherwise(0)
    d = long.withColumn("league", _over(rest(F.sum("v"), of(), 0) - F.coalesce(F.sum("v").over(of("match_id")), F.lit(0.0)), F.greatest(F.count("v").over(of()) - F.count("v").over(of("match_id")), F.lit(1))))
    shrunk = lambda side: (rest(F.sum("v"), of(side), F.coalesce(v, F.lit(0.0))) + PSEUDO * F.col("league")) / (F.count("v").over(of(side)) - got + PSEUDO)
    d = d.withColumn("team", shrunk("team_id")).withColumn("against", shrunk("opp_id"))
    return d.select("match_id", "team_id", "feature", v.alias("actual"), "league", "team", (F.col("team") + F.col("against") - F.col("league")).alias("both"))


def _drawn(errors: DataFrame, reps: int) -> DataFrame:
    """Sums by match, each with its weight in every replicate; replicate 0 has all matches once."""
    d = errors.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    return d.withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(replicate_weight("match_id", "rep")))


def _interval(c: str, *, at: str = "rep > 0") -> list[Column]:
    """Value and 5-95 % interval of a column over replicates."""
    drawn = F.expr(f"case when {at} then {c} end")
    return [F.max(F.expr(f"case when rep = 0 then {c} end")).alias(c), F.percentile(drawn, F.lit(0.05)).alias(f"{c}_lo"), F.percentile(drawn, F.lit(0.95)).alias(f"{c}_hi")]


def _scores(parts: DataFrame, preds: tuple[str, ...], reps: int) -> DataFrame:
    """By feature and replicate: sums of squared errors of the league mean (l) and of each prediction."""
    sse = lambda c: F.sum(F.pow(F.col("actual") - F.col(c), 2))
    m = parts.where("actual is not null and league is not null").groupBy("feature", "match_id").agg(F.count("*").alias("n"), *(sse(c).alias(c) for c in ("league", *preds)))
    return _drawn(m, reps).groupBy("feature", "rep").agg(F.sum(F.expr("case when rep = 0 then n end")).alias("n"), *(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("league", *preds)))


def audit(parts: DataFrame, reps: int = 100) -> DataFrame:
    """By feature: how much of the spread a team's other matches explain, what its opponent adds, intervals by resampling
    matches, and the tier."""
    s = _scores(parts, ("team", "both"), reps).withColumn("r2_team", 1 - _over(F.col("team"), F.col("league"))).withColumn("gain_opponent", _over(F.col("team") - F.col("both"), F.col("league")))
    g = s.groupBy("feature").agg(F.max("n").alias("n"), *_interval("r2_team"), *_interval("gain_opponent"))
    tier = F.when((F.col("r2_team") >= TIER_LEAD) & (F.col("r2_team_lo") > 0), "lead").when((F.col("r2_team") >= TIER_USABLE) & (F.col("r2_team_lo") > 0), "usable").otherwise("drop")
    r = [c for c in g.columns if c not in ("feature", "n")]
    return g.select("feature", "n", *(F.round(c, 6).alias(c) for c in r), tier.alias("tier"), (F.col("gain_opponent_lo") > 0).alias("opponent_matters"))


def skills(calls: DataFrame, reps: int = 100) -> DataFrame:
    """By feature: skill of as-of calls over the league mean, of the team alone, intervals, share of calls that are closer."""
    c = calls.where("scored and actual is not null and call is not null")
    s = _scores(c, ("call", "own"), reps).withColumn("skill", 1 - _over(F.col("call"), F.col("league"))).withColumn("opponent_adds", _over(F.col("own") - F.col("call"), F.col("league")))
    g = s.groupBy("feature").agg(F.max("n").alias("n"), *_interval("skill"), *_interval("opponent_adds"))
    near = c.groupBy("feature").agg(F.avg((F.abs(F.col("actual") - F.col("call")) < F.abs(F.col("actual") - F.col("league"))).cast("double")).alias("closer"))
    r = [x for x in g.columns if x not in ("feature", "n")]
    return g.join(near, "feature").select("feature", "n", *(F.round(x, 6).alias(x) for x in r), F.round("closer", 6).alias("closer"), (F.col("skill_lo") > 0).alias("holds"))


def team_shares(calls: DataFrame, least_games: int = 8) -> DataFrame:
    """Share of a team's scored calls, over all features, that are closer than the league mean."""
    c = calls.where("scored")
    ok = F.expr("actual is not null and call is not null")
    near = F.abs(F.col("actual") - F.col("call")) < F.abs(F.col("actual") - F.col("league"))
    g = c.groupBy("team_id").agg(F.countDistinct("match_id").alias("games"), F.avg(F.when(ok, near.cast("double"))).alias("closer")).where(F.col("games") >= least_games)
    return g.select("team_id", "games", F.round("closer", 6).alias("closer"))


def rule_rows(calls: DataFrame, rules=RULES, reference: str = "league", known: str = "actual is not null") -> DataFrame:
    """For every scored unit and rule: departure of the call in deviations of the league, whether the rule fires, and
    whether its situation then occurred. "they" reads the opponent's row of the same match."""
    table = calls.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rules)], "rule string, who string, feature string, direction int, position int")  # a few dozen rows
    us = calls.select("match_id", "team_id", "opp_id", "feature", "scored")
    src = calls.select("match_id", F.col("team_id").alias("src"), "feature", "actual", "league", "league_sd", "own", "call")
    u = us.where("scored").join(F.broadcast(table), "feature").withColumn("src", F.when(F.col("who") == "we", F.col("team_id")).otherwise(F.col("opp_id")))
    u = u.join(src, ["match_id", "src", "feature"]).where(f"call is not null and league_sd > 0 and {known}")
    usual = F.when(F.col("who") == "we", F.col("own")).otherwise(F.col("call") - F.col("own") + F.col("league"))
    u = u.withColumn("ref", usual if reference == "usual" else F.col("league"))
    u = u.withColumn("departure", F.col("direction") * (F.col("call") - F.col("ref")) / F.col("league_sd")).withColumn("fired", F.col("departure") >= THRESHOLD[reference])
    return u.select("match_id", "team_id", "opp_id", "rule", "position", "departure", "fired", (F.col("direction") * (F.col("actual") - F.col("ref")) > 0).alias("held"), "feature", "call", "ref")


def premises(rows: DataFrame, reps: int = 100, least_fires: int = 100, share: float = 0.60) -> DataFrame:
    """By rule: how often it fires, how often its situation then occurred, with intervals by resampling matches."""
    m = rows.groupBy("rule", "match_id").agg(F.count("*").alias("units"), F.sum(F.col("fired").cast("int")).alias("fires"), F.sum((F.col("fired") & F.col("held")).cast("int")).alias("hits"), F.sum((~F.col("fired") & F.col("held")).cast("int")).alias("quiet"))
    s = _drawn(m, reps).groupBy("rule", "rep").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("units", "fires", "hits", "quiet"))).withColumn("held_share", _over(F.col("hits"), F.col("fires")))
    first = lambda e: F.max(F.expr(f"case when rep = 0 then {e} end"))
    g = s.groupBy("rule").agg(first("fires").alias("fires"), first("units").alias("units"), first("quiet").alias("quiet"), *_interval("held_share"))
    holds = F.coalesce((F.col("fires") >= least_fires) & (F.col("held_share") >= share) & (F.col("held_share_lo") > 0.5), F.lit(False))
    return g.select("rule", "fires", F.round(_over(F.col("fires"), F.col("units")), 6).alias("fire_rate"), *(F.round(c, 6).alias(c) for c in ("held_share", "held_share_lo", "held_share_hi")),
        F.round(_over(F.col("quiet"), F.col("units") - F.col("fires")), 6).alias("not_fired_share"), holds.alias("holds"))


def instructions(rows: DataFrame, k: int = 4) -> DataFrame:
    """The k fired rules of each unit that depart most."""
    place = F.row_number().over(Window.partitionBy("match_id", "team_id").orderBy(F.desc(F.round("departure", 9)), "position"))
    return rows.where("fired").withColumn("place", place).where(F.col("place") <= k).select("match_id", "team_id", "opp_id", "rule", "place", F.round("departure", 6).alias("departure"), "held", "feature", "call", "ref")


#: What each rule of a game says, by call, normal week and the players whom `plan_players` names for the roles.
TEXTS = {
    "less_ball": "Less of the ball than usual is likely: {call} against {ref}. Be patient without it and quick once it is won.", "more_ball": "More of the ball than usual is likely: {call} against {ref}. Expect a set defence.",
    "pressed_deep": "{call} of our losses are likely in our own third, {ref} as a rule. Take no risks in front of our goal.", "sloppier": "More losses than usual are likely: {call} of actions against {ref}. Cover behind the ball.",
    "centre_tighter": "Fewer ways through the middle than usual: {call} entries a possession against {ref}. Use the sides.", "centre_looser": "More room in the middle than usual: {call} entries a possession against {ref}. Carriers: {our_carriers}.",
    "fewer_shots": "Fewer shots than usual: {call} a possession against {ref}. Make each one good.", "more_shots": "More shots than usual: {call} a possession against {ref}.",
    "forced_long": "More long moves than usual: {call} against {ref}. Settle who takes the first ball and who the second.", "pinned_back": "Possessions are likely to begin deeper than usual: at {call} against {ref}.",
    "win_more_corners": "More corners than usual: {call} against {ref}. Takers: {our_takers}. Targets: {our_shooters}.", "press_them": "They lose it in their own third more than most we meet: {call} against {ref}. Press {their_giveaways}; {our_pressers} lead.",
    "leave_them": "They lose it in their own third less than most we meet: {call} against {ref}. High pressing pays less.", "they_go_long": "They play longer than most we meet: {call} of moves against {ref}. Under the ball: {our_defenders}.",
    "they_come_central": "They enter the middle more than most we meet: {call} a possession against {ref}. From {their_passers} to {their_receivers}; {our_defenders} stand there.",
    "they_regain_high": "Their possessions begin higher than those of most we meet: at {call} against {ref}. Play the first pass past them.", "they_are_readable": "Their next move is easier to tell than most: {call} bits against {ref}.",
    "more_corners_against": "More corners to defend than usual: {call} against {ref}. Takers: {their_takers}. Shooters: {their_shooters}.",
}
SHARES = ("possession", "own_third_turnover_share", "turnover_rate", "long_forward_share")  # shown in percent


def instruction_texts(found: DataFrame, leaders: DataFrame) -> DataFrame:
    """The instructions of each unit (match_id, team_id, opp_id, rule, feature, place, departure, held, call, ref) as sentences. leaders: match_id, team_id, who, role,
    place, player_id."""
    listed = leaders.groupBy("match_id", "team_id", F.concat_ws("_", "who", "role").alias("role")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "player_id"))), lambda r: r["player_id"].cast("string")), ", ").alias("names"))
    names = listed.groupBy("match_id", "team_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "names"))).alias("named"))  # ten roles at most
    shown = lambda c: F.when(F.col("feature").isin(*SHARES), F.concat(F.format_number(F.col(c) * 100, 0), F.lit("%"))).otherwise(F.format_number(c, 2))
    text = F.create_map(*(F.lit(x) for kv in TEXTS.items() for x in kv))[F.col("rule")]
    j = found.join(names, ["match_id", "team_id"], "left").withColumn("text", text)
    for key, value in (("call", shown("call")), ("ref", shown("ref"))):
        j = j.withColumn("text", F.replace("text", F.lit(f"{{{key}}}"), value))
    for role in sorted({r for t in TEXTS.values() for r in re.findall(r"\{((?:our|their)_[a-z]+)\}", t)}):
        j = j.withColumn("text", F.replace("text", F.lit(f"{{{role}}}"), F.coalesce(F.col("named")[role], F.lit("no one yet"))))
    return j.select("match_id", "team_id", "opp_id", "rule", "place", "departure", "held", "text")


def followed(calls: DataFrame, levels: DataFrame, weights: DataFrame, reps: int = 200, actions=ACTIONS) -> DataFrame:
    """By rule that says what to do: do teams that did it come out better than their call where the rule fired, where it did not,
    and what is the difference? calls: as-of calls of all features, levels: those of LEVEL_FEATURES, weights: match_id, weight (minutes of
    level play). Gaps are weighted; intervals draw whole matches, so that both sides of one keep the same weight."""
    table = calls.sparkSession.createDataFrame([(r, f, w, d) for r, f, w, d in actions], "rule string, act string, actor string, way int")  # five rows
    fired = rule_rows(calls, tuple(r for r in GAME_RULES if r[0] in {a[0] for a in actions}), "usual", "true").select("match_id", "team_id", "opp_id", "rule", "fired")
    own = levels.select("match_id", F.col("team_id").alias("src"), F.col("feature").alias("act"), F.col("actual").alias("done"), F.col("own").alias("usual"))
    out = levels.where(F.col("feature") == OUTCOME).select("match_id", "team_id", (F.col("actual") - F.col("call")).alias("over"))
    u = fired.join(F.broadcast(table), "rule").withColumn("src", F.when(F.col("actor") == "we", F.col("team_id")).otherwise(F.col("opp_id")))
    u = u.join(own, ["match_id", "src", "act"]).join(out, ["match_id", "team_id"]).join(weights, "match_id").where("done is not null and usual is not null and over is not null and weight is not null")
    u = u.withColumn("did", F.col("way") * (F.col("done") - F.col("usual")) > 0)
    cells = {"ft": "fired and did", "fn": "fired and not did", "nt": "not fired and did", "nn": "not fired and not did"}
    m = u.groupBy("rule", "match_id").agg(*(F.sum(F.expr(f"case when {c} then {v} else 0 end")).alias(f"{k}_{n}") for k, c in cells.items() for n, v in (("s", "weight * over"), ("w", "weight"), ("u", "1"))))
    s = _drawn(m, reps).groupBy("rule", "rep").agg(*(F.sum(F.col("w") * F.col(f"{k}_{n}")).alias(f"{k}_{n}") for k in cells for n in "swu"))
    s = s.withColumns({k: _over(F.col(f"{k}_s"), F.col(f"{k}_w")) for k in cells})
    s = s.withColumn("gap_fired", F.col("ft") - F.col("fn")).withColumn("gap_not", F.col("nt") - F.col("nn")).withColumn("extra", F.col("gap_fired") - F.col("gap_not"))
    first = lambda e: F.max(F.expr(f"case when rep = 0 then {e} end"))
    g = s.groupBy("rule").agg(*(first(f"{k}_u").alias(k) for k in cells), *(c for k in ("gap_fired", "gap_not", "extra") for c in _interval(k)))
    verdict = F.when(F.col("extra_lo") > 0, "supported").when(F.col("extra_hi") < 0, "contradicted").otherwise("no evidence either way")
    names = [f"{k}{e}" for k in ("gap_fired", "gap_not", "extra") for e in ("", "_lo", "_hi")]
    return g.select("rule", (F.col("ft") + F.col("fn")).cast("long").alias("fired"), F.round(_over(F.col("ft"), F.col("ft") + F.col("fn")), 6).alias("did_when_fired"), F.round(_over(F.col("nt"), F.col("nt") + F.col("nn")), 6).alias("did_when_not"),
        *(F.round(c, 6).alias(c) for c in names), verdict.alias("verdict"))
