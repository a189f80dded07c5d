"""Resampling, leave-one-out audits and scores of calls. Totals are joined as one row; nothing is windowed over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from .stats import CLAIMS, ratio

# Chances of at most 0..5 of a Poisson variable of mean 1, out of 2^32.
POISSON = (1580030169, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291)
PSEUDO = 5  # fixed value: pseudo matches of a shrunk mean
CALL_EDGES = (0.2, 0.3, 0.4, 0.5, 0.6)  # fixed values: inner edges of bins of chance
TIER_LEAD, TIER_USABLE = 0.20, 0.05  # fixed values


def replicate_weight(key: str, rep: str) -> F.Column:
    """Bootstrap weight of a match in a replicate, the same wherever it is computed."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(rep).cast("string"))), 1, 8), 16, 10).cast("long")
    return sum(((u >= t).cast("int") for t in POISSON), F.lit(0))


def claim_intervals(led: DataFrame, reps: int = 200, table=CLAIMS) -> DataFrame:
    """5-95 % intervals of every claim by resampling matches: one grouping by (team, replicate) with map-side sums."""
    part = lambda i, e, side: F.sum(F.expr(f"w * cast({e} as double)")).alias(f"{side}{i}")
    sums = [part(i, e, side) for i, (_, n, d) in enumerate(table) for e, side in ((n, "n"), (d, "d"))]
    drawn = led.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", replicate_weight("match_id", "rep"))
    rows = ", ".join(f"'{k}', n{i}, d{i}" for i, (k, _, _) in enumerate(table))
    v = drawn.groupBy("team_id", "rep").agg(*sums).selectExpr("team_id", f"stack({len(table)}, {rows}) as (claim, num, den)").withColumn("v", F.try_divide("num", "den"))
    g = v.groupBy("team_id", "claim").agg(F.percentile("v", F.lit(0.05)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi"))
    return g.select("team_id", "claim", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def loo_predictions(res: DataFrame, feature: str = "xg") -> DataFrame:
    """League, team, and team with opponent means without the match itself, shrunk by pseudo matches."""
    v = res.select("match_id", "team_id", "opp_id", F.col(feature).alias("v"))
    total = v.agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    match, team, opp = (Window.partitionBy(k) for k in ("match_id", "team_id", "opp_id"))
    v = v.withColumn("sm", F.sum("v").over(match)).withColumn("nm", F.count("v").over(match)).crossJoin(F.broadcast(total))
    v = v.withColumn("league", F.try_divide(F.col("s") - F.col("sm"), (F.col("n") - F.col("nm")).cast("double")))
    shrunk = lambda w: (F.sum("v").over(w) - F.col("v") + PSEUDO * F.col("league")) / (F.count("v").over(w) - 1 + PSEUDO)
    v = v.withColumn("team", shrunk(team)).withColumn("against", shrunk(opp)).where("league is not null")
    return v.select("match_id", "team_id", F.round("v", 6).alias("actual"), *(F.round(F.expr(e), 9).alias(k) for k, e in (("league", "league"), ("team", "team"), ("both", "team + against - league"))))


def audit_scores(pred: DataFrame) -> DataFrame:
    """How much of the spread around the league mean a team's own matches, and its opponent's, explain."""
    sse = lambda c: F.sum(F.pow(F.col("actual") - F.col(c), 2))
    s = pred.agg(F.count("*").alias("n"), sse("league").alias("l"), sse("team").alias("t"), sse("both").alias("b"))
    s = s.select("n", F.round(1 - F.try_divide("t", "l"), 6).alias("r2_team"), F.round(F.try_divide(F.col("t") - F.col("b"), F.col("l")), 6).alias("gain_opponent"))
    return s.withColumn("tier", F.when(F.col("r2_team") >= TIER_LEAD, "lead").when(F.col("r2_team") >= TIER_USABLE, "usable").otherwise("drop"))


def pooled_skill(calls: DataFrame) -> DataFrame:
    """Skill of as-of calls over the league mean, with and without the opponent; share of calls that are closer."""
    sse = lambda c: F.sum(F.pow(F.col("actual") - F.col(c), 2))
    closer = F.avg((F.abs(F.col("actual") - F.col("call")) < F.abs(F.col("actual") - F.col("league"))).cast("double"))
    s = calls.agg(F.count("*").alias("n"), sse("league").alias("l"), sse("call").alias("c"), sse("own").alias("o"), closer.alias("closer"))
    return s.select("n", F.round(1 - F.try_divide("c", "l"), 6).alias("skill"), F.round(1 - F.try_divide("o", "l"), 6).alias("skill_team"), F.round("closer", 6).alias("closer"))


def ranked_scores(chances: DataFrame, res: DataFrame, *keys: str) -> DataFrame:
    """Ranked probability score of every match's home, draw and away chances, with what happened. `keys` are carried along."""
    h = res.where("home").select("match_id", F.col("goals").alias("hg"))
    a = res.where("not home").select("match_id", F.col("goals").alias("ag"))
    j = chances.join(h, "match_id").join(a, "match_id").withColumn("outcome", F.expr("case when hg > ag then 'home' when hg = ag then 'draw' else 'away' end"))
    rps = "(pow(home - case when outcome = 'home' then 1 else 0 end, 2) + pow(home + draw - case when outcome = 'away' then 0 else 1 end, 2)) / 2"
    return j.select("match_id", *keys, "outcome", "home", "draw", "away", F.round(F.expr(rps), 6).alias("rps"))


def team_calls(chances: DataFrame, res: DataFrame, calls: DataFrame) -> DataFrame:
    """Result calls of the xg model and the base rates as each side of a match sees them, with expected and won points.
    `calls` are the as-of calls of every (match_id, team_id); the opponent's own row is what it is called to make.
    Matches without calls of both sides have no row."""
    one = lambda model: chances.where(F.col("model") == model)
    x = one("xg").select("match_id", "scored", "home_rate", "away_rate", *(F.col(c).alias(f"x_{c}") for c in ("home", "draw", "away")))
    b = one("base").select("match_id", *(F.col(c).alias(f"b_{c}") for c in ("home", "draw", "away")))
    them = res.select("match_id", F.col("team_id").alias("opp_id"), F.col("goals").alias("goals_against"))
    they = calls.select("match_id", F.col("team_id").alias("opp_id"), F.col("call").alias("call_against"), F.col("actual").alias("actual_against"))
    we = calls.select("match_id", "team_id", "league", F.col("call").alias("call_for"), F.col("actual").alias("actual_for"))
    j = res.select("match_id", "team_id", "opp_id", F.col("home").alias("at_home"), "goals").join(them, ["match_id", "opp_id"])
    j = j.join(x, "match_id").join(b, "match_id").join(we, ["match_id", "team_id"]).join(they, ["match_id", "opp_id"])
    side = lambda h, a: F.when(F.col("at_home"), F.col(h)).otherwise(F.col(a))
    j = j.withColumn("result", F.expr("case when goals > goals_against then 'win' when goals = goals_against then 'draw' else 'loss' end"))
    for k, v in (("rate_for", side("home_rate", "away_rate")), ("rate_against", side("away_rate", "home_rate")), ("win", side("x_home", "x_away")), ("loss", side("x_away", "x_home")),
                 ("base_win", side("b_home", "b_away")), ("base_loss", side("b_away", "b_home"))):
        j = j.withColumn(k, v)
    j = j.withColumn("draw", F.col("x_draw")).withColumn("base_draw", F.col("b_draw"))
    rps = lambda p: F.round(F.expr(f"(pow({p}win - if(result = 'win', 1, 0), 2) + pow({p}win + {p}draw - if(result = 'loss', 0, 1), 2)) / 2"), 6)
    points = F.expr("case result when 'win' then 3 when 'draw' then 1 else 0 end")
    return j.select("match_id", "team_id", "opp_id", "scored", "rate_for", "rate_against", "league", "call_for", "call_against", "actual_for", "actual_against", "win", "draw", "loss",
                    "base_win", "base_draw", "base_loss", "result", rps("").alias("rps"), rps("base_").alias("rps_base"), F.round(F.expr("3 * win + draw"), 6).alias("expected_points"), points.alias("points"))


def team_call_summary(calls: DataFrame) -> DataFrame:
    """Each team's rows of `team_calls` together: scores, top picks that came true (ties to the better result), points, and
    for both sides how often the call was closer than the league mean, its skill over that mean, and the sums."""
    pick = F.expr("case when win >= draw and win >= loss then 'win' when draw >= loss then 'draw' else 'loss' end")
    sums = [F.count("*").alias("n"), F.round(F.avg("rps"), 6).alias("rps"), F.round(F.avg("rps_base"), 6).alias("rps_base"), F.sum((pick == F.col("result")).cast("long")).alias("top_pick_right"),
            F.round(F.sum("expected_points"), 6).alias("expected_points"), F.sum("points").alias("points")]
    for s in ("for", "against"):
        call, actual, league = F.col(f"call_{s}"), F.col(f"actual_{s}"), F.col("league")
        sums += [F.sum((F.abs(call - actual) < F.abs(league - actual)).cast("long")).alias(f"closer_{s}"), F.round(1 - F.try_divide(F.sum(F.pow(call - actual, 2)), F.sum(F.pow(league - actual, 2))), 6).alias(f"skill_{s}"),
                 F.round(F.sum(call), 6).alias(f"called_{s}"), F.round(F.sum(actual), 6).alias(f"made_{s}")]
    return calls.groupBy("team_id").agg(*sums)


def calibration(scored: DataFrame, bins: int = 6) -> DataFrame:
    """Mean chance and share of hits by bin of chance, over all three outcomes of each match."""
    long = scored.selectExpr("outcome", "stack(3, 'home', home, 'draw', draw, 'away', away) as (side, p)")
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    g = long.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg((F.col("side") == F.col("outcome")).cast("double")).alias("hit"))
    return g.select("bin", "n", F.round(F.col("p") + pitch.NUDGE, 6).alias("p"), F.round("hit", 6).alias("hit"))


def call_calibration(scored: DataFrame) -> DataFrame:
    """By model and bin of chance, over the scored matches: mean chance and share of hits."""
    long = scored.where("scored").selectExpr("model", "outcome", "stack(3, 'home', home, 'draw', draw, 'away', away) as (side, p)")
    b = sum(((F.col("p") >= e).cast("int") for e in CALL_EDGES), F.lit(0))
    g = long.groupBy("model", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg((F.col("side") == F.col("outcome")).cast("double")).alias("hit"))
    return g.select("model", "bin", "n", F.round(F.col("p") + pitch.NUDGE, 6).alias("p"), F.round("hit", 6).alias("hit"))


def fixture_halves(res: DataFrame) -> DataFrame:
    """Odd or even place of a match among its team's by id; whether it is in the later half by date."""
    n = F.count("*").over(Window.partitionBy("team_id"))
    parity = (F.row_number().over(Window.partitionBy("team_id").orderBy("match_id")) - 1) % 2
    later = F.row_number().over(Window.partitionBy("team_id").orderBy("match_date", "match_id")) - 1 >= F.floor(n * 0.5)
    return res.select("match_id", "team_id", parity.cast("int").alias("half"), later.alias("later"))


def lane_baseline(prog: DataFrame) -> DataFrame:
    """Pooled shares of final-line lanes: one grouped pass over all teams."""
    n = prog.where("lane_final is not null").groupBy(F.col("lane_final").alias("lane")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("lane", "n", ratio("n", "t").alias("share"))


def expected_deviation(n: Column, share: Column) -> Column:
    """Mean absolute deviation of the share of n draws from `share`, by De Moivre's formula; 0 for a share of 0 or 1."""
    m = F.floor(n * share).cast("long") + 1  # the first count above the mean
    # In sums of logarithms: the number of ways to choose m of n.
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), m), F.lit(0.0), lambda s, i: s + F.log((n - m + i) / i.cast("double")))
    d = 2 * m / n * F.exp(ways + m * F.log(share) + (n - m + 1) * F.log(1 - share))
    return F.when((share > 0) & (share < 1) & (m <= n), d).otherwise(0.0)


def noise_floor(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """Total variation that the right shares still show, on average, after n draws: half the sum of the mean absolute
    deviations of binomial counts, in place of simulation. `counts` has n, `shares` a few rows of share. No draws give null."""
    j = counts.crossJoin(F.broadcast(shares.select("share")))
    d = F.when(F.col("n") > 0, expected_deviation(F.col("n"), F.col("share")))
    return j.withColumn("d", d).groupBy(*counts.columns).agg(F.round(F.sum("d") / 2 + pitch.NUDGE, 6).alias("floor"))
