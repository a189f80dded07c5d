"""Absorbing chains over pitch zones, in long form; arrays appear only for the solve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.seasons import season_of

KAPPAS = (1, 3, 10, 30, 100, 300, 1000)  # fixed values: the grid that shrinkage is chosen from


def _cells(spark) -> DataFrame:
    """Every (zone, outcome): 960 rows."""
    return spark.range(pitch.ZONES * (pitch.ZONES + 2)).selectExpr(f"cast(id div {pitch.ZONES + 2} as int) as z0", f"cast(id % {pitch.ZONES + 2} as int) as out")


def league_chain(counts: DataFrame) -> DataFrame:
    """season, z0, out, p: transition shares with one pseudo loss in each zone."""
    n = counts.groupBy(season_of().alias("season"), "z0", "out").agg(F.sum("n").alias("n"))
    every = n.select("season").distinct().crossJoin(F.broadcast(_cells(counts.sparkSession)))
    full = every.join(n, ["season", "z0", "out"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.expr(f"case when out = {pitch.LOSS} then 1 else 0 end"))
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("season", "z0"))).select("season", "z0", "out", "p")


def with_kappa(df: DataFrame, kappa: float | DataFrame) -> DataFrame:
    """Rows that have a season, with its kappa: a number, or a table (season, kappa)."""
    return df.join(kappa.select("season", F.col("kappa").cast("double").alias("kappa")), "season") if isinstance(kappa, DataFrame) else df.withColumn("kappa", F.lit(float(kappa)))


def team_chains(counts: DataFrame, kappa: float | DataFrame) -> DataFrame:
    """team_id, z0, out, p: counts shrunk to the league of their season by kappa pseudo actions."""
    n = counts.groupBy("team_id", "z0", "out").agg(F.sum("n").alias("n"))
    cells = n.select("team_id", season_of().alias("season")).distinct().join(league_chain(counts), "season")
    full = with_kappa(cells.join(n, ["team_id", "z0", "out"], "left").withColumn("n", F.coalesce("n", F.lit(0))), kappa)
    return full.withColumn("p", (F.col("n") + F.col("kappa") * F.col("p")) / (F.sum("n").over(Window.partitionBy("team_id", "z0")) + F.col("kappa"))).select("team_id", "z0", "out", "p")


def kappa_scores(counts: DataFrame) -> DataFrame:
    """Leave-one-match-out log likelihood of each kappa by season, by subtraction: no fit is repeated."""
    return _likelihoods(counts, league_chain(counts)).select("season", "kappa", F.round("loglik", 6).alias("loglik"))


def select_kappa(counts: DataFrame, least_matches: int = 3) -> DataFrame:
    """season, kappa: the kappa that best predicts held-out matches of the teams with at least `least_matches`; ties, and
    seasons without such a team, go to the smaller."""
    played = counts.groupBy("team_id").agg(F.countDistinct("match_id").alias("m")).where(F.col("m") >= least_matches)
    scores = _likelihoods(counts.join(played, "team_id", "left_semi"), league_chain(counts))
    best = scores.groupBy("season").agg(F.max_by("kappa", F.struct("loglik", -F.col("kappa"))).alias("kappa"))
    return counts.select(season_of().alias("season")).distinct().join(best, "season", "left").select("season", F.coalesce("kappa", F.lit(min(KAPPAS))).cast("int").alias("kappa"))


def _likelihoods(counts: DataFrame, league: DataFrame) -> DataFrame:
    c = counts.groupBy("team_id", "match_id", "z0", "out").agg(F.sum("n").alias("n")).withColumn("season", season_of())
    c = c.withColumn("rest", F.sum("n").over(Window.partitionBy("team_id", "z0", "out")) - F.col("n"))
    row = F.sum("n").over(Window.partitionBy("team_id", "z0")) - F.sum("n").over(Window.partitionBy("team_id", "match_id", "z0"))
    c = c.withColumn("row", row).join(league, ["season", "z0", "out"]).withColumn("kappa", F.explode(F.array(*(F.lit(k) for k in KAPPAS))))
    p = F.greatest((F.col("rest") + F.col("kappa") * F.col("p")) / (F.col("row") + F.col("kappa")), F.lit(1e-12))
    return c.groupBy("season", "kappa").agg((F.sum(F.col("n") * F.log(p)) / F.sum("n")).alias("loglik"))


def shot_quality(counts: DataFrame) -> DataFrame:
    """season, z0, g: mean xg of a shot."""
    return counts.where(F.col("out") == pitch.SHOT).groupBy(season_of().alias("season"), "z0").agg((F.sum("xg") / F.sum("n")).alias("g"))
