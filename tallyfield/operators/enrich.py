"""Event enrichment by windows over (match) and (match, possession): one shuffle on match_id serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch


def with_kind(ev: DataFrame) -> DataFrame:
    """kind: open-play actions; action: restarts too."""
    return ev.withColumn("kind", F.expr(pitch.KIND)).withColumn("action", F.expr(pitch.ACTION)).withColumn("opp_id", F.expr("case when team_id = home_team_id then away_team_id else home_team_id end"))


def enrich(ev: DataFrame) -> DataFrame:
    """xg and goals still to come in the possession, how it began, phase, restart, transition, score before the event."""
    pos = Window.partitionBy("match_id", "possession")
    after = pos.orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy("match_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("team_id") == F.col("possession_team_id")
    shot = mine & (F.col("type") == "Shot")
    goal = F.expr(pitch.GOAL)
    begun = mine & F.col("x").isNotNull()
    first = lambda c: F.min_by(F.when(begun, F.col(c)), F.when(begun, F.col("idx"))).over(pos)
    clock = F.expr("period * 10000 + period_seconds")
    e = with_kind(ev).withColumn("in_possession", mine).withColumn("clock", clock).withColumn("restart", F.expr(pitch.RESTART)).withColumn("phase", F.expr(pitch.PHASE)).withColumn("bucket", F.expr(pitch.BUCKET))
    e = e.withColumn("xg_after", F.coalesce(F.sum(F.when(shot, F.col("xg"))).over(after), F.lit(0.0)))
    e = e.withColumn("goal_after", F.coalesce(F.max(shot & F.col("outcome").eqNullSafe("Goal")).over(after), F.lit(False)))
    e = e.withColumn("pos_start_x", first("x")).withColumn("pos_first_type", first("type"))
    e = e.withColumn("pos_xg", F.coalesce(F.sum(F.when(shot, F.col("xg"))).over(pos), F.lit(0.0))).withColumn("pos_shot", F.coalesce(F.max(shot).over(pos), F.lit(False)))
    e = e.withColumn("pos_seconds", F.col("clock") - F.min(F.when(begun, F.col("clock"))).over(pos)).withColumn("transition", F.expr(pitch.TRANSITION))
    for side in ("home", "away"):
        e = e.withColumn(f"{side}_goals", F.coalesce(F.sum(F.when(goal & (F.col("team_id") == F.col(f"{side}_team_id")), 1).otherwise(0)).over(before), F.lit(0)).cast("long"))
    return e
