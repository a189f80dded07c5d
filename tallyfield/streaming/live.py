"""Matches as they come in: spells of a team on the ball, and the running score, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pitch


def spells(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """match_id, possession_team_id, begin, finish, events, xg of each spell: events of one team that follow each other within
    `gap`. `events` has ts, a timestamp; what comes more than `late` behind the newest event is dropped, and a spell is
    given out once it can no longer grow."""
    e = events.withWatermark("ts", late).groupBy("match_id", "possession_team_id", F.session_window("ts", gap).alias("w"))
    g = e.agg(F.count("*").alias("events"), F.sum(F.when(F.col("type") == "Shot", F.col("xg")).otherwise(0.0)).alias("xg"))
    return g.select("match_id", "possession_team_id", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "events", "xg")


def scores(events: DataFrame) -> DataFrame:
    """Goals and xg of each side so far, for update mode: one row of state for each side of a match."""
    return events.groupBy("match_id", "team_id").agg(F.sum(F.expr(f"case when {pitch.GOAL} then 1 else 0 end")).alias("goals"), F.sum(F.expr("case when type = 'Shot' and coalesce(sub_type, '') <> 'Penalty' then coalesce(xg, 0) else 0 end")).alias("xg"))
