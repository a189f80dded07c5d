"""The driver's `events` table as a match event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Texts run on Spark and DuckDB alike. Half a day is played in 45 minutes; odd errors are the attackers', even ones the defenders'.
SECONDS = "(cast((hour(ts) % 12) * 3600 + minute(ts) * 60 + floor(second(ts)) as double) / 16)"
TYPE = """(case event_type when 'view' then 'Pass' when 'signup' then 'Pass' when 'click' then 'Carry' when 'purchase' then case when event_id % 101 = 0 then 'Own Goal For' else 'Shot' end else
  case when k % 2 = 1 then case event_id % 3 when 0 then 'Ball Recovery' when 1 then 'Dispossessed' else 'Miscontrol' end
    when k % 4 = 0 then 'Pressure' when k % 8 = 2 then 'Interception' when event_id % 2 = 0 then 'Duel' else 'Foul Committed' end end)"""
_OUTCOME = """case when event_type in ('view', 'signup') and event_id % 5 = 0 then 'Incomplete' when {type} = 'Shot' then case when event_id % 7 = 0 then 'Goal' else 'Saved' end
  when {type} = 'Interception' then case when event_id % 5 = 0 then 'Lost Out' else 'Won' end end"""
_SUB_TYPE = """case when event_type in ('view', 'signup') then case when event_id % 17 = 0 then 'Corner' when event_id % 19 = 0 then 'Free Kick' end when {type} = 'Shot' and event_id % 23 = 0 then 'Penalty'
  when {type} = 'Duel' then case when event_id % 6 = 0 then 'Aerial Lost' else 'Tackle' end end"""
OUTCOME, SUB_TYPE = _OUTCOME.format(type=TYPE), _SUB_TYPE.format(type=TYPE)
PATTERN = "case event_id % 13 when 0 then 'From Corner' when 1 then 'From Free Kick' when 2 then 'From Counter' else 'Regular Play' end"
RECIPIENT = "case when event_type in ('view', 'signup') and event_id % 11 <> 0 then (user_id + 10 * (1 + event_id % 7)) % 150 end"  # of the same team
POSITION = "case user_id % 4 when 0 then 'Back' when 1 then 'Wing' when 2 then 'Midfield' else 'Forward' end"


def match_events(events: DataFrame) -> DataFrame:
    """A deterministic event log: ten teams in a round robin by day, possessions by change of team along time."""
    e = events.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.col("value") * 100).cast("long").alias("c"))
    e = e.withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")).withColumn("t0", F.col("user_id") % 10)
    e = e.withColumn("r", F.col("day") % 9).withColumn("q", F.expr("((2 * r - t0) % 9 + 9) % 9"))
    e = e.withColumn("o0", F.expr("case when t0 = 9 then r when q = t0 then 9 else q end")).withColumn("lo", F.least("t0", "o0")).withColumn("hi", F.greatest("t0", "o0"))
    e = e.withColumn("match_id", F.expr("day * 100 + lo"))
    order = Window.partitionBy("match_id").orderBy("ts", "event_id")
    e = e.withColumn("idx", F.row_number().over(order).cast("long")).withColumn("change", F.coalesce((F.col("t0") != F.lag("t0").over(order)).cast("int"), F.lit(1)))
    e = e.withColumn("possession", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The derived columns come out of a generator: filters on them then stay above it. Pushed below, a filter on `kind` holds the text of
    # `type` dozens of times, each with its own parse of props, and grows too long to be compiled.
    made = [
        "type", "case when event_type = 'error' and k % 2 = 0 then o0 else t0 end as team_id",
        "cast(k as double) * 12 / 10 as x", "cast(c % 8000 as double) / 100 as y",
        "case when event_type in ('view', 'signup', 'click') then cast((event_id * 37 + k) % 100 as double) * 12 / 10 end as end_x",
        "case when event_type in ('view', 'signup', 'click') then cast((c * 7 + event_id * 13) % 8000 as double) / 100 end as end_y",
        "case when type = 'Shot' then cast(c % 100 as double) / 200 end as xg", f"{_OUTCOME.format(type='type')} as outcome", f"{_SUB_TYPE.format(type='type')} as sub_type",
    ]
    e = e.withColumn("type", F.expr(TYPE)).select("match_id", "event_id", "idx", "lo", "hi", "day", "ts", "event_type", "possession", "t0", "user_id", F.inline(F.array(F.struct(*(F.expr(c) for c in made)))))
    return e.selectExpr(
        "match_id", "event_id", "idx", "case when (day + lo) % 2 = 0 then lo else hi end as home_team_id", "case when (day + lo) % 2 = 0 then hi else lo end as away_team_id",
        "cast(date_add(date'2024-01-01', cast(day as int)) as date) as match_date", "case when hour(ts) < 12 then 1 else 2 end as period",
        f"{SECONDS} as period_seconds", f"cast(floor({SECONDS} / 60) as bigint) + case when hour(ts) < 12 then 0 else 45 end as minute", "type", "possession", "t0 as possession_team_id", "team_id", "user_id as player_id", "x", "y", "end_x", "end_y", "xg",
        "outcome", "sub_type", f"{PATTERN} as play_pattern", f"{RECIPIENT} as recipient_id", f"{POSITION} as position", "event_id % 3 = 0 as under_pressure",
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


SEASON = "cast(1 + datediff(match_date, date'2024-01-01') div 15 as int)"  # the test events are cut into seasons of 15 days


def with_season(ev: DataFrame) -> DataFrame:
    return ev.withColumn("season", F.expr(SEASON))


STARTED, CAME_ON, UNUSED = '[{"start_reason": "Starting XI"}]', '[{"start_reason": "Substitution - On"}]', "[]"


def line_ups(ev: DataFrame) -> DataFrame:
    """A line-up for each team-match: the first eleven players to act start, others who act come on, the rest of the squad is unused."""
    seen = ev.where("player_id % 10 = team_id").groupBy("match_id", "team_id", "player_id").agg(F.min("idx").alias("idx"))
    squad = seen.select("team_id", "player_id").distinct().join(seen.select("team_id", "match_id").distinct(), "team_id")
    full = squad.join(seen, ["match_id", "team_id", "player_id"], "left")
    place = F.row_number().over(Window.partitionBy("match_id", "team_id").orderBy(F.col("idx").asc_nulls_last(), "player_id"))
    return full.withColumn("place", place).select("match_id", "team_id", "player_id", F.when(F.col("idx").isNull(), UNUSED).when(F.col("place") <= 11, STARTED).otherwise(CAME_ON).alias("positions"))


def freeze_frames(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and camera areas for every sixth event of the side in possession with a place: the player on the ball, and where the
    next nine events of the match happen, opponents' places turned round; one player in eleven keeps goal. One area in ten is not known."""
    w = Window.partitionBy("match_id").orderBy("idx")
    near = ev.where("x is not null").withColumn("near", F.collect_list(F.struct("team_id", "event_id", "x", "y")).over(w.rowsBetween(1, 9)))
    e = near.where("event_id % 6 = 0 and team_id = possession_team_id")
    mate = F.col("p.team_id") == F.col("team_id")
    others = e.select("match_id", "event_id", "team_id", F.posexplode("near").alias("n", "p"))
    others = others.select("match_id", "event_id", (F.col("n") + 1).alias("n"), mate.alias("teammate"), F.lit(False).alias("actor"), (F.col("p.event_id") % 11 == 0).alias("keeper"),
        F.when(mate, F.col("p.x")).otherwise(120 - F.col("p.x")).alias("x"), F.when(mate, F.col("p.y")).otherwise(80 - F.col("p.y")).alias("y"))
    frames = others.union(e.select("match_id", "event_id", F.lit(0), F.lit(True), F.lit(True), F.lit(False), "x", "y"))
    lo, hi = F.greatest(F.col("x") - 40, F.lit(-1.0)), F.least(F.col("x") + 70, F.lit(121.0))
    area = F.to_json(F.array(lo, F.lit(-1.0), hi, F.lit(-1.0), hi, F.lit(81.0), lo, F.lit(81.0)))
    return frames, e.where("event_id % 10 <> 0 or event_id % 4 <> 2").select("match_id", "event_id", area.alias("visible_area"))
