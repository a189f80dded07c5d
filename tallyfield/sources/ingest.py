"""Nested JSON of matches, events, line-ups and freeze frames into the lake's tables.

A source folder holds competitions.json, matches/<competition>/<season>.json, events/<match>.json, lineups/<match>.json
and three-sixty/<match>.json. Files are read whole, one row each, and flattened by expressions, so a file that cannot be
parsed costs its match only: the manifest names it. Written seasons are partitions, replaced as a whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import SCHEMAS
from .remote import remote_files

_PART = "struct<end_location:array<double>,outcome:struct<name:string>,type:struct<name:string>,body_part:struct<name:string>,height:struct<name:string>,recipient:struct<id:bigint>,statsbomb_xg:double>"
# Parts of an event that hold its details, in the order in which the first wins; keys that have columns.
PARTS = ("pass", "carry", "shot", "dribble", "duel", "interception", "goalkeeper", "clearance", "ball_receipt", "50_50")
CORE = ("id", "index", "period", "timestamp", "minute", "second", "type", "team", "player", "position", "possession", "possession_team", "play_pattern", "location", "duration", "under_pressure", "counterpress", "related_events")
_NAMED = "struct<id:bigint,name:string>"
EVENT = (
    f"id string, index bigint, period bigint, timestamp string, minute bigint, second bigint, type {_NAMED}, team {_NAMED}, player {_NAMED}, position {_NAMED}, possession bigint, possession_team {_NAMED}, play_pattern {_NAMED}, "
    "location array<double>, duration double, under_pressure boolean, counterpress boolean, related_events array<string>, " + ", ".join(f"`{p}` {_PART}" for p in PARTS)
)
FRAME = "array<struct<event_uuid:string,visible_area:array<double>,freeze_frame:array<struct<teammate:boolean,actor:boolean,keeper:boolean,location:array<double>>>>>"
LINEUP = "array<struct<team_id:bigint,team_name:string,lineup:array<struct<player_id:bigint,player_name:string,player_nickname:string,jersey_number:bigint,country:struct<name:string>,positions:array<string>>>>>"
MATCH = (
    "array<struct<match_id:bigint,match_date:string,kick_off:string,competition_stage:struct<name:string>,home_team:struct<home_team_id:bigint,home_team_name:string>,"
    "away_team:struct<away_team_id:bigint,away_team_name:string>,home_score:bigint,away_score:bigint,match_status_360:string,match_updated:string>>"
)
COMPETITION = "array<struct<competition_id:bigint,season_id:bigint,competition_name:string,season_name:string,competition_gender:string>>"


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """One row for each file: its name without ending, the folder it is in, and its text."""
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return None
    at = F.input_file_name()
    return raw.select(F.regexp_extract(at, r"([^/]+)\.json$", 1).alias("name"), F.regexp_extract(at, r"([^/]+)/[^/]+\.json$", 1).alias("folder"), F.col("value").alias("text"))


def period_seconds(timestamp: Column) -> Column:
    part = F.split(timestamp, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def events_of(files: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Rows of the events table. Details come from the first part that has them, ends from the last; what has no column
    stays as JSON in `extra`."""
    e = files.select(F.col("name").cast("long").alias("match_id"), F.explode(F.from_json("text", "array<string>")).alias("raw"))
    e = e.select("match_id", "raw", F.from_json("raw", EVENT).alias("e"))
    first = lambda f: F.coalesce(*(F.nullif(F.col(f"e.`{p}`.{f}.name"), F.lit("")) for p in PARTS))
    end = F.coalesce(*(F.when(F.size(F.col(f"e.`{p}`.end_location")) > 0, F.col(f"e.`{p}`.end_location")) for p in reversed(PARTS)))
    rest = F.map_filter(F.parse_json("raw").cast("map<string,variant>"), lambda k, _: ~k.isin(*CORE))
    out = e.select(
        "match_id", F.col("e.id").alias("event_id"), F.col("e.index").alias("idx"), F.col("e.period").alias("period"), period_seconds(F.col("e.timestamp")).alias("period_seconds"),
        F.col("e.minute").alias("minute"), F.col("e.second").alias("second"), F.col("e.type.name").alias("type"), F.col("e.team.id").alias("team_id"), F.col("e.team.name").alias("team"),
        F.col("e.player.id").alias("player_id"), F.col("e.player.name").alias("player"), F.col("e.position.name").alias("position"), F.col("e.possession").alias("possession"),
        F.col("e.possession_team.id").alias("possession_team_id"), F.col("e.play_pattern.name").alias("play_pattern"), F.try_element_at("e.location", F.lit(1)).alias("x"), F.try_element_at("e.location", F.lit(2)).alias("y"),
        F.try_element_at(end, F.lit(1)).alias("end_x"), F.try_element_at(end, F.lit(2)).alias("end_y"), first("outcome").alias("outcome"), first("type").alias("sub_type"), F.col("e.pass.recipient.id").alias("recipient_id"),
        F.col("e.shot.statsbomb_xg").alias("xg"), first("body_part").alias("body_part"), first("height").alias("height"), F.col("e.duration").alias("duration"), F.coalesce("e.under_pressure", F.lit(False)).alias("under_pressure"),
        F.coalesce("e.counterpress", F.lit(False)).alias("counterpress"), F.to_json(F.coalesce("e.related_events", F.array().cast("array<string>"))).alias("related"), F.to_json(rest).alias("extra"),
    )
    if frames is None:
        return out.withColumn("has_360", F.lit(False)).select(*_names("events"))
    seen = frames.select("match_id", "event_id").distinct().withColumn("has_360", F.lit(True))
    return out.join(seen, ["match_id", "event_id"], "left").fillna(False, ["has_360"]).select(*_names("events"))


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def frames_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the frames and areas tables."""
    f = files.select(F.col("name").cast("long").alias("match_id"), F.explode(F.from_json("text", FRAME)).alias("f"))
    areas = f.select("match_id", F.col("f.event_uuid").alias("event_id"), F.to_json(F.coalesce("f.visible_area", F.array().cast("array<double>"))).alias("visible_area"))
    p = f.select("match_id", F.col("f.event_uuid").alias("event_id"), F.posexplode("f.freeze_frame").alias("n", "p"))
    no = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(False)).alias(c)
    return p.select("match_id", "event_id", "n", no("teammate"), no("actor"), no("keeper"), F.col("p.location")[0].alias("x"), F.col("p.location")[1].alias("y")), areas


def lineups_of(files: DataFrame) -> DataFrame:
    t = files.select(F.col("name").cast("long").alias("match_id"), F.explode(F.from_json("text", LINEUP)).alias("t")).select("match_id", "t", F.explode("t.lineup").alias("p"))
    spells = F.concat(F.lit("["), F.array_join(F.coalesce("p.positions", F.array().cast("array<string>")), ", "), F.lit("]"))
    return t.select("match_id", F.col("t.team_id").alias("team_id"), F.col("t.team_name").alias("team"), F.col("p.player_id").alias("player_id"), F.col("p.player_name").alias("player"), F.col("p.player_nickname").alias("nickname"),
        F.col("p.jersey_number").alias("jersey"), F.col("p.country.name").alias("country"), spells.alias("positions"))


def matches_of(files: DataFrame, competitions: DataFrame) -> DataFrame:
    """Rows of the matches table, with the stamp of their last change."""
    m = files.select(F.col("folder").cast("long").alias("competition_id"), F.col("name").cast("long").alias("season_id"), F.explode(F.from_json("text", MATCH)).alias("m"))
    c = competitions.select(F.explode(F.from_json("text", COMPETITION)).alias("c")).select("c.*")
    c = c.select("competition_id", "season_id", F.col("competition_name").alias("competition"), F.col("season_name").alias("season"), F.col("competition_gender").alias("gender"))
    return m.join(F.broadcast(c), ["competition_id", "season_id"], "left").select(
        "m.match_id", "competition_id", "season_id", "competition", "season", "gender", "m.match_date", "m.kick_off", F.col("m.competition_stage.name").alias("stage"), F.col("m.home_team.home_team_id").alias("home_team_id"), F.col("m.home_team.home_team_name").alias("home_team"),
        F.col("m.away_team.away_team_id").alias("away_team_id"), F.col("m.away_team.away_team_name").alias("away_team"), "m.home_score", "m.away_score", F.col("m.match_status_360").eqNullSafe("available").alias("has_360"), F.coalesce("m.match_updated", F.lit("")).alias("updated"),
    )


def changed_seasons(matches: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Seasons that the manifest lacks or whose matches changed since: number and last stamp differ."""
    now = matches.groupBy("competition_id", "season_id").agg(F.count("*").alias("matches"), F.max("updated").alias("updated"))
    return now if manifest is None else now.join(manifest.select("competition_id", "season_id", "matches", "updated"), ["competition_id", "season_id", "matches", "updated"], "left_anti")


def read_manifest(spark: SparkSession, lake: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{lake}/manifest")
    except AnalysisException:
        return None


def ingest(spark: SparkSession, source: str, lake: str, only: list[tuple[int, int]] | None = None, force: bool = False, with_frames: bool = True) -> DataFrame:
    """Write the seasons that are new or changed, all of them with `force`, and return the manifest: number of matches and
    events by season, and the matches that failed. `source` is a folder or the address of a site. A run that stops half-way is taken up by the next."""
    far = source.startswith(("http://", "https://"))
    source = source.rstrip("/")
    competitions = remote_files(spark, source, ["competitions.json"]) if far else _files(spark, f"{source}/competitions.json")
    if far:  # a site has no listing: its seasons are those of its competitions
        seasons = competitions.select(F.explode(F.from_json("text", COMPETITION)).alias("c")).select("c.competition_id", "c.season_id").distinct().collect()
        listed = remote_files(spark, source, [f"matches/{c}/{s}.json" for c, s in seasons if only is None or (c, s) in only])
    matches = matches_of(listed if far else _files(spark, f"{source}/matches/*/*.json"), competitions)
    old = read_manifest(spark, lake)
    todo = changed_seasons(matches, None if force else old)
    if only is not None:
        todo = todo.join(spark.createDataFrame(only, "competition_id long, season_id long"), ["competition_id", "season_id"], "left_semi")
    new = matches.join(F.broadcast(todo.select("competition_id", "season_id")), ["competition_id", "season_id"], "left_semi")
    key = F.broadcast(new.select("match_id", "competition_id", "season_id"))

    def write(table: DataFrame, name: str) -> None:
        keyed = table if "season_id" in table.columns else table.join(key, "match_id")
        keyed.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("competition_id", "season_id").mode("overwrite").parquet(f"{lake}/{name}")

    open_matches = sorted(r["match_id"] for r in new.select("match_id").collect()) if far else []

    def wanted(kind: str) -> DataFrame | None:
        """The open matches' files of a kind."""
        if far:
            return remote_files(spark, source, [f"{kind}/{m}.json" for m in open_matches])
        files = _files(spark, f"{source}/{kind}/*.json")
        return None if files is None else files.join(new.select(F.col("match_id").cast("string").alias("name")), "name", "left_semi")

    raw = wanted("events")
    frames = None
    if with_frames and (files := wanted("three-sixty")) is not None:
        frames, areas = frames_of(files)
        write(frames, "frames")
        write(areas, "areas")
    write(events_of(raw, frames), "events")
    if (files := wanted("lineups")) is not None:
        write(lineups_of(files), "lineups")
    # What was written is read back: the manifest tells what is there, and which matches have no events.
    count = spark.read.parquet(f"{lake}/events").groupBy("match_id").agg(F.count("*").alias("events"))
    done = new.join(count, "match_id", "left")
    write(done.where("events is not null").drop("events", "updated"), "matches")
    entry = done.groupBy("competition_id", "season_id").agg(F.count("*").alias("matches"), F.max("updated").alias("updated"), F.sum(F.coalesce("events", F.lit(0))).alias("events"), F.sort_array(F.collect_list(F.when(F.col("events").isNull(), F.col("match_id")))).alias("failed"))
    entry.write.option("partitionOverwriteMode", "dynamic").partitionBy("competition_id", "season_id").mode("overwrite").parquet(f"{lake}/manifest")
    return spark.read.parquet(f"{lake}/manifest")
