"""The lake: five tables under one folder, or tables in memory, with declared schemas."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names and types of the tables.
SCHEMAS = {
    "matches": "match_id long, competition_id long, season_id long, competition string, season string, gender string, match_date string, kick_off string, stage string, home_team_id long, home_team string, away_team_id long, away_team string, home_score long, away_score long, has_360 boolean",
    "events": "match_id long, event_id string, idx long, period long, period_seconds double, minute long, second long, type string, team_id long, team string, player_id long, player string, position string, possession long, possession_team_id long, play_pattern string, x double, y double, end_x double, end_y double, outcome string, sub_type string, recipient_id long, xg double, body_part string, height string, duration double, under_pressure boolean, counterpress boolean, has_360 boolean, related string, extra string",
    "frames": "match_id long, event_id string, n int, teammate boolean, actor boolean, keeper boolean, x double, y double",
    "areas": "match_id long, event_id string, visible_area string",
    "lineups": "match_id long, team_id long, team string, player_id long, player string, nickname string, jersey long, country string, positions string",
}
ROOT_SETTING = "TALLYFIELD_LAKE"


def lake_root(given: str | None = None) -> str:
    """Where the lake is kept: as given or as the environment says; nothing is written anywhere by default."""
    root = given or os.environ.get(ROOT_SETTING)
    if not root:
        raise ValueError(f"name a folder for the lake, or set {ROOT_SETTING}")
    return root.rstrip("/")


class Lake:
    def __init__(self, tables: dict[str, DataFrame]):
        if "events" not in tables:
            raise FileNotFoundError("the lake has no events")
        self.tables = tables

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Lake:
        """Tables that the folder holds; files of older layouts may lack columns, which read as null."""
        found = {}
        for name, schema in SCHEMAS.items():
            try:
                found[name] = spark.read.schema(schema).parquet(f"{root}/{name}")
            except AnalysisException:
                continue
        return cls(found)

    @classmethod
    def from_frames(cls, **tables: DataFrame) -> Lake:
        return cls(tables)

    def has(self, name: str) -> bool:
        return name in self.tables

    def scan(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the lake has no table {name}; it has {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def matches(self) -> DataFrame:
        return self.scan("matches")

    def events(self) -> DataFrame:
        """Events with the context of their match: a left join to a small table."""
        return self.scan("events").join(F.broadcast(self.matches().drop("has_360")), "match_id", "left") if self.has("matches") else self.scan("events")

    def first_matches(self, k: int) -> Lake:
        """The first k matches of each season by date and id, in all tables."""
        place = F.row_number().over(Window.partitionBy("competition_id", "season_id").orderBy("match_date", "match_id"))
        some = self.matches().withColumn("place", place).where(F.col("place") <= k).drop("place")
        ids = F.broadcast(some.select("match_id"))
        return Lake({n: some if n == "matches" else t.join(ids, "match_id", "left_semi") for n, t in self.tables.items()})


def together(*parts: DataFrame) -> DataFrame:
    """All rows of tables that may lack some of each other's columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def team_matches(matches: DataFrame) -> DataFrame:
    """competition_id, season_id, team_id, team, matches: how often a team plays in a season."""
    side = lambda s: matches.select("competition_id", "season_id", F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_team").alias("team"), "match_id")
    return side("home").union(side("away")).groupBy("competition_id", "season_id", "team_id").agg(F.min("team").alias("team"), F.countDistinct("match_id").alias("matches"))


def eligible_seasons(matches: DataFrame, least_matches: int = 5, least_teams: int = 4) -> DataFrame:
    """Seasons with enough teams that play often enough."""
    t = team_matches(matches).where(F.col("matches") >= least_matches)
    return t.groupBy("competition_id", "season_id").agg(F.count("*").alias("teams")).where(F.col("teams") >= least_teams)


def resolve(catalogue: DataFrame, name: str) -> DataFrame:
    """Rows of a catalogue whose team holds a name, in any case; an exact one is preferred. The caller decides what
    several rows mean."""
    low, wanted = F.lower("team"), name.lower()
    found = catalogue.where(low.contains(wanted)).withColumn("exact", (low == wanted).cast("int"))
    best = F.max("exact").over(Window.partitionBy(F.lit(1)))
    return found.withColumn("best", best).where("exact = best").drop("exact", "best")


def player_names(lineups: DataFrame) -> DataFrame:
    """player_id, name: the nickname where there is one; the least of several, so that it is always the same."""
    return lineups.where("player_id is not null").groupBy("player_id").agg(F.min(F.coalesce("nickname", "player")).alias("name"))
