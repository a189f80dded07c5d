"""Team keys that hold the season: whatever is grouped by team is then kept apart by season, and the season of a league's sums is read
off the key. The league itself has the key below a season's first team; without seasons all keys are of season 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
LEAGUE = -1


def team_key(season: Column, team: Column) -> Column:
    return F.shiftleft(season.cast("long"), BITS) + team.cast("long")


def season_of(team: str = "team_id") -> Column:
    return F.shiftright(F.col(team).cast("long") + 1, BITS)


def team_of(team: str = "team_id") -> Column:
    """The team's own number, LEAGUE for the league."""
    return F.col(team).cast("long") - F.shiftleft(season_of(team), BITS)


def league_key(season: str = "season") -> Column:
    return F.shiftleft(F.col(season), BITS) + LEAGUE


def keyed(ev: DataFrame, season: str = "season") -> DataFrame:
    """Events whose teams carry their season. Match ids are of one season by themselves."""
    teams = [c for c in ("team_id", "possession_team_id", "home_team_id", "away_team_id", "opp_id") if c in ev.columns]
    return ev.withColumns({c: team_key(F.col(season), F.col(c)) for c in teams})
