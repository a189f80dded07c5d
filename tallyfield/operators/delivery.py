"""Seasons as one JSON page for each team, and all seasons of a lake in one job that is taken up where it stopped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seasons import keyed, season_of, team_of
from ..sources.lake import Lake, eligible_seasons
from . import chain, enrich, matchup, reliability, season, stats, value


def _listed(df: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
    """team_id and an array of structs, in order; a team has a few dozen of them."""
    row = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.struct(*columns).alias("row"))
    return df.groupBy("team_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["row"]).alias(name))


def team_pages(estimates: DataFrame, links: DataFrame, plan: DataFrame, leaks: DataFrame, similar: DataFrame, levers: int = 5) -> DataFrame:
    """team_id and page: claims, strongest links, levers to deny and to protect, leaks, nearest teams, as JSON."""
    kind = F.when(F.col("region_from") < 0, "entry").otherwise("link").alias("kind")
    p = plan.where(F.col("lever") <= levers).select("*", kind)
    lever = ["kind", "region_from", "region_to", "usage", "drop_adapting", "drop_losing", "excess"]
    parts = [
        _listed(estimates, "claims", ["claim"], ["claim", "value", "lo", "hi", "league", "confidence", "words"]), _listed(links.where("side = 'attack'"), "flow", ["place"], ["r0", "r1", "flow", "vs_league"]),
        _listed(p.where("side = 'attack'"), "deny", ["kind", "lever"], lever), _listed(p.where("side = 'conceded'"), "protect", ["kind", "lever"], lever),
        _listed(leaks, "leaks", ["place"], ["r0", "r1", "flow", "excess"]), _listed(similar, "similar", ["place"], ["other", "distance"]),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.join(q, "team_id", "left")
    return out.select("team_id", F.to_json(F.struct(*(c for c in out.columns if c != "team_id"))).alias("page"))


def season_pages(ev: DataFrame) -> DataFrame:
    """season, team_id, page for the teams of all seasons of enriched events whose team ids hold the season."""
    counts, starts = season.once(stats.outcome_table(ev)), season.once(stats.start_table(ev))
    cells, zones = (season.once(df) for df in season.season_chains(counts, starts, season.once(chain.select_kappa(counts))))
    solved = season.once(season.solved(cells, zones, "side", "team_id"))
    flows = season.once(season.region_flows(cells, solved, "side", "team_id"))
    c, z = (df.where("side = 'attack'").drop("side") for df in (cells, solved))
    claims = reliability.claim_estimates(season.once(value.season_ledger(ev)), value.SEASON_CLAIMS)
    similar = matchup.similar_teams(season.distances(c, z)).withColumn("other", team_of("other"))
    pages = team_pages(claims, season.strongest_links(flows), season.denial_plan(cells, zones, counts), season.leaks(flows), similar)
    return pages.select(season_of().alias("season"), team_of().alias("team_id"), "page")


def built_seasons(spark, target: str) -> DataFrame | None:
    """season, teams: what `build_library` has written."""
    try:
        return spark.read.parquet(f"{target}/built")
    except AnalysisException:
        return None


def build_library(lake: Lake, target: str, force: bool = False, least_matches: int = 5, least_teams: int = 4) -> DataFrame:
    """Write the pages of every eligible season that is not built yet (of all with `force`), in one job over all of them; a season is a partition
    and is replaced as a whole. Returns season, teams of what is there. A season's number is its competition's times 10,000 plus its own; a
    run that stops before its list of built seasons is written does these again."""
    matches = lake.matches()
    spark = matches.sparkSession
    key = (F.col("competition_id") * 10_000 + F.col("season_id")).alias("season")
    todo = eligible_seasons(matches, least_matches, least_teams).select("competition_id", "season_id", key)
    done = built_seasons(spark, target)
    if done is not None and not force:
        todo = todo.join(done.select("season"), "season", "left_anti")
    todo = season.once(todo)
    if not todo.isEmpty():
        names = lake.events().drop("season").join(todo, ["competition_id", "season_id"])
        pages = season_pages(season.once(enrich.enrich(keyed(names))))
        pages.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("season").mode("overwrite").parquet(f"{target}/pages")
        written = spark.read.parquet(f"{target}/pages").groupBy("season").agg(F.count("*").alias("teams"))
        todo.select("season").join(written, "season", "left").fillna(0, ["teams"]).select("teams", "season").write.option("partitionOverwriteMode", "dynamic").partitionBy("season").mode("overwrite").parquet(f"{target}/built")
    done = built_seasons(spark, target)
    return done if done is not None else todo.selectExpr("0L as teams", "season")
