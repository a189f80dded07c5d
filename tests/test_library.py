"""All seasons of a lake in one job: each as it is alone, and none twice."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import delivery
from tallyfield.sources import adapters, lake


@pytest.fixture(scope="module")
def parts(spark):
    ev = adapters.load(spark, "/root/testdata/sf0.001")
    one = ev.where("match_id < 1500").withColumn("season_id", F.lit(1).cast("long"))
    two = ev.where("match_id >= 1500").withColumn("season_id", F.lit(2).cast("long"))
    return one.cache(), two.cache()


def opened(*seasons):
    ev = seasons[0]
    for s in seasons[1:]:
        ev = ev.unionByName(s)
    sides = [F.col("home_team_id").alias("home_team_id"), F.col("away_team_id").alias("away_team_id"), *(F.col(f"{s}_team_id").cast("string").alias(f"{s}_team") for s in ("home", "away"))]
    matches = ev.select("match_id", F.lit(7).cast("long").alias("competition_id"), "season_id", "match_date", F.lit("x").alias("season"), F.lit(False).alias("has_360"), *sides).distinct()
    return lake.Lake.from_frames(events=ev.drop("season_id", "match_date", "home_team_id", "away_team_id"), matches=matches)


def pages(spark, target):
    rows = spark.read.parquet(f"{target}/pages").collect()
    out = {(r["season"], r["team_id"]): json.loads(r["page"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_two_seasons_are_built_once_and_as_alone(spark, parts, tmp_path):
    one, two = parts
    together, alone = str(tmp_path / "both"), str(tmp_path / "one")
    assert [tuple(r) for r in delivery.build_library(opened(one), alone).select("season", "teams").collect()] == [(70_001, 10)]
    assert delivery.build_library(opened(one, two), together).count() == 2
    a, b = pages(spark, alone), pages(spark, together)
    assert set(a) == {k for k in b if k[0] == 70_001} and len(b) == 20
    for k, page in a.items():  # threat in claims is by values of all seasons
        mine = {c["claim"]: c for c in b[k]["claims"]}
        assert [c["claim"] for c in page["claims"]] == list(mine)
        assert all(c["value"] == pytest.approx(mine[c["claim"]]["value"]) for c in page["claims"] if c["claim"] in ("possession", "long_balls", "ppda", "high_regains"))
        assert page["flow"] == b[k]["flow"] and page["leaks"] == b[k]["leaks"] and [x["other"] for x in page["similar"]] == [x["other"] for x in b[k]["similar"]]
        assert [(x["region_from"], x["region_to"]) for x in page["deny"]] == [(x["region_from"], x["region_to"]) for x in b[k]["deny"]]
    # Nothing to do; then the season that the first lake lacks.
    stamp = sorted(p.stat().st_mtime_ns for p in (tmp_path / "one" / "pages").rglob("*.parquet"))
    delivery.build_library(opened(one), alone)
    assert stamp == sorted(p.stat().st_mtime_ns for p in (tmp_path / "one" / "pages").rglob("*.parquet"))
    assert delivery.build_library(opened(one, two), alone).count() == 2 and stamp == sorted(p.stat().st_mtime_ns for p in (tmp_path / "one" / "pages" / "season=70001").rglob("*.parquet"))
    assert pages(spark, alone).keys() == b.keys()
