"""Two seasons in one log give what each gives alone."""

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import seasons
from tallyfield.operators import audit, chain, enrich, experiments, matchup, reliability, season, stats, value
from tallyfield.sources import adapters


@pytest.fixture(scope="module")
def logs(spark):
    """A season alone, and with another of the same teams and days whose matches are others."""
    one = enrich.enrich(adapters.load(spark, "/root/testdata/sf0.001")).where("match_id < 700").cache()
    late = enrich.enrich(adapters.load(spark, "/root/testdata/sf0.001")).where("match_id between 1000 and 1599")
    late = late.withColumn("match_date", F.date_sub("match_date", 9))
    both = seasons.keyed(one.withColumn("season", F.lit(1)).unionByName(late.withColumn("season", F.lit(2)))).cache()
    return one, both


def same(alone, kept, teams=("team_id",)):
    """Rows of season 1 with their own team numbers equal the rows of the season alone."""
    ids = [c for c in alone.columns if c in teams]
    kept = kept.where(seasons.season_of(ids[0]) == 1) if ids else kept.where("season = 1")
    drop = [c for c in ("season",) if c in alone.columns]
    a, b = ({tuple(v for v in r if not isinstance(v, float)): [v for v in r if isinstance(v, float)] for r in df.collect()} for df in (alone.drop(*drop), kept.withColumns({c: seasons.team_of(c) for c in ids}).select(*alone.columns).drop(*drop)))
    assert a and a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-6) for k, v in a.items())


def test_keys_hold_seasons(spark):
    df = spark.range(3).select(F.col("id").alias("season"), seasons.team_key(F.col("id"), F.lit(77)).alias("team_id"), seasons.league_key("id").alias("league"))
    for r in df.select("season", seasons.season_of().alias("s"), seasons.team_of().alias("t"), seasons.season_of("league").alias("ls"), seasons.team_of("league").alias("lt")).collect():
        assert tuple(r) == (r["season"], r["season"], 77, r["season"], seasons.LEAGUE)


def test_chains_of_two_seasons(logs):
    (c1, s1), (c2, s2) = ((stats.outcome_table(ev).cache(), stats.start_table(ev).cache()) for ev in logs)
    same(chain.league_chain(c1).withColumn("season", F.lit(1)), chain.league_chain(c2))
    same(chain.kappa_scores(c1).withColumn("season", F.lit(1)), chain.kappa_scores(c2))
    k1, k2 = chain.select_kappa(c1), chain.select_kappa(c2)
    assert k1.first()["kappa"] == k2.where("season = 1").first()["kappa"] and k2.count() == 2
    (cells1, zones1), (cells2, zones2) = ([season.once(x) for x in season.season_chains(c, s, season.once(k))] for c, s, k in ((c1, s1, k1), (c2, s2, k2)))
    same(cells1, cells2)
    same(zones1, zones2)
    v1, v2 = (season.once(season.solved(c, z, "side", "team_id")) for c, z in ((cells1, zones1), (cells2, zones2)))
    f1, f2 = (season.once(season.region_flows(c, v, "side", "team_id")) for c, v in ((cells1, v1), (cells2, v2)))
    same(season.strongest_links(f1), season.strongest_links(f2))
    same(season.leaks(f1), season.leaks(f2))
    at = lambda df: df.where("side = 'attack'").drop("side")
    d1, d2 = season.distances(at(cells1), at(v1)), season.once(season.distances(at(cells2), at(v2)))
    same(d1, d2, ("team_a", "team_b"))
    assert d2.where(seasons.season_of("team_a") != seasons.season_of("team_b")).count() == 0
    same(matchup.similar_teams(d1), matchup.similar_teams(d2), ("team_id", "other"))
    same(season.denial_plan(cells1, zones1, c1), season.denial_plan(cells2, zones2, c2))
    same(matchup.matchup_chains(c1, 30.0), matchup.matchup_chains(c2, 30.0), ("team_id", "opp_id"))


def test_claims_of_two_seasons(logs):
    l1, l2 = (stats.ledger(ev).cache() for ev in logs)
    same(stats.claims(l1), stats.claims(l2))
    same(reliability.claim_estimates(l1, stats.CLAIMS, 20), reliability.claim_estimates(l2, stats.CLAIMS, 20))
    r1, r2 = (stats.results(ev).cache() for ev in logs)
    same(stats.asof_calls(r1), stats.asof_calls(r2))
    a, b = ({(r["match_id"], r["model"]): r["home"] for r in stats.result_calls(r).where("match_id < 700").collect()} for r in (r1, r2))
    assert a == b and len(a) > 40
    assert value.grid_values(logs[1]).count() == value.GRID  # values are those of all seasons


def test_features_of_two_seasons(logs):
    longs = []
    for ev in logs:
        table = audit.season_table(stats.outcome_table(ev), stats.start_table(ev), 3, 5)
        longs.append(audit.long_form(table, ev, ("possession", "start_height", "turnover_rate")).cache())
    same(audit.asof(longs[0]), audit.asof(longs[1]), ("team_id", "opp_id"))
    same(audit.loo(longs[0]), audit.loo(longs[1]))
    p1, p2 = (audit.pseudo_asof(x) for x in longs)
    same(p1.withColumn("season", F.lit(1)), p2)
    same(audit.asof(longs[0], p1), audit.asof(longs[1], p2), ("team_id", "opp_id"))


def test_experiments_of_two_seasons(logs):
    (c1, s1), (c2, s2) = ((stats.outcome_table(ev).cache(), stats.start_table(ev).cache()) for ev in logs)
    same(experiments.outcome_rows(c1, s1, 1), experiments.outcome_rows(c2, s2, 1), ("team_id", "opp_id"))
