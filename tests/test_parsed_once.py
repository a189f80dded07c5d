"""Queries parse the event log once, however often they read it."""

import pytest

from tallyfield import registry
from tallyfield.operators import season

FOLDER = "/root/testdata/sf0.001"


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object")


def test_filters_do_not_repeat_the_parse(spark):
    assert _parses(registry.QUERIES["outcome_table"](spark, FOLDER)) == 1


@pytest.mark.parametrize("name", ["season_matchups", "matchup_chains", "season_chains", "season_values", "team_values", "team_chains", "kappa_scores", "selected_kappa"])
def test_chains_do_not_parse_again(spark, monkeypatch, name):
    monkeypatch.setattr(season, "once", lambda df: df.localCheckpoint())
    assert _parses(registry.QUERIES[name](spark, FOLDER)) == 0


@pytest.mark.parametrize("name", ["team_pages", "claim_estimates", "season_ledger", "season_claims", "followed_instructions"])
def test_events_are_put_in_order_once(spark, monkeypatch, name):
    monkeypatch.setattr(season, "once", lambda df: df)
    kept = []
    monkeypatch.setattr(season, "kept", lambda df, of: kept.append(of) or df.localCheckpoint(), raising=False)
    assert _parses(registry.QUERIES[name](spark, FOLDER)) == 0
    assert kept == ["events"]


@pytest.mark.parametrize("name", ["pass_options", "shape_features"])
def test_frames_read_kept_events(spark, monkeypatch, name):
    kept = []
    monkeypatch.setattr(season, "kept", lambda df, of: kept.append(of) or df.localCheckpoint(), raising=False)
    assert _parses(registry.QUERIES[name](spark, FOLDER)) == 0
    assert kept == ["events"]
