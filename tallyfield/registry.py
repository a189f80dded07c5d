"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pitch
from .functions.seasons import season_of
from .operators import audit, chain, delivery, enrich, experiments, fits, geometry, holdout, matchup, people, players, reliability, replay, routing, scoring, season, stats, value
from .plans.oracle import ORACLE as _ORACLE
from .plans.oracle_audit import ORACLE as _AUDIT
from .plans.oracle_calls import ORACLE as _CALLS
from .plans.oracle_players import ORACLE as _PLAYERS
from .plans.oracle_season import ORACLE as _SEASON
from .plans.oracle_trust import ORACLE as _TRUST
from .plans.oracle_replay import ORACLE as _REPLAY
from .sources.adapters import freeze_frames, line_ups, load, with_season

KAPPA = 30.0
EVENT_COLUMNS = ["event_id", "kind", "restart", "phase", "bucket", "xg_after", "goal_after", "pos_start_x", "pos_first_type", "pos_xg", "pos_shot", "pos_seconds", "transition", "home_goals", "away_goals"]


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(load(spark, sf_dir))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_kind(load(spark, sf_dir))


LEDGER_COLUMNS = ["match_id", "match_date", "team_id", "opp_id", "home_team_id", "away_team_id", "period", "period_seconds", "idx", "possession", "possession_team_id", "type", "sub_type", "outcome", "kind", "action", "restart", "bucket",
    "transition", "in_possession", "clock", "pos_seconds", "x", "y", "end_x", "end_y", "xg", "home_goals", "away_goals"]


def _kept_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched events for queries that read them many times: parsed and put in order once."""
    return season.kept(_ev(spark, sf_dir).select(*LEDGER_COLUMNS), "events")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcome_table(_kinds(spark, sf_dir))


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ev(spark, sf_dir).select(*EVENT_COLUMNS).withColumn("xg_after", F.round("xg_after", 6)).withColumn("pos_xg", F.round("pos_xg", 6))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.round(F.col("p") + pitch.NUDGE, 6))


def result_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.results(_kinds(spark, sf_dir))
    rate = F.greatest("xg", F.lit(0.05))
    h, a = r.where("home").select("match_id", rate.alias("home_rate")), r.where("not home").select("match_id", rate.alias("away_rate"))
    return stats.chances(h.join(a, "match_id"))


def result_call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.results(_kinds(spark, sf_dir))
    return scoring.ranked_scores(stats.result_calls(r), r, "model", "scored")


def team_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.results(_kinds(spark, sf_dir))
    return scoring.team_calls(stats.result_calls(r), r, stats.asof_calls(r))


def lane_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    prog = stats.progressions(_ev(spark, sf_dir))
    n = prog.where("lane_final is not null").groupBy("match_id", "team_id").agg(F.count("*").alias("n"))
    return scoring.noise_floor(n, scoring.lane_baseline(prog))


def lockbox_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(F.col("match_id").cast("string"))
    return load(spark, sf_dir).select("match_id").distinct().select("match_id", digest.alias("digest"), F.substring(digest, 32, 1).isin(*"02468ace").alias("lockbox"))


def eligible_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir)
    t = ev.select(F.col("home_team_id").alias("team_id"), "match_id").union(ev.select("away_team_id", "match_id")).distinct()
    return t.groupBy("team_id").agg(F.count("*").alias("matches")).where("matches >= 5")


def _season_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = season.once(_counts(spark, sf_dir))
    return chain.team_chains(c, chain.select_kappa(c))


def season_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = season.once(_counts(spark, sf_dir))
    return _rounded(matchup.matchup_chains(c, chain.select_kappa(c)))


def _season(spark: SparkSession, sf_dir: str, kappa: float | None = KAPPA, ev: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts and starts, built once, and the cells and zones of all chains. Without kappa, the best of the grid."""
    ev = _kinds(spark, sf_dir) if ev is None else ev
    counts, starts = season.once(stats.outcome_table(ev)), season.once(stats.start_table(ev))
    cells, zones = season.season_chains(counts, starts, chain.select_kappa(counts) if kappa is None else kappa)
    return counts, starts, cells, zones


def team_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cells, zones = _season(spark, sf_dir)
    s = season.solved(cells, zones, "side", "team_id").join(zones.select("side", "team_id", "z0", "g"), ["side", "team_id", "z0"])
    return s.select("side", "team_id", "z0", *(F.round(F.col(c) + pitch.NUDGE, 6).alias(c) for c in ("g", "start", "value", "visits")))


def team_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cells, zones = _season(spark, sf_dir)
    t = season.threats(season.solved(cells, zones, "side", "team_id"), "side", "team_id")
    return t.select("side", "team_id", F.round("threat", 6).alias("threat"))


def style_distances(spark: SparkSession, sf_dir: str, kappa: float | None = KAPPA) -> DataFrame:
    _, _, cells, zones = _season(spark, sf_dir, kappa)
    c, z = (df.where("side = 'attack'").drop("side") for df in (cells, zones))
    return season.distances(c, season.solved(c, z, "team_id"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cells, zones = _season(spark, sf_dir)
    return season.region_flows(cells, season.solved(cells, zones, "side", "team_id"), "side", "team_id")


def entry_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cells, zones = _season(spark, sf_dir)
    return season.entry_lanes(cells, season.solved(cells, zones, "side", "team_id"), "side", "team_id").withColumn("share", F.round("share", 6))


def matchup_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _, cells, zones = _season(spark, sf_dir)
    return season.matchups(cells, zones, counts.select("team_id", "opp_id").distinct())


def reidentification(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, starts, _, _ = _season(spark, sf_dir)
    return season.reidentified(season.half_distances(counts, starts, KAPPA))


def denial_plan(spark: SparkSession, sf_dir: str, kappa: float | None = KAPPA) -> DataFrame:
    counts, _, cells, zones = _season(spark, sf_dir, kappa)
    return season.denial_plan(cells, zones, counts)


def team_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(season.once(_counts(spark, sf_dir)), KAPPA)


def season_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = season.once(_counts(spark, sf_dir))
    return _values(c, chain.select_kappa(c))


def _values(c: DataFrame, kappa: float | DataFrame) -> DataFrame:
    """Values of each team's zones with the league's shot quality; starts do not matter to them."""
    chains = chain.team_chains(c, kappa)
    zones = chains.select("team_id", "z0").distinct().withColumn("season", season_of()).join(chain.shot_quality(c), ["season", "z0"], "left")
    zones = zones.select("team_id", "z0", F.coalesce("g", F.lit(0.0)).alias("g"), F.lit(1.0 / pitch.ZONES).alias("start"))
    return season.solved(chains, zones, "team_id").select("team_id", F.col("z0").alias("zone"), F.round("value", 6).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "match_events": load,
    "enriched_events": enriched_events,
    "outcome_table": _counts,
    "outcome_totals": lambda s, d: stats.outcome_totals(_kinds(s, d)),
    "start_table": lambda s, d: stats.start_table(_kinds(s, d)),
    "progressions": lambda s, d: stats.progressions(_ev(s, d)),
    "route_table": lambda s, d: stats.route_table(stats.progressions(_ev(s, d))),
    "lane_shares": lambda s, d: stats.lane_shares(stats.progressions(_ev(s, d))),
    "ledger": lambda s, d: stats.ledger(_ev(s, d)),
    "claims": lambda s, d: stats.claims(stats.ledger(_ev(s, d))),
    "opponent_adjustment": lambda s, d: stats.opponent_adjustment(stats.ledger(_ev(s, d))),
    "copress_edges": lambda s, d: stats.copress_edges(_ev(s, d)),
    "player_nodes": lambda s, d: stats.player_nodes(_kinds(s, d)),
    "zone_graph": lambda s, d: stats.zone_graph(_kinds(s, d)),
    "setpieces": lambda s, d: stats.setpieces(_kinds(s, d)),
    "results": lambda s, d: stats.results(_kinds(s, d)),
    "asof_calls": lambda s, d: stats.asof_calls(stats.results(_kinds(s, d))),
    "league_chain": lambda s, d: _rounded(chain.league_chain(season.once(_counts(s, d))).drop("season")),
    "team_chains": lambda s, d: _rounded(chain.team_chains(season.once(_counts(s, d)), KAPPA)),
    "style_distances": style_distances,
    "team_zones": team_zones,
    "team_threats": team_threats,
    "region_flows": lambda s, d: _flows(s, d).withColumn("flow", F.round("flow", 6)),
    "strongest_links": lambda s, d: season.strongest_links(_flows(s, d)),
    "leaks": lambda s, d: season.leaks(_flows(s, d)),
    "entry_lanes": entry_lanes,
    "matchup_outlook": matchup_outlook,
    "reidentification": reidentification,
    "style_map": lambda s, d: season.scaled(style_distances(s, d)),
    "kappa_scores": lambda s, d: chain.kappa_scores(season.once(_counts(s, d))).drop("season"),
    "team_values": team_values,
    "result_chances": result_chances,
    "lockbox_matches": lockbox_matches,
    "eligible_teams": eligible_teams,
}

QUERIES |= {
    "claim_intervals": lambda s, d: scoring.claim_intervals(stats.ledger(_ev(s, d))),
    "loo_predictions": lambda s, d: scoring.loo_predictions(stats.results(_kinds(s, d))),
    "audit_scores": lambda s, d: scoring.audit_scores(scoring.loo_predictions(stats.results(_kinds(s, d)))),
    "pooled_skill": lambda s, d: scoring.pooled_skill(stats.asof_calls(stats.results(_kinds(s, d)))),
    "ranked_scores": lambda s, d: scoring.ranked_scores(result_chances(s, d), stats.results(_kinds(s, d))),
    "calibration": lambda s, d: scoring.calibration(scoring.ranked_scores(result_chances(s, d), stats.results(_kinds(s, d)))),
    "fixture_halves": lambda s, d: scoring.fixture_halves(stats.results(_kinds(s, d))),
    "lane_baseline": lambda s, d: scoring.lane_baseline(stats.progressions(_ev(s, d))),
    "ppda": lambda s, d: people.ppda(stats.ledger(_ev(s, d))),
    "state_rates": lambda s, d: people.state_rates(value.action_values(_ev(s, d))),
    "entries": lambda s, d: people.entries(_ev(s, d)),
    "dependency": lambda s, d: people.dependency(_ev(s, d), stats.progressions(_ev(s, d))),
    "role_leaders": lambda s, d: people.role_leaders(_ev(s, d)),
    "level_table": lambda s, d: people.level_table(_ev(s, d)),
    "zone_means": lambda s, d: people.zone_means(_ev(s, d)),
    "matchup_chains": lambda s, d: _rounded(matchup.matchup_chains(season.once(_counts(s, d)), KAPPA)),
    "observed_lanes": lambda s, d: matchup.observed_lanes(_counts(s, d)),
    "entropy_rates": lambda s, d: matchup.entropy_rates(stats.zone_graph(_kinds(s, d))),
    "reciprocity": lambda s, d: matchup.reciprocity(stats.zone_graph(_kinds(s, d))),
    "similar_teams": lambda s, d: matchup.similar_teams(style_distances(s, d)),
    "graph_measures": lambda s, d: matchup.graph_measures(stats.zone_graph(_kinds(s, d))),
    "denial_plan": denial_plan,
}

QUERIES |= {
    "action_values": lambda s, d: value.action_values(_ev(s, d)).where("action is not null").select("event_id", "action", *(F.round(c, 9).alias(c) for c in ("v_start", "v_end", "value"))),
    "season_ledger": lambda s, d: _season_ledger(s, d),
    "season_claims": lambda s, d: stats.claims(_season_ledger(s, d), value.SEASON_CLAIMS),
    "season_claim_intervals": lambda s, d: scoring.claim_intervals(_season_ledger(s, d), table=value.SEASON_CLAIMS),
    "level_rates": lambda s, d: people.level_rates(_ev(s, d)),
    "selected_kappa": lambda s, d: chain.select_kappa(season.once(_counts(s, d))).drop("season"),
    "season_chains": lambda s, d: _rounded(_season_chains(s, d)),
    "season_distances": lambda s, d: style_distances(s, d, None),
    "season_similar_teams": lambda s, d: matchup.similar_teams(style_distances(s, d, None)),
    "season_values": season_values,
    "season_matchups": season_matchups,
    "season_denial_plan": lambda s, d: denial_plan(s, d, None),
    "result_calls": lambda s, d: stats.result_calls(stats.results(_kinds(s, d))),
    "result_call_scores": result_call_scores,
    "team_calls": team_calls,
    "lane_noise": lane_noise,
    "team_call_summary": lambda s, d: scoring.team_call_summary(team_calls(s, d).where("scored")),
    "result_call_calibration": lambda s, d: scoring.call_calibration(result_call_scores(s, d)),
}

LEAST_POSSESSIONS = 5  # the test events have some fifteen possessions for each team-match; the reference's twenty is the operator's default


def _table(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = _kinds(spark, sf_dir) if ev is None else ev
    return audit.season_table(season.once(stats.outcome_table(ev)), season.once(stats.start_table(ev)), least_possessions=LEAST_POSSESSIONS)


def _long(spark: SparkSession, sf_dir: str, features: tuple[str, ...] = audit.SQL_FEATURES) -> DataFrame:
    return season.once(audit.long_form(_table(spark, sf_dir), load(spark, sf_dir), features))


def _rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c) + pitch.NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.once(audit.asof(_long(spark, sf_dir)))


QUERIES |= {
    "season_table": lambda s, d: _rounded_all(_table(s, d)),
    "season_features": lambda s, d: _rounded_all(_table(s, d).drop(*audit.SOLVED_FEATURES)),
    "graph_feature_audit": lambda s, d: audit.audit(season.once(audit.loo(_long(s, d, audit.SOLVED_FEATURES)))),
    "graph_feature_skills": lambda s, d: audit.skills(season.once(audit.asof(_long(s, d, audit.SOLVED_FEATURES)))),
    "feature_calls": lambda s, d: _rounded_all(audit.asof(_long(s, d))),
    "feature_audit": lambda s, d: audit.audit(season.once(audit.loo(_long(s, d)))),
    "feature_skills": lambda s, d: audit.skills(_calls(s, d)),
    "team_call_shares": lambda s, d: audit.team_shares(_calls(s, d)),
    "pseudo_matches": lambda s, d: _rounded_all(audit.pseudo_matches(_long(s, d))),
    "rule_rows": lambda s, d: _rounded_all(audit.rule_rows(_calls(s, d)).drop("feature", "call", "ref")),
    "rule_premises": lambda s, d: audit.premises(season.once(audit.rule_rows(_calls(s, d)))),
    "pseudo_matches_asof": lambda s, d: _rounded_all(audit.pseudo_asof(_long(s, d)).drop("season")),
    "pooled_calls": lambda s, d: _rounded_all(_pooled(s, d)),
    "pooled_skills": lambda s, d: audit.skills(season.once(_pooled(s, d))),
    "setpiece_calls": lambda s, d: _rounded_all(audit.asof(_setpiece_long(s, d))),
    "setpiece_premises": lambda s, d: audit.premises(season.once(audit.rule_rows(season.once(audit.asof(_setpiece_long(s, d))), audit.SETPIECE_RULES))),
    "game_rule_premises": lambda s, d: audit.premises(season.once(_game_rules(s, d))),
    "instructions": lambda s, d: audit.instructions(_game_rules(s, d)).select("match_id", "team_id", "rule", "place", "departure", "held"),
}


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    return audit.asof(long, audit.pseudo_asof(long))


def _setpiece_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.once(audit.setpiece_form(stats.setpieces(_kinds(spark, sf_dir)), load(spark, sf_dir)))


def _all_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.once(audit.asof(_long(spark, sf_dir)).union(audit.asof(_setpiece_long(spark, sf_dir))))


def _game_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rule_rows(_all_calls(spark, sf_dir), audit.GAME_RULES, "usual")


LEAST_ACTIONS = 20  # players of the test events have some forty actions; the reference's 150 is the operators' default


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players.player_actions(_kinds(spark, sf_dir))


def _cells_of_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.once(players.player_cells(_acts(spark, sf_dir)))


def _missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = players.opponent_adjusted_rates(_acts(spark, sf_dir))
    return players.missed_matches(_cells_of_players(spark, sf_dir), rates, line_ups(load(spark, sf_dir)), LEAST_ACTIONS)


def _lineup_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    return players.lineup_calls(audit.asof(long), long, season.once(line_ups(load(spark, sf_dir))))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.action_values(_ev(spark, sf_dir))


QUERIES |= {
    "player_cells": lambda s, d: players.player_cells(_acts(s, d)),
    "removal_effects": lambda s, d: players.removal_effects(_cells_of_players(s, d), LEAST_ACTIONS),
    "opponent_adjusted_rates": lambda s, d: _rounded_all(players.opponent_adjusted_rates(_acts(s, d))),
    "missed_matches": _missed,
    "absence_summary": lambda s, d: players.absence_summary(season.once(_missed(s, d))),
    "line_ups": lambda s, d: line_ups(load(s, d)),
    "missing_regulars": lambda s, d: players.missing_regulars(line_ups(load(s, d)), load(s, d).select("match_id", "match_date").distinct()),
    "lineup_calls": lambda s, d: _rounded_all(_lineup_calls(s, d)),
    "lineup_skill_differences": lambda s, d: players.skill_differences(season.once(_lineup_calls(s, d))),
    "involvement": lambda s, d: players.involvement(_valued(s, d)),
    "passing_edges": lambda s, d: players.passing_edges(_valued(s, d)),
    "pressing_nodes": lambda s, d: players.pressing_nodes(_ev(s, d)),
    "press_starts": lambda s, d: players.press_starts(_ev(s, d)),
    "pressed_shares": lambda s, d: players.pressed_shares(players.press_starts(_ev(s, d))),
    "head_to_head": lambda s, d: players.head_to_head(load(s, d).withColumn("opp_id", F.expr("case when team_id = home_team_id then away_team_id else home_team_id end"))),
}

def _season_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.season_ledger(_kept_ev(spark, sf_dir))


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.claim_estimates(season.once(_season_ledger(spark, sf_dir)), value.SEASON_CLAIMS)


def _matchup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, starts, _, _ = _season(spark, sf_dir)
    return experiments.matchup_rows(counts, starts, KAPPA, least_possessions=LEAST_POSSESSIONS)


def _link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, starts, _, _ = _season(spark, sf_dir)
    return experiments.link_rows(counts, LEAST_POSSESSIONS, starts)


def team_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.season_pages(_kept_ev(spark, sf_dir)).select("team_id", "page")


QUERIES |= {
    "team_pages": team_pages,
    "claim_estimates": _estimates,
    "half_agreement": lambda s, d: reliability.half_agreement(_estimates(s, d)),
    "matchup_rows": lambda s, d: _rounded_all(_matchup_rows(s, d)),
    "matchup_summary": lambda s, d: experiments.matchup_summary(season.once(_matchup_rows(s, d))),
    "link_rows": _link_rows,
    "link_slopes": lambda s, d: experiments.link_slopes(_link_rows(s, d)),
    "denial_agreement": lambda s, d: experiments.denial_agreement(_link_rows(s, d), denial_plan(s, d)),
}

def _asof(spark: SparkSession, sf_dir: str) -> tuple[replay.AsOf, DataFrame]:
    """Running sums before each date, and all fixtures."""
    ev = season.once(_kinds(spark, sf_dir))
    dates = ev.select("match_id", "match_date").distinct()
    counts, starts = (season.once(df.join(dates, "match_id")) for df in (stats.outcome_table(ev), stats.start_table(ev)))
    return replay.AsOf(counts, starts), replay.fixtures(ev)


def _plans(spark: SparkSession, sf_dir: str) -> tuple[replay.AsOf, DataFrame]:
    asof, games = _asof(spark, sf_dir)
    return asof, season.once(replay.match_plans(asof, games))


def _rounded_plan(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, 6)).alias(c) if t == "array<double>" else F.col(c) for c, t in df.dtypes))


QUERIES |= {
    "asof_chains": lambda s, d: _rounded_all(_asof(s, d)[0].chains()),
    "match_plans": lambda s, d: _rounded_plan(_plans(s, d)[1]),
    "plan_outcomes": lambda s, d: _rounded_plan(replay.plan_outcomes(*_plans(s, d))),
    "plan_summary": lambda s, d: _rounded_plan(replay.plan_summary(season.once(replay.plan_outcomes(*_plans(s, d))))),
    "plan_players": lambda s, d: _rounded_all(_plan_players(s, d)),
    "instruction_texts": lambda s, d: audit.instruction_texts(audit.instructions(_game_rules(s, d)), season.once(_plan_players(s, d))),
    "followed_instructions": lambda s, d: _followed(s, d),
}


def _plan_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    asof, games = _asof(spark, sf_dir)
    return replay.plan_players(asof, load(spark, sf_dir), games, players.starters(line_ups(load(spark, sf_dir))))


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level play of the season table's team-matches."""
    ev = _kept_ev(spark, sf_dir)
    table, dates = season.once(_table(spark, sf_dir, ev)), season.once(ev.select("match_id", "match_date").distinct())
    levels = season.once(people.level_rates(ev).join(table.select("match_id", "team_id"), ["match_id", "team_id"], "left_semi"))
    long = audit.long_form(levels, dates, audit.LEVEL_FEATURES)
    weights = levels.groupBy("match_id").agg(F.max("level_minutes").alias("weight"))
    calls = season.once(audit.asof(season.once(audit.long_form(table, dates, audit.SQL_FEATURES))))
    return audit.followed(calls, season.once(audit.asof(long)), weights)


def _link_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Counts, starts, use of links, units with an outcome, and the links that are tested."""
    ev = _kinds(spark, sf_dir)
    counts, starts = season.once(stats.outcome_table(ev)), season.once(stats.start_table(ev))
    use, units = season.once(experiments.link_use(counts)), season.once(experiments.outcome_rows(counts, starts, LEAST_POSSESSIONS))
    return counts, starts, use, units, season.once(fits.tested_links(use, units))


def _joint(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts, starts, use, units, links = _link_units(spark, sf_dir)
    return season.once(fits.joint_slopes(use, units, links)), season.once(fits.league_drops(counts, starts, links))


def _gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, starts, use, units, links = _link_units(spark, sf_dir)
    excess = season.once(fits.excess_terms(counts, starts, units, KAPPA))
    one = lambda name, tested: fits.gamma_test(use, units, links, excess, tested).select(F.lit(name).alias("term"), "*")
    return one("primary", fits.PRIMARY).union(one("secondary", fits.SECONDARY))


QUERIES |= {
    "tested_links": lambda s, d: _rounded_all(_link_units(s, d)[4]),
    "link_effects": lambda s, d: fits.link_effects(*_joint(s, d)),
    "rank_agreement": lambda s, d: fits.rank_agreement(*_joint(s, d)),
    "gamma_test": _gamma,
    "value_holdout": lambda s, d: _rounded_all(holdout.holdout(with_season(_ev(s, d)))),
    "monotone_share": lambda s, d: _rounded_all(holdout.monotone_share(value.grid_values(_kinds(s, d)))),
    "shot_fit": lambda s, d: fits.shot_fit(load(s, d)),
    "pass_fit": lambda s, d: fits.pass_fit(season.once(fits.pass_rows(_snapshots(s, d), load(s, d)))),
}


FRAME_COLUMNS = ["match_id", "event_id", "idx", "type", "possession", "team_id", "possession_team_id", "x", "y"]


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = season.kept(load(spark, sf_dir).select(*FRAME_COLUMNS), "events")
    return geometry.snapshots(ev, *freeze_frames(ev))


def pass_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = routing.available(_snapshots(spark, sf_dir))
    best = F.get("options", F.lit(0))
    return o.select("match_id", "event_id", F.col("mates").cast("long").alias("mates"), F.size("options").cast("long").alias("options"), F.round(best["threat"], 6).alias("threat"), F.round(F.get("options", F.lit(1))["threat"], 6).alias("second"))


QUERIES |= {
    "shape_features": lambda s, d: _rounded_all(geometry.features(_snapshots(s, d))),
    "pass_options": pass_options,
    "frame_routes": lambda s, d: _rounded_all(routing.frame_routes(_snapshots(s, d))),
    "short_routes": lambda s, d: _rounded_all(routing.frame_routes(_snapshots(s, d), 2)),
    "load_bearing": lambda s, d: _rounded_plan(routing.load_bearing(_snapshots(s, d))),
}

ORACLE: dict[str, str] = _ORACLE | _CALLS | _SEASON | _AUDIT | _PLAYERS | _TRUST | _REPLAY
