"""DuckDB equivalents of features, as-of calls, skills and rules, over the prefixes of `oracle` and `oracle_season`."""

from __future__ import annotations

from ..functions import pitch
from ..operators import audit, scoring
from ..operators.matchup import _middle, middle_crossing
from .oracle import BASE
from .oracle import PIECES
from .oracle_calls import W
from .oracle_season import CZ

REPS, P = 100, scoring.PSEUDO
OUT = 'least("out", 29)'
SQL = lambda e: e.replace("(out % 5)", f"({OUT} % 5)")
NAMES = audit.SQL_FEATURES
_per = ", ".join(f"sum({n}) AS n_{k}" for k, n in audit.PER_START)
TABLE = BASE + CZ + f""",
gx AS (SELECT *, {_middle(OUT, 'x')} - x0 AS dx, {audit.REGION.format(z='z0')} AS r0, {audit.REGION.format(z=OUT)} AS r1, CASE WHEN move AND x0 < 80 AND {_middle(OUT, 'x')} >= 80 THEN {pitch.lane(middle_crossing('z0', OUT, 80))} END AS entry
    FROM (SELECT *, "out" < {pitch.ZONES} AS move, "out" = {pitch.SHOT} AS shot, "out" = {pitch.LOSS} AS loss, {_middle('z0', 'x')} AS x0 FROM ot)),
fa AS (SELECT match_id, team_id, opp_id, {", ".join(f"coalesce(sum(n) FILTER (entry = {k}), 0) / nullif(sum(n) FILTER (entry IS NOT NULL), 0) AS entry_{name}" for k, name in enumerate(audit.ENTRY))},
    {", ".join(f"sum({SQL(n)}) / nullif(sum({SQL(d)}), 0) AS {k}" for k, n, d in audit.PLAIN)}, {_per}, sum(CASE WHEN move THEN n ELSE 0 END) AS moves FROM gx GROUP BY ALL),
fs AS (SELECT match_id, team_id, sum(n) AS starts, sum(n * {_middle('z0', 'x')}) / sum(n) AS start_height FROM st GROUP BY ALL),
rm AS (SELECT match_id, team_id, r0, r1, sum(n) AS n FROM gx WHERE move GROUP BY ALL),
en AS (SELECT match_id, team_id, -sum(n / t * log2(n / rw)) AS entropy_rate FROM (SELECT *, sum(n) OVER (PARTITION BY match_id, team_id, r0) AS rw, sum(n) OVER (PARTITION BY match_id, team_id) AS t FROM rm) GROUP BY ALL),
rc AS (SELECT match_id, team_id, 1 - sum(net) / sum(gross) AS reciprocity FROM (SELECT match_id, team_id, least(r0, r1) AS a, greatest(r0, r1) AS b, sum(n) AS gross, abs(sum(CASE WHEN r0 < r1 THEN n ELSE -n END)) AS net FROM rm WHERE r0 <> r1 GROUP BY ALL) GROUP BY ALL),
el AS (SELECT team_id FROM ot GROUP BY team_id HAVING count(DISTINCT match_id) >= 10),
ft AS (SELECT a.*, start_height, a.moves / nullif(a.moves + coalesce(b.moves, 0), 0) AS possession, {", ".join(f"a.n_{k} / nullif(starts, 0) AS {k}" for k, _ in audit.PER_START)}, entropy_rate, reciprocity
    FROM (SELECT {", ".join(f"fa.{c}" for c in ("match_id", "team_id", "opp_id", "moves"))}, {", ".join("fa.entry_" + e for e in audit.ENTRY)}, {", ".join(f"fa.{k}" for k, _, _ in audit.PLAIN)}, {", ".join(f"fa.n_{k}" for k, _ in audit.PER_START)} FROM fa) a
    JOIN fs USING (match_id, team_id) LEFT JOIN fa b ON b.match_id = a.match_id AND b.team_id = a.opp_id LEFT JOIN en ON en.match_id = a.match_id AND en.team_id = a.team_id LEFT JOIN rc ON rc.match_id = a.match_id AND rc.team_id = a.team_id
    WHERE starts >= 5 AND a.team_id IN (SELECT team_id FROM el) AND a.opp_id IN (SELECT team_id FROM el)),
lo AS ({" UNION ALL ".join(f"SELECT match_id, team_id, opp_id, '{k}' AS feature, CAST({k} AS DOUBLE) AS v FROM ft" for k in NAMES)}),
lf AS (SELECT lo.*, match_date FROM lo JOIN (SELECT DISTINCT match_id, match_date FROM ev) USING (match_id))"""
_past = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_mean = lambda side, k: f"(coalesce(sum(v) OVER {side}, 0) + {k} * league) / (count(v) OVER {side} + {k})"


def calls(long: str = "lf", name: str = "ao", own: str = str(P), against: str = str(P)) -> str:
    """CTE `name` of as-of calls over the long form `long`."""
    return f""",
dy_{name} AS (SELECT feature, match_date, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM (SELECT feature, match_date, date_diff('day', DATE '2000-01-01', match_date) AS day, count(v) AS n, sum(v) AS s, sum(v * v) AS q FROM {long} GROUP BY ALL) WINDOW w AS (PARTITION BY feature ORDER BY day {_past})),
lq_{name} AS (SELECT {long}.*, date_diff('day', DATE '2000-01-01', match_date) AS day, s / nullif(n, 0) AS league, sqrt(greatest(q / nullif(n, 0) - pow(s / nullif(n, 0), 2), 0)) AS league_sd FROM {long} JOIN dy_{name} USING (feature, match_date)),
{name} AS (SELECT *, own + against - league AS call, later AND n_prior >= 5 AS scored FROM (SELECT match_id, team_id, opp_id, feature, v AS actual, league, league_sd, {_mean('mine', own)} AS own, {_mean('theirs', against)} AS against, count(*) OVER mine AS n_prior,
    row_number() OVER (PARTITION BY feature, team_id ORDER BY match_date, match_id) - 1 >= floor(count(*) OVER (PARTITION BY feature, team_id) * 0.5) AS later FROM lq_{name}
    WINDOW mine AS (PARTITION BY feature, team_id ORDER BY day {_past}), theirs AS (PARTITION BY feature, opp_id ORDER BY day {_past})))"""


def estimated(side: str, name: str) -> str:
    """CTE `name` (feature, match_date, k): pseudo matches that earlier matches ask for."""
    return f""",
{name}_g AS (SELECT d.feature, d.match_date, p.{side} AS g, count(v) AS n, avg(v) AS m, var_samp(v) * (count(v) - 1) AS w FROM (SELECT DISTINCT feature, match_date FROM lf) d JOIN lf p ON p.feature = d.feature AND p.match_date < d.match_date WHERE v IS NOT NULL GROUP BY ALL HAVING count(v) >= 2),
{name}_f AS (SELECT feature, match_date, count(*) AS c, sum(w) / sum(n - 1) AS within, var_samp(m) - sum(w) / sum(n - 1) * avg(1e0 / n) AS tau FROM {name}_g GROUP BY ALL),
{name} AS (SELECT feature, match_date, coalesce(CASE WHEN c >= 3 AND tau > 0 AND within > 0 THEN least(greatest(within / tau, 1e0), 30e0) END, 30e0) AS k FROM (SELECT DISTINCT feature, match_date FROM lf) LEFT JOIN {name}_f USING (feature, match_date))"""


CALLS = TABLE + calls()
POOLED = TABLE + estimated("team_id", "ek") + estimated("opp_id", "eo") + ", lk AS (SELECT lf.*, ek.k AS k_own, eo.k AS k_opp FROM lf JOIN ek USING (feature, match_date) JOIN eo USING (feature, match_date))"
SETPIECES = f""",
sl AS ({PIECES}),
sx AS (SELECT a.*, b.team_id AS opp_id, match_date FROM sl a JOIN sl b ON a.match_id = b.match_id AND a.team_id <> b.team_id JOIN (SELECT DISTINCT match_id, match_date FROM ev) d ON d.match_id = a.match_id),
ls AS ({" UNION ALL ".join(f"SELECT match_id, team_id, opp_id, '{k}' AS feature, CAST({k} AS DOUBLE) AS v, match_date FROM sx" for k in audit.SETPIECE_FEATURES)})"""
PIECE_CALLS = BASE + SETPIECES + calls("ls")
GAME_CALLS = TABLE + SETPIECES + calls("lf", "a1") + calls("ls", "a2") + ", ao AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2)"
_ball, _flank = "type IN ('Pass', 'Carry', 'Shot', 'Dribble') AND x >= 80", f"(y < {pitch.LANE_EDGES[0]} OR y >= {pitch.LANE_EDGES[-1]})"
LEVEL = f""",
lv AS (SELECT * FROM (SELECT *, least(greatest(coalesce(period_seconds - lag(period_seconds) OVER (PARTITION BY match_id, period ORDER BY idx), 0), 0), 120) AS dt FROM e WHERE period <= 4) WHERE home_goals = away_goals),
lm AS (SELECT match_id, sum(dt) / 60 AS m FROM lv GROUP BY match_id),
lg1 AS (SELECT match_id, team_id, opp_id, coalesce(sum(xg) FILTER (type = 'Shot' AND coalesce(sub_type, '') <> 'Penalty'), 0) AS xg, count(*) FILTER (type = 'Pressure' AND x >= 80) AS press, count(*) FILTER (type = 'Pass') AS passes, count(*) FILTER (type = 'Pass' AND end_x - x >= 40) AS long,
    count(*) FILTER ({_ball}) AS final, count(*) FILTER ({_ball} AND {_flank}) AS wide, count(*) FILTER (type = 'Pass' AND outcome IS NULL AND end_x IS NOT NULL AND {pitch.region('x', 'y')} IN (11, 13) AND {pitch.region('end_x', 'end_y')} = 12) AS lever FROM lv GROUP BY ALL),
lr AS (SELECT a.match_id, a.team_id, a.opp_id, round(m, 6) AS level_minutes, CASE WHEN m >= 20 THEN round(a.press / nullif(b.passes, 0), 6) END AS press, CASE WHEN m >= 20 THEN round(a.long / nullif(a.passes, 0), 6) END AS long, CASE WHEN m >= 20 THEN round(a.wide / nullif(a.final, 0), 6) END AS width,
    CASE WHEN m >= 20 THEN round(a.lever / nullif(a.passes, 0), 6) END AS lever, CASE WHEN m >= 20 THEN round((a.xg - b.xg) * 90 / nullif(m, 0), 6) END AS xg_difference_90 FROM lg1 a JOIN lg1 b ON a.match_id = b.match_id AND a.opp_id = b.team_id JOIN lm ON lm.match_id = a.match_id)"""
LOO = TABLE + f""",
la AS (SELECT *, (sum(v) OVER (PARTITION BY feature) - coalesce(sum(v) OVER (PARTITION BY feature, match_id), 0)) / greatest(count(v) OVER (PARTITION BY feature) - count(v) OVER (PARTITION BY feature, match_id), 1) AS league FROM lf),
lb AS (SELECT match_id, feature, v AS actual, league, {", ".join(f"(coalesce(sum(v) OVER (PARTITION BY feature, {s}), 0) - coalesce(v, 0) + {P} * league) / (count(v) OVER (PARTITION BY feature, {s}) - CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END + {P}) AS {c}" for s, c in (("team_id", "team"), ("opp_id", "against")))} FROM la),
pt AS (SELECT *, team + against - league AS "both" FROM lb)"""


def errors(table: str, preds: tuple[str, ...], where: str) -> str:
    cols = ("league", *preds)
    return f""",
me AS (SELECT feature, match_id, count(*) AS n, {", ".join(f'sum(pow(actual - "{c}", 2)) AS "{c}"' for c in cols)} FROM {table} WHERE {where} AND actual IS NOT NULL AND league IS NOT NULL GROUP BY ALL),
mw AS (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {W} END AS w FROM me, (SELECT range AS rep FROM range({REPS + 1}))),
sr AS (SELECT feature, rep, CAST(sum(n) FILTER (rep = 0) AS BIGINT) AS n, {", ".join(f'sum(w * "{c}") AS "{c}"' for c in cols)} FROM mw GROUP BY ALL)"""


def interval(c: str) -> str:
    return f"max({c}) FILTER (rep = 0) AS {c}, quantile_cont({c}, 0.05) FILTER (rep > 0) AS {c}_lo, quantile_cont({c}, 0.95) FILTER (rep > 0) AS {c}_hi"


_n = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_nudged = lambda *cs: ", ".join(f"round({c} + {pitch.NUDGE}, 6) AS {c}" for c in cs)
_ends = lambda c: (c, f"{c}_lo", f"{c}_hi")


CALL_ROWS = f" SELECT match_id, team_id, opp_id, feature, {_nudged('actual', 'league', 'league_sd', 'own', 'call')}, CAST(n_prior AS BIGINT) AS n_prior, scored FROM ao"


def rules(table, reference: str, known: str = "s.actual IS NOT NULL") -> str:
    rows = ", ".join(f"('{r}', '{w}', '{f}', {d}, {k})" for k, (r, w, f, d) in enumerate(table))
    ref = "CASE WHEN who = 'we' THEN s.own ELSE s.call - s.own + s.league END" if reference == "usual" else "s.league"
    return f""",
rl AS (SELECT * FROM (VALUES {rows}) t(rule, who, feature, direction, position)),
rr AS (SELECT *, direction * (call - ref) / league_sd AS departure, direction * (call - ref) / league_sd >= {audit.THRESHOLD[reference]} AS fired, direction * (actual - ref) > 0 AS held
    FROM (SELECT u.match_id, u.team_id, u.opp_id, rule, position, direction, s.call, s.actual, s.league_sd, {ref} AS ref FROM ao u JOIN rl USING (feature) JOIN ao s ON s.match_id = u.match_id AND s.feature = u.feature AND s.team_id = CASE WHEN who = 'we' THEN u.team_id ELSE u.opp_id END
        WHERE u.scored AND s.call IS NOT NULL AND {known} AND s.league_sd > 0))"""


PREMISES = f""",
pm AS (SELECT rule, match_id, count(*) AS units, count(*) FILTER (fired) AS fires, count(*) FILTER (fired AND held) AS hits, count(*) FILTER (NOT fired AND held) AS quiet FROM rr GROUP BY ALL),
pw AS (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {W} END AS w FROM pm, (SELECT range AS rep FROM range({REPS + 1}))),
ps2 AS (SELECT rule, rep, CAST(sum(w * units) AS BIGINT) AS units, CAST(sum(w * fires) AS BIGINT) AS fires, CAST(sum(w * quiet) AS BIGINT) AS quiet, sum(w * hits) / nullif(sum(w * fires), 0) AS held_share FROM pw GROUP BY ALL),
pg AS (SELECT rule, max(fires) FILTER (rep = 0) AS fires, max(units) FILTER (rep = 0) AS units, max(quiet) FILTER (rep = 0) AS quiet, {interval("held_share")} FROM ps2 GROUP BY rule)
SELECT rule, fires, round(fires / nullif(units, 0), 6) AS fire_rate, {_n(*_ends("held_share"))}, round(quiet / nullif(units - fires, 0), 6) AS not_fired_share, coalesce(fires >= 100 AND held_share >= 0.6 AND held_share_lo > 0.5, false) AS holds FROM pg"""

FOLLOWED = TABLE + calls() + rules(tuple(r for r in audit.GAME_RULES if r[0] in {a[0] for a in audit.ACTIONS}), "usual", "true") + LEVEL + f""",
lt AS (SELECT lr.* FROM lr SEMI JOIN ft USING (match_id, team_id)),
ll AS (SELECT u.*, match_date FROM ({" UNION ALL ".join(f"SELECT match_id, team_id, opp_id, '{k}' AS feature, CAST({k} AS DOUBLE) AS v FROM lt" for k in audit.LEVEL_FEATURES)}) u JOIN (SELECT DISTINCT match_id, match_date FROM ev) USING (match_id))""" + calls("ll", "al") + f""",
ac AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{f}', '{w}', {d})" for r, f, w, d in audit.ACTIONS)}) t(rule, act, actor, way)),
fu AS (SELECT rr.match_id, rr.rule, rr.fired, way * (d.actual - d.own) > 0 AS did, o.actual - o.call AS ahead, level_minutes AS weight FROM rr JOIN ac USING (rule) JOIN al d ON d.match_id = rr.match_id AND d.feature = act AND d.team_id = CASE WHEN actor = 'we' THEN rr.team_id ELSE rr.opp_id END
    JOIN al o ON o.match_id = rr.match_id AND o.team_id = rr.team_id AND o.feature = '{audit.OUTCOME}' JOIN (SELECT match_id, max(level_minutes) AS level_minutes FROM lt GROUP BY match_id) w ON w.match_id = rr.match_id WHERE d.actual IS NOT NULL AND d.own IS NOT NULL AND o.actual - o.call IS NOT NULL AND level_minutes IS NOT NULL),
fw AS (SELECT fu.*, rep, CASE WHEN rep = 0 THEN 1 ELSE {W} END AS w FROM fu, (SELECT range AS rep FROM range(201))),
fm AS (SELECT rule, rep, fired, did, sum(w * weight * ahead) / nullif(sum(w * weight), 0) AS mean, count(*) AS n FROM fw GROUP BY ALL),
fg AS (SELECT rule, rep, max(mean) FILTER (fired AND did) - max(mean) FILTER (fired AND NOT did) AS gap_fired, max(mean) FILTER (NOT fired AND did) - max(mean) FILTER (NOT fired AND NOT did) AS gap_not FROM fm GROUP BY ALL),
fe AS (SELECT *, gap_fired - gap_not AS extra FROM fg),
fi AS (SELECT rule, {interval("gap_fired")}, {interval("gap_not")}, {interval("extra")} FROM fe GROUP BY rule),
fc AS (SELECT rule, count(*) FILTER (fired) AS fired, avg(CAST(did AS DOUBLE)) FILTER (fired) AS did_when_fired, avg(CAST(did AS DOUBLE)) FILTER (NOT fired) AS did_when_not FROM fu GROUP BY rule)
SELECT rule, fired, {_n("did_when_fired", "did_when_not", *_ends("gap_fired"), *_ends("gap_not"), *_ends("extra"))}, CASE WHEN extra_lo > 0 THEN 'supported' WHEN extra_hi < 0 THEN 'contradicted' ELSE 'no evidence either way' END AS verdict FROM fi JOIN fc USING (rule)"""

SKILLS = errors("ao", ("call", "own"), "scored AND call IS NOT NULL") + f""", x AS (SELECT *, 1 - call / nullif(league, 0) AS skill, (own - call) / nullif(league, 0) AS opponent_adds FROM sr), y AS (SELECT feature, max(n) AS n, {interval("skill")}, {interval("opponent_adds")} FROM x GROUP BY feature),
        z AS (SELECT feature, avg(CAST(abs(actual - call) < abs(actual - league) AS DOUBLE)) AS closer FROM ao WHERE scored AND actual IS NOT NULL AND call IS NOT NULL GROUP BY feature)
        SELECT feature, n, {_n(*_ends("skill"), *_ends("opponent_adds"), "closer")}, skill_lo > 0 AS holds FROM y JOIN z USING (feature)"""

ORACLE: dict[str, str] = {
    "rule_rows": CALLS + rules(audit.RULES, "league") + f" SELECT match_id, team_id, opp_id, rule, CAST(position AS INT) AS position, {_nudged('departure')}, fired, held FROM rr",
    "rule_premises": CALLS + rules(audit.RULES, "league") + PREMISES,
    "setpiece_calls": PIECE_CALLS + CALL_ROWS,
    "setpiece_premises": PIECE_CALLS + rules(audit.SETPIECE_RULES, "league") + PREMISES,
    "pseudo_matches_asof": POOLED + f" SELECT DISTINCT feature, match_date, {_nudged('k_own', 'k_opp')} FROM lk",
    "pooled_calls": POOLED + calls("lk", "ao", "k_own", "k_opp") + CALL_ROWS,
    "level_rates": BASE + LEVEL + " SELECT * FROM lr",
    "followed_instructions": FOLLOWED,
    "game_rule_premises": GAME_CALLS + rules(audit.GAME_RULES, "usual") + PREMISES,
    "instructions": GAME_CALLS + rules(audit.GAME_RULES, "usual") + " SELECT match_id, team_id, rule, place, round(departure, 6) AS departure, held FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, team_id ORDER BY round(departure, 9) DESC, position) AS INT) AS place FROM rr WHERE fired) WHERE place <= 4",
    "season_features": TABLE + f" SELECT match_id, team_id, opp_id, {_nudged(*NAMES)} FROM ft",
    "feature_calls": CALLS + CALL_ROWS,
    "feature_audit": LOO + errors("pt", ("team", "both"), "true") + f""", x AS (SELECT *, 1 - team / nullif(league, 0) AS r2_team, (team - "both") / nullif(league, 0) AS gain_opponent FROM sr), y AS (SELECT feature, max(n) AS n, {interval("r2_team")}, {interval("gain_opponent")} FROM x GROUP BY feature)
        SELECT feature, n, {_n(*_ends("r2_team"), *_ends("gain_opponent"))}, CASE WHEN r2_team >= {scoring.TIER_LEAD} AND r2_team_lo > 0 THEN 'lead' WHEN r2_team >= {scoring.TIER_USABLE} AND r2_team_lo > 0 THEN 'usable' ELSE 'drop' END AS tier, gain_opponent_lo > 0 AS opponent_matters FROM y""",
    "feature_skills": CALLS + SKILLS,
    "pooled_skills": POOLED + calls("lk", "ao", "k_own", "k_opp") + SKILLS,
    "team_call_shares": CALLS + """ SELECT team_id, count(DISTINCT match_id) AS games, round(avg(CAST(abs(actual - call) < abs(actual - league) AS DOUBLE)) FILTER (actual IS NOT NULL AND call IS NOT NULL), 6) AS closer FROM ao WHERE scored GROUP BY team_id HAVING count(DISTINCT match_id) >= 8""",
    "pseudo_matches": TABLE + f""", pg AS (SELECT feature, team_id, count(v) AS n, avg(v) AS m, var_samp(v) AS s2 FROM lf WHERE v IS NOT NULL GROUP BY ALL HAVING count(v) >= 2),
        pf AS (SELECT feature, count(*) AS c, sum(s2 * (n - 1)) / sum(n - 1) AS within, var_samp(m) - sum(s2 * (n - 1)) / sum(n - 1) * avg(1e0 / n) AS tau FROM pg GROUP BY feature)
        SELECT feature, round(coalesce(CASE WHEN c >= 3 AND tau > 0 AND within > 0 THEN least(greatest(within / tau, 1e0), 30e0) END, 30e0) + {pitch.NUDGE}, 6) AS k FROM (SELECT DISTINCT feature FROM lf) LEFT JOIN pf USING (feature)""",
}
