"""DuckDB equivalents of the registered queries, over one shared prefix that adapts and enriches `events`."""

from __future__ import annotations

from ..functions import pitch
from ..operators.chain import KAPPAS
from ..operators.stats import CLAIMS
from ..operators.value import GRID, NX, NY, PRIOR_LOSSES, SEASON_CLAIMS, WON
from ..sources import adapters

Z, L = pitch.zone, pitch.lane

BASE = f"""
WITH RECURSIVE raw AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, user_id % 10 AS t0 FROM events),
opp AS (SELECT *, CASE WHEN t0 = 9 THEN day % 9 WHEN ((2 * (day % 9) - t0) % 9 + 9) % 9 = t0 THEN 9 ELSE ((2 * (day % 9) - t0) % 9 + 9) % 9 END AS o0 FROM raw),
m AS (SELECT *, least(t0, o0) AS lo, greatest(t0, o0) AS hi, day * 100 + least(t0, o0) AS match_id FROM opp),
o AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts, event_id) AS idx,
    coalesce(CAST(t0 <> lag(t0) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS INT), 1) AS change FROM m),
ev AS (SELECT match_id, event_id, CAST(idx AS BIGINT) AS idx, CASE WHEN (day + lo) % 2 = 0 THEN lo ELSE hi END AS home_team_id, CASE WHEN (day + lo) % 2 = 0 THEN hi ELSE lo END AS away_team_id,
    CAST(DATE '2024-01-01' + CAST(day AS INT) AS DATE) AS match_date, CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period,
    {adapters.SECONDS} AS period_seconds, CAST(floor({adapters.SECONDS} / 60) AS BIGINT) + CASE WHEN hour(ts) < 12 THEN 0 ELSE 45 END AS minute, {adapters.TYPE} AS type,
    CAST(sum(change) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS possession, t0 AS possession_team_id,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN o0 ELSE t0 END AS team_id, user_id AS player_id,
    CAST(k AS DOUBLE) * 12 / 10 AS x, CAST(c % 8000 AS DOUBLE) / 100 AS y,
    CASE WHEN event_type IN ('view', 'signup', 'click') THEN CAST((event_id * 37 + k) % 100 AS DOUBLE) * 12 / 10 END AS end_x,
    CASE WHEN event_type IN ('view', 'signup', 'click') THEN CAST((c * 7 + event_id * 13) % 8000 AS DOUBLE) / 100 END AS end_y,
    CASE WHEN {adapters.TYPE} = 'Shot' THEN CAST(c % 100 AS DOUBLE) / 200 END AS xg, {adapters.OUTCOME} AS outcome, {adapters.SUB_TYPE} AS sub_type, {adapters.PATTERN} AS play_pattern,
    {adapters.RECIPIENT} AS recipient_id, {adapters.POSITION} AS position, event_id % 3 = 0 AS under_pressure FROM o),
f AS (SELECT *, {pitch.KIND} AS kind, {pitch.ACTION} AS action, CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opp_id, team_id = possession_team_id AS in_possession,
    period * 10000 + period_seconds AS clock, {pitch.RESTART} AS restart, {pitch.PHASE} AS phase, {pitch.BUCKET} AS bucket,
    team_id = possession_team_id AND type = 'Shot' AS is_shot, {pitch.GOAL} AS is_goal, team_id = possession_team_id AND x IS NOT NULL AS begun FROM ev),
e AS (SELECT *, {pitch.TRANSITION} AS transition FROM (SELECT *, coalesce(sum(CASE WHEN is_shot THEN xg END) OVER aft, 0) AS xg_after, coalesce(bool_or(is_shot AND coalesce(outcome, '') = 'Goal') OVER aft, false) AS goal_after,
    arg_min(x, idx) FILTER (begun) OVER al AS pos_start_x, arg_min(type, idx) FILTER (begun) OVER al AS pos_first_type, coalesce(sum(CASE WHEN is_shot THEN xg END) OVER al, 0) AS pos_xg, coalesce(bool_or(is_shot) OVER al, false) AS pos_shot,
    clock - min(clock) FILTER (begun) OVER al AS pos_seconds,
    CAST(coalesce(sum(CASE WHEN is_goal AND team_id = home_team_id THEN 1 ELSE 0 END) OVER bef, 0) AS BIGINT) AS home_goals, CAST(coalesce(sum(CASE WHEN is_goal AND team_id = away_team_id THEN 1 ELSE 0 END) OVER bef, 0) AS BIGINT) AS away_goals
    FROM f WINDOW aft AS (PARTITION BY match_id, possession ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    al AS (PARTITION BY match_id, possession ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), bef AS (PARTITION BY match_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
ot AS (SELECT match_id, team_id, opp_id, {Z('x', 'y')} AS z0, CASE kind WHEN 'move' THEN {Z('end_x', 'end_y')} WHEN 'shot' THEN {pitch.SHOT} ELSE {pitch.LOSS} END AS "out",
    count(*) AS n, round(coalesce(sum(CASE WHEN kind = 'shot' THEN xg END), 0), 6) AS xg FROM e WHERE kind IS NOT NULL GROUP BY ALL),
pr AS (SELECT match_id, possession, team_id, min(idx) FILTER ({pitch.crosses(40)}) AS idx_mid, arg_min({pitch.crossing_lane(40)}, idx) FILTER ({pitch.crosses(40)}) AS lane_mid,
    min(idx) FILTER ({pitch.crosses(80)}) AS idx_final, arg_min({pitch.crossing_lane(80)}, idx) FILTER ({pitch.crosses(80)}) AS lane_final, arg_min(player_id, idx) FILTER ({pitch.crosses(80)}) AS player_final,
    round(max(xg_after), 6) AS xg, bool_or(action = 'shot') AS shot, arg_min(x, idx) < 40 AS deep FROM e WHERE action IS NOT NULL GROUP BY ALL),
prog AS (SELECT * FROM pr WHERE idx_mid IS NOT NULL OR idx_final IS NOT NULL),
one AS (SELECT match_id, team_id, opp_id, count(*) FILTER (type = 'Pass') AS passes, count(*) FILTER (type = 'Pass' AND action IS NOT NULL AND restart IS NULL) AS open_passes,
    count(*) FILTER (type = 'Pass' AND action IS NOT NULL AND restart IS NULL AND sqrt((end_x - x) * (end_x - x) + (end_y - y) * (end_y - y)) > 35) AS long_passes, count(*) FILTER (type = 'Pass' AND x < 72) AS passes_low,
    count(*) FILTER ({pitch.DEFENSIVE} AND x > 48) AS def_actions, round(coalesce(sum(xg) FILTER (kind = 'shot'), 0), 6) AS xg, count(*) FILTER (kind = 'shot') AS shots FROM e GROUP BY ALL),
po AS (SELECT match_id, team_id, possession, arg_min(x, idx) AS x0, max(end_x) FILTER (action = 'move') AS reach, arg_min(pos_seconds, idx) FILTER ({pitch.crosses(80)}) AS es,
    arg_min({pitch.crossing_lane(80)}, idx) FILTER ({pitch.crosses(80)}) AS el, bool_or({pitch.crosses(80)}) AS entered FROM e WHERE action IS NOT NULL GROUP BY ALL),
two AS (SELECT match_id, team_id, count(*) FILTER (x0 < 40) AS deep, count(*) FILTER (x0 < 40 AND reach >= 80) AS deep_reached, count(*) FILTER (entered) AS entries,
    count(*) FILTER (entered AND es <= 10) AS entries_fast, count(*) FILTER (entered AND el IN (0, 4)) AS entries_wide FROM po GROUP BY ALL),
ps AS (SELECT match_id, team_id, count(*) AS press_starts, round(sum(px), 6) AS press_x FROM (SELECT match_id, team_id, possession, arg_min(x, clock * 100000 + idx) AS px FROM e WHERE type = 'Pressure' AND NOT in_possession GROUP BY ALL) GROUP BY ALL),
l1 AS (SELECT one.*, coalesce(deep, 0) AS deep, coalesce(deep_reached, 0) AS deep_reached, coalesce(entries, 0) AS entries, coalesce(entries_fast, 0) AS entries_fast, coalesce(entries_wide, 0) AS entries_wide,
    coalesce(press_starts, 0) AS press_starts, coalesce(press_x, 0) AS press_x FROM one LEFT JOIN two USING (match_id, team_id) LEFT JOIN ps USING (match_id, team_id)),
led AS (SELECT a.*, coalesce(b.passes, 0) AS opp_passes, coalesce(b.passes_low, 0) AS opp_passes_low, coalesce(b.xg, 0) AS opp_xg, coalesce(b.entries, 0) AS opp_entries, coalesce(b.entries_wide, 0) AS opp_entries_wide
    FROM l1 a LEFT JOIN l1 b ON a.match_id = b.match_id AND a.opp_id = b.team_id),
cells AS (SELECT CAST(a.range AS INT) AS z0, CAST(b.range AS INT) AS "out" FROM range({pitch.ZONES}) a, range({pitch.ZONES + 2}) b),
lg AS (SELECT z0, "out", (coalesce(n, 0) + CASE WHEN "out" = {pitch.LOSS} THEN 1 ELSE 0 END) / sum(coalesce(n, 0) + CASE WHEN "out" = {pitch.LOSS} THEN 1 ELSE 0 END) OVER (PARTITION BY z0) AS p
    FROM cells LEFT JOIN (SELECT z0, "out", CAST(sum(n) AS BIGINT) AS n FROM ot GROUP BY ALL) USING (z0, "out")),
tc AS (SELECT team_id, z0, "out", (coalesce(n, 0) + 30 * p) / (sum(coalesce(n, 0)) OVER (PARTITION BY team_id, z0) + 30) AS p
    FROM (SELECT DISTINCT team_id FROM ot) CROSS JOIN lg LEFT JOIN (SELECT team_id, z0, "out", CAST(sum(n) AS BIGINT) AS n FROM ot GROUP BY ALL) USING (team_id, z0, "out")),
res AS (SELECT match_id, match_date, team_id, opp_id, team_id = home_team_id AS home, count(*) FILTER ({pitch.GOAL}) AS goals,
    round(coalesce(sum(xg) FILTER (type = 'Shot' AND coalesce(sub_type, '') <> 'Penalty'), 0), 6) AS xg FROM e WHERE period <= 4 GROUP BY ALL),
ad AS (SELECT r.*, (SELECT sum(q.xg) / count(*) FROM res q WHERE q.match_date < r.match_date) AS league, (SELECT coalesce(sum(q.xg), 0) FROM res q WHERE q.team_id = r.team_id AND q.match_date < r.match_date) AS so,
    (SELECT count(*) FROM res q WHERE q.team_id = r.team_id AND q.match_date < r.match_date) AS no, (SELECT coalesce(sum(q.xg), 0) FROM res q WHERE q.opp_id = r.opp_id AND q.match_date < r.match_date) AS sa,
    (SELECT count(*) FROM res q WHERE q.opp_id = r.opp_id AND q.match_date < r.match_date) AS na FROM res r),
calls AS (SELECT match_id, team_id, round(xg, 6) AS actual, round(league, 9) AS league, round((so + 5 * league) / (no + 5), 9) AS own, round((sa + 5 * league) / (na + 5), 9) AS against,
    round((so + 5 * league) / (no + 5) + (sa + 5 * league) / (na + 5) - league, 9) AS call, CAST(no AS BIGINT) AS n_prior FROM ad WHERE league IS NOT NULL),
sides AS (SELECT h.match_id, h.goals AS home_goals, a.goals AS away_goals, greatest(h.xg, 5e-2) AS home_rate, greatest(a.xg, 5e-2) AS away_rate FROM res h JOIN res a ON h.match_id = a.match_id AND h.home AND NOT a.home)
"""

# Values of the 192 zones by 400 rounds of V = s g + M V, and what actions add to them.
CELL = lambda v, size, n: f"least(greatest(floor({v} / ({size} / {n}.0)), 0), {n - 1})"
CELLS = lambda x, y: f"CAST(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {CELL(x, '120e0', NX)} * {NY} + {CELL(y, '80e0', NY)} END AS INT)"
VALUED = f""",
ga AS (SELECT {CELLS('x', 'y')} AS z0, CASE kind WHEN 'move' THEN {CELLS('end_x', 'end_y')} WHEN 'shot' THEN {GRID} ELSE {GRID + 1} END AS z1, CASE WHEN kind = 'shot' THEN xg END AS xg FROM e WHERE kind IS NOT NULL),
gc AS (SELECT z0, z1, count(*) AS n, round(coalesce(sum(xg), 0), 6) AS xg FROM ga WHERE z0 IS NOT NULL AND z1 IS NOT NULL GROUP BY ALL),
gn AS (SELECT z0, sum(n) + {PRIOR_LOSSES} AS t, coalesce(sum(n) FILTER (z1 = {GRID}), 0) AS shots, sum(xg) AS xg FROM gc GROUP BY z0),
gr AS (SELECT CAST(a.range AS INT) AS z0, CAST(b.range AS INT) AS z1 FROM range({GRID}) a, range({GRID}) b),
gm AS (SELECT z0, list(coalesce(n / t, 0e0) ORDER BY z1) AS line FROM gr LEFT JOIN gc USING (z0, z1) LEFT JOIN gn USING (z0) GROUP BY z0),
gb AS (SELECT list(line ORDER BY z0) AS m, list(coalesce(CASE WHEN shots > 0 THEN shots / t * (xg / shots) END, 0e0) ORDER BY z0) AS b FROM gm LEFT JOIN gn USING (z0)),
gv(step, v) AS (SELECT 0, b FROM gb UNION ALL SELECT step + 1, list_transform(range(1, {GRID + 1}), lambda i: b[i] + list_inner_product(m[i], v)) FROM gv, gb WHERE step < 400),
av AS (SELECT *, CASE action WHEN 'move' THEN v_end - v_start WHEN 'shot' THEN coalesce(xg, 0) - v_start WHEN 'turnover' THEN -v_start END AS value FROM (SELECT e.*, CASE WHEN action IS NOT NULL THEN v[{CELLS('x', 'y')} + 1] END AS v_start,
    CASE WHEN action IS NOT NULL THEN v[{CELLS('end_x', 'end_y')} + 1] END AS v_end FROM e, (SELECT v FROM gv WHERE step = 400)))"""
THREAT = VALUED + f""",
th AS (SELECT match_id, team_id, round(coalesce(sum(greatest(value, 0)), 0), 6) AS threat, round(coalesce(sum(greatest(value, 0)) FILTER (transition), 0), 6) AS threat_transition, round(coalesce(sum(greatest(value, 0)) FILTER (bucket = '60-90+'), 0), 6) AS threat_late
    FROM av WHERE action IS NOT NULL GROUP BY ALL),
wn AS (SELECT match_id, team_id, count(*) FILTER ({WON}) AS recoveries, count(*) FILTER ({WON} AND x >= 80) AS recoveries_high FROM e GROUP BY ALL),
sl AS (SELECT led.*, {", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in ("threat", "threat_transition", "threat_late"))}, recoveries, recoveries_high, {", ".join(f"coalesce(b.{c}, 0) AS opp_{c}" for c in ("threat", "threat_transition", "threat_late"))}
    FROM led LEFT JOIN th a USING (match_id, team_id) LEFT JOIN wn USING (match_id, team_id) LEFT JOIN th b ON b.match_id = led.match_id AND b.team_id = led.opp_id)"""

EVENTS = "match_id, event_id, idx, home_team_id, away_team_id, match_date, period, period_seconds, minute, type, possession, possession_team_id, team_id, player_id, x, y, end_x, end_y, xg, outcome, sub_type, play_pattern, recipient_id, position, under_pressure"
CLAIM_ROWS = " UNION ALL ".join(f"SELECT team_id, '{k}' AS claim, CAST({n} AS DOUBLE) AS num, CAST({d} AS DOUBLE) AS den FROM led" for k, n, d in CLAIMS)
SEASON_ROWS = " UNION ALL ".join(f"SELECT team_id, '{k}' AS claim, CAST({n} AS DOUBLE) AS num, CAST({d} AS DOUBLE) AS den FROM sl" for k, n, d in SEASON_CLAIMS)
SHOT = "type = 'Shot' AND coalesce(sub_type, '') <> 'Penalty'"
SP = f"{SHOT} AND play_pattern IN ('From Corner', 'From Free Kick')"

KAPPA = BASE + f', c AS (SELECT team_id, match_id, z0, "out", CAST(sum(n) AS BIGINT) AS n FROM ot GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY team_id, z0, "out") - n AS rest, sum(n) OVER (PARTITION BY team_id, z0) - sum(n) OVER (PARTITION BY team_id, match_id, z0) AS tot FROM c), k AS (SELECT unnest([{", ".join(map(str, KAPPAS))}]) AS kappa) SELECT CAST(kappa AS INT) AS kappa, round(sum(n * ln(greatest((rest + kappa * p) / (tot + kappa), 1e-12))) / sum(n), 6) AS loglik FROM d JOIN lg USING (z0, "out") CROSS JOIN k GROUP BY kappa'
PIECES = f"SELECT match_id, team_id, count(*) FILTER (type = 'Pass' AND sub_type = 'Corner') AS corners, count(*) FILTER (sub_type = 'Free Kick' AND type IN ('Pass', 'Shot') AND x >= 80) AS att_free_kicks, count(*) FILTER ({SP}) AS sp_shots, round(coalesce(sum(xg) FILTER ({SP}), 0), 6) AS sp_xg, round(round(coalesce(sum(xg) FILTER ({SP}), 0), 6) / nullif(sum(xg) FILTER ({SHOT}), 0), 6) AS sp_xg_share, round(count(*) FILTER ({SHOT} AND play_pattern = 'From Corner') / nullif(count(*) FILTER (type = 'Pass' AND sub_type = 'Corner'), 0), 6) AS shots_per_corner FROM e WHERE period <= 4 GROUP BY match_id, team_id"
ORACLE: dict[str, str] = {
    "match_events": BASE + f"SELECT {EVENTS} FROM ev",
    "enriched_events": BASE + "SELECT event_id, kind, restart, phase, bucket, round(xg_after, 6) AS xg_after, goal_after, pos_start_x, pos_first_type, round(pos_xg, 6) AS pos_xg, pos_shot, pos_seconds, transition, home_goals, away_goals FROM e",
    "outcome_table": BASE + 'SELECT match_id, team_id, opp_id, z0, "out", n, xg FROM ot',
    "outcome_totals": BASE + 'SELECT z0, "out", CAST(sum(n) AS BIGINT) AS n, round(sum(xg), 5) AS xg FROM ot GROUP BY ALL',
    "start_table": BASE + f"SELECT match_id, team_id, opp_id, {Z('px', 'py')} AS z0, count(*) AS n FROM (SELECT match_id, team_id, opp_id, possession, arg_min(x, idx) AS px, arg_min(y, idx) AS py FROM e WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    "progressions": BASE + "SELECT * FROM prog",
    "route_table": BASE + "SELECT team_id, lane_mid, lane_final, count(*) AS n, round(avg(CAST(shot AS DOUBLE)), 6) AS shot_rate, round(avg(xg), 9) AS mean_xg, round(count(*) / sum(count(*)) OVER (PARTITION BY team_id), 6) AS share FROM prog WHERE lane_mid IS NOT NULL AND lane_final IS NOT NULL GROUP BY team_id, lane_mid, lane_final",
    "lane_shares": BASE + ', k AS (SELECT t.team_id, CAST(r.range AS INT) AS lane FROM (SELECT DISTINCT team_id FROM prog) t, range(5) r), c AS (SELECT team_id, lane_final AS lane, count(*) AS n FROM prog WHERE lane_final IS NOT NULL GROUP BY ALL) SELECT team_id, lane, coalesce(n, 0) AS n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY team_id), 0), 6) AS share FROM k LEFT JOIN c USING (team_id, lane)',
    "ledger": BASE + "SELECT * FROM led",
    "claims": BASE + f", c AS (SELECT team_id, claim, round(sum(num) / nullif(sum(den), 0), 6) AS value FROM ({CLAIM_ROWS}) GROUP BY ALL) SELECT team_id, claim, value, CAST(rank() OVER (PARTITION BY claim ORDER BY value DESC) AS INT) AS rank, count(*) OVER (PARTITION BY claim) AS \"of\", round(quantile_cont(value, 0.5) OVER (PARTITION BY claim), 6) AS median FROM c WHERE value IS NOT NULL",
    "action_values": BASE + VALUED + " SELECT event_id, action, round(v_start, 9) AS v_start, round(v_end, 9) AS v_end, round(value, 9) AS value FROM av WHERE action IS NOT NULL",
    "season_ledger": BASE + THREAT + " SELECT * FROM sl",
    "season_claims": BASE + THREAT + f", c AS (SELECT team_id, claim, round(sum(num) / nullif(sum(den), 0), 6) AS value FROM ({SEASON_ROWS}) GROUP BY ALL) SELECT team_id, claim, value, CAST(rank() OVER (PARTITION BY claim ORDER BY value DESC) AS INT) AS rank, count(*) OVER (PARTITION BY claim) AS \"of\", round(quantile_cont(value, 0.5) OVER (PARTITION BY claim), 6) AS median FROM c WHERE value IS NOT NULL",
    "opponent_adjustment": BASE + ", w AS (SELECT opp_id, xg, (sum(xg) OVER (PARTITION BY team_id) - xg) / nullif(count(xg) OVER (PARTITION BY team_id) - 1, 0) AS els FROM led) SELECT opp_id AS team_id, round(avg(xg - els), 9) AS adjustment, count(els) AS n FROM w GROUP BY opp_id",
    "copress_edges": BASE + ", p AS (SELECT match_id, possession, team_id, clock, player_id FROM e WHERE type = 'Pressure') SELECT a.team_id, least(a.player_id, b.player_id) AS p, greatest(a.player_id, b.player_id) AS q, count(*) AS n FROM p a JOIN p b ON a.match_id = b.match_id AND a.possession = b.possession AND a.team_id = b.team_id AND b.clock > a.clock AND b.clock - a.clock <= 2 AND a.player_id <> b.player_id GROUP BY ALL",
    "player_nodes": BASE + "SELECT team_id, player_id, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y FROM e WHERE action IS NOT NULL GROUP BY ALL",
    "zone_graph": BASE + f"SELECT team_id, {pitch.region('x', 'y')} AS r0, {pitch.region('end_x', 'end_y')} AS r1, count(*) AS n FROM e WHERE kind = 'move' GROUP BY ALL",
    "setpieces": BASE + PIECES,
    "results": BASE + "SELECT * FROM res",
    "asof_calls": BASE + "SELECT * FROM calls",
    "league_chain": BASE + 'SELECT z0, "out", round(p + 1e-10, 6) AS p FROM lg',
    "team_chains": BASE + 'SELECT team_id, z0, "out", round(p + 1e-10, 6) AS p FROM tc',
    "kappa_scores": KAPPA,
    "season_chains": BASE + f""", kp AS (SELECT kappa FROM ({KAPPA}) ORDER BY loglik DESC, kappa LIMIT 1),
        sc AS (SELECT team_id, z0, "out", (coalesce(n, 0) + kappa * p) / (sum(coalesce(n, 0)) OVER (PARTITION BY team_id, z0) + kappa) AS p FROM (SELECT DISTINCT team_id FROM ot) CROSS JOIN lg CROSS JOIN kp LEFT JOIN (SELECT team_id, z0, "out", sum(n) AS n FROM ot GROUP BY ALL) USING (team_id, z0, "out"))
        SELECT team_id, z0, "out", round(p + 1e-10, 6) AS p FROM sc""",
    "selected_kappa": "SELECT kappa FROM (" + KAPPA + ") ORDER BY loglik DESC, kappa LIMIT 1",  # all teams of the test events have enough matches
    "result_chances": BASE + ", g AS (SELECT match_id, CAST(i.range AS INT) AS i, CAST(j.range AS INT) AS j, exp(-home_rate) * pow(home_rate, i.range) / factorial(CAST(i.range AS INT)) * exp(-away_rate) * pow(away_rate, j.range) / factorial(CAST(j.range AS INT)) AS p FROM sides, range(13) i, range(13) j) SELECT match_id, round(sum(p) FILTER (i > j) / sum(p), 6) AS home, round(sum(p) FILTER (i = j) / sum(p), 6) AS draw, round(sum(p) FILTER (i < j) / sum(p), 6) AS away FROM g GROUP BY match_id",
    "lockbox_matches": BASE + "SELECT match_id, md5(CAST(match_id AS VARCHAR)) AS digest, substr(md5(CAST(match_id AS VARCHAR)), 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS lockbox FROM (SELECT DISTINCT match_id FROM ev)",
    "eligible_teams": BASE + ", t AS (SELECT home_team_id AS team_id, match_id FROM ev UNION SELECT away_team_id, match_id FROM ev) SELECT team_id, count(*) AS matches FROM t GROUP BY team_id HAVING count(*) >= 5",
}
