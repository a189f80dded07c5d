"""DuckDB equivalents of chains as of a date and of freeze frames, over the prefix of `oracle`."""

from __future__ import annotations

from ..functions import pitch
from ..operators import fits, geometry, replay, routing
from .oracle import BASE

DATED = BASE + """,
md AS (SELECT DISTINCT match_id, match_date FROM ev),
od AS (SELECT ot.*, match_date FROM ot JOIN md USING (match_id)),
sd AS (SELECT 'attack' AS side, team_id, match_id, match_date, z0, "out", n FROM od UNION ALL SELECT 'conceded', opp_id, match_id, match_date, z0, "out", n FROM od),
td AS (SELECT DISTINCT side, team_id, match_date FROM sd),
ac AS (SELECT t.side, t.team_id, t.match_date, z0, "out", CAST(sum(n) AS BIGINT) AS n FROM td t JOIN sd s ON s.side = t.side AND s.team_id = t.team_id AND s.match_date < t.match_date GROUP BY ALL),
np AS (SELECT t.side, t.team_id, t.match_date, count(DISTINCT match_id) AS n_prior FROM td t JOIN sd s ON s.side = t.side AND s.team_id = t.team_id AND s.match_date < t.match_date GROUP BY ALL),
la AS (SELECT d.match_date, z0, "out", CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT match_date FROM od) d JOIN od s ON s.match_date < d.match_date GROUP BY ALL)"""

_limits = {r.split("_")[0]: k for r, _, _, k in replay.ROLES}
_region = lambda z: replay.REGION.format(z=z)
PLAYERS = DATED + f""",
ra AS ({" UNION ALL ".join(f"SELECT '{r}' AS role, team_id, match_date, CAST({p} AS BIGINT) AS player_id FROM ev WHERE {c} AND {p} IS NOT NULL" for r, c, p, _ in replay.ROLES)}),
fx AS (SELECT DISTINCT match_id, match_date, home_team_id AS team_id, away_team_id AS opp_id FROM ev UNION SELECT DISTINCT match_id, match_date, away_team_id, home_team_id FROM ev),
rd AS (SELECT team_id, match_date FROM np WHERE n_prior >= {replay.LEAST_PRIOR} GROUP BY ALL HAVING count(*) = 2),
sl AS (SELECT team_id AS opp_id, match_date, CASE WHEN coalesce(sum(n) FILTER ({_region('z0')} = 13 AND {_region('"out"')} = 12 AND "out" < {pitch.ZONES}), 0) > coalesce(sum(n) FILTER ({_region('z0')} = 11 AND {_region('"out"')} = 12 AND "out" < {pitch.ZONES}), 0) THEN 'right' ELSE 'left' END AS lever_side FROM ac WHERE side = 'attack' GROUP BY ALL),
rf AS (SELECT fx.*, lever_side FROM fx JOIN sl USING (opp_id, match_date) WHERE (team_id, match_date) IN (SELECT (team_id, match_date) FROM rd) AND (opp_id, match_date) IN (SELECT (team_id, match_date) FROM rd)),
pz1 AS (SELECT f.match_id, f.team_id, f.opp_id, f.lever_side, w.who, r.role, r.player_id, CASE WHEN w.who = 'our' THEN f.team_id ELSE f.opp_id END AS side_id, count(*) AS n
    FROM rf f CROSS JOIN (VALUES ('our'), ('their')) w(who) JOIN ra r ON r.team_id = CASE WHEN w.who = 'our' THEN f.team_id ELSE f.opp_id END AND r.match_date < f.match_date GROUP BY ALL),
pz2 AS (SELECT *, n / sum(n) OVER (PARTITION BY match_id, team_id, who, role) AS share FROM pz1),
pk AS (SELECT match_id, team_id, opp_id, who, split_part(role, '_', 1) AS role, player_id, n, share, side_id FROM pz2 WHERE (NOT contains(role, '_') OR split_part(role, '_', 2) = lever_side)
    AND split_part(role, '_', 1) IN (SELECT unnest(CASE WHEN who = 'our' THEN {list(replay.OURS)} ELSE {list(replay.THEIRS)} END))),
xi AS (SELECT match_id, team_id, list(player_id) AS eleven FROM (SELECT match_id, team_id, player_id, row_number() OVER (PARTITION BY match_id, team_id ORDER BY min(idx), player_id) AS place FROM ev WHERE player_id % 10 = team_id GROUP BY match_id, team_id, player_id) WHERE place <= 11 GROUP BY ALL),
pn AS (SELECT pk.*, row_number() OVER (PARTITION BY pk.match_id, pk.team_id, who, role ORDER BY n DESC, player_id) AS place FROM pk LEFT JOIN xi ON xi.match_id = pk.match_id AND xi.team_id = side_id WHERE eleven IS NULL OR list_contains(eleven, player_id))
SELECT match_id, team_id, opp_id, who, role, CAST(place AS INT) AS place, player_id, n, round(share + {pitch.NUDGE}, 6) AS share FROM pn WHERE place <= CASE role {" ".join(f"WHEN '{r}' THEN {k}" for r, k in _limits.items())} END"""

PLAYER = geometry.PASS
#: Chance of a pass from (ax, ay) to (bx, ty) of event e, by rows of pressure of each defender.
_chance = lambda lane, near, length: f"1 / (1 + exp(-({PLAYER[0]} + {PLAYER[1]} * {lane} + {PLAYER[2]} * {near} + {PLAYER[3]} * {length} + {PLAYER[4]} * {length} * {length} / 100)))"
_goal = lambda x, y: f"least(greatest(exp({geometry.SHOT[0]} + {geometry.SHOT[1]} * sqrt(pow({x} - 120, 2) + pow({y} - 40, 2)) + {geometry.SHOT[2]} * abs({y} - 40)), 1e-6), 0.999)"


def passes(segments: str, name: str) -> str:
    """CTE of the chance p of each segment (event_id, i, j, ax, ay, bx, ty) against the event's defenders."""
    at = "least(greatest(((dx - ax) * (bx - ax) + (dy - ay) * (ty - ay)) / greatest(pow(bx - ax, 2) + pow(ty - ay, 2), 1e-9), 0), 1)"
    return f""",
{name}_d AS (SELECT g.*, d.x AS dx, d.y AS dy FROM {segments} g JOIN de d USING (event_id)),
{name}_t AS (SELECT *, {at} AS t FROM {name}_d),
{name} AS (SELECT event_id, i, j, {_chance(f"sum(exp(-0.5 * pow(sqrt(pow(dx - ax - t * (bx - ax), 2) + pow(dy - ay - t * (ty - ay), 2)) / {geometry.LANE_SIGMA}, 2)))",
    f"exp(-0.5 * pow(min(sqrt(pow(dx - bx, 2) + pow(dy - ty, 2))) / {geometry.RECEPTION_SIGMA}, 2))", "sqrt(pow(max(bx - ax), 2) + pow(max(ty - ay), 2))")} AS p, {_goal("max(bx)", "max(ty)")} AS g FROM {name}_t GROUP BY event_id, i, j)"""


FRAMES = BASE + """,
nx AS (SELECT match_id, event_id, team_id, possession_team_id, x, y, list({'team_id': team_id, 'event_id': event_id, 'x': x, 'y': y}) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS near FROM ev WHERE x IS NOT NULL),
sn AS (SELECT * FROM nx WHERE event_id % 6 = 0 AND team_id = possession_team_id),
pl AS (SELECT match_id, event_id, i, p.team_id = team_id AS mate, p.event_id % 11 = 0 AS keeper, CASE WHEN p.team_id = team_id THEN p.x ELSE 120 - p.x END AS x, CASE WHEN p.team_id = team_id THEN p.y ELSE 80 - p.y END AS y
    FROM (SELECT match_id, event_id, team_id, unnest(range(1, len(near) + 1)) AS i, unnest(near) AS p FROM sn)),
de AS (SELECT * FROM pl WHERE NOT mate),
ss AS (SELECT match_id, event_id, x, y FROM sn WHERE event_id IN (SELECT event_id FROM de))"""

SHAPE = FRAMES + """,
ou AS (SELECT * FROM de WHERE NOT keeper),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY -x, y) AS place FROM ou) WHERE place <= 4),
bg AS (SELECT event_id, CASE WHEN count(*) >= 2 THEN max(gap) ELSE 80 END AS max_lateral_gap, avg(x) AS line_height, 120 - max(x) AS space_behind FROM (SELECT *, y - lag(y) OVER (PARTITION BY event_id ORDER BY y) AS gap FROM bk) GROUP BY event_id),
og AS (SELECT event_id, CASE WHEN count(*) >= 2 THEN max(gap) ELSE 120 END AS between_lines_gap, max(x) - min(x) AS block_depth, max(y) - min(y) AS block_width FROM (SELECT *, x - lag(x) OVER (PARTITION BY event_id ORDER BY x) AS gap FROM ou) GROUP BY event_id),
rt AS (SELECT s.event_id, avg(CAST((o.y - 40) * (s.y - 40) >= 0 AS DOUBLE)) AS ballside_ratio FROM ss s JOIN ou o USING (event_id) GROUP BY s.event_id),
dg AS (SELECT s.event_id, count(*) FILTER (d.x > s.x) AS goalside, min(sqrt(pow(d.x - s.x, 2) + pow(d.y - s.y, 2))) AS nearest, count(*) FILTER (d.x >= 102 AND abs(d.y - 40) <= 22) AS box, count(*) AS seen,
    sum(exp(-0.5 * pow(sqrt(pow(d.x - s.x - t * (120 - s.x), 2) + pow(d.y - s.y - t * (40 - s.y), 2)) / """ + str(geometry.LANE_SIGMA) + """, 2))) AS lane
    FROM ss s JOIN (SELECT d.*, least(greatest(((d.x - s.x) * (120 - s.x) + (d.y - s.y) * (40 - s.y)) / greatest(pow(120 - s.x, 2) + pow(40 - s.y, 2), 1e-9), 0), 1) AS t FROM de d JOIN ss s USING (event_id)) d USING (event_id) GROUP BY s.event_id),
am AS (SELECT s.event_id, count(*) FILTER (m.x > s.x) AS ahead, count(m.i) AS seen FROM ss s LEFT JOIN (SELECT * FROM pl WHERE mate) m USING (event_id) GROUP BY s.event_id),
sf AS (SELECT s.match_id, s.event_id, line_height, space_behind, block_depth, block_width, max_lateral_gap, between_lines_gap, ballside_ratio, goalside AS defenders_goalside, nearest AS nearest_defender, lane AS lane_to_goal, box AS box_defenders,
    ahead AS attackers_goalside, ahead - goalside AS overload, dg.seen + am.seen + 1 AS n_visible, og.event_id IS NOT NULL AS held FROM ss s JOIN dg USING (event_id) JOIN am USING (event_id) LEFT JOIN bg USING (event_id) LEFT JOIN og USING (event_id) LEFT JOIN rt USING (event_id))"""
_shape = ("line_height", "space_behind", "block_depth", "block_width", "max_lateral_gap", "between_lines_gap", "ballside_ratio", "defenders_goalside", "nearest_defender", "lane_to_goal", "box_defenders", "attackers_goalside", "overload", "n_visible")

OPTIONS = FRAMES + """,
vs AS (SELECT s.*, greatest(x - 40, -1) AS lo, least(x + 70, 121) AS hi, event_id % 10 <> 0 OR event_id % 4 <> 2 AS known FROM ss s),
mt AS (SELECT p.event_id, i, p.x, p.y FROM pl p JOIN vs v USING (event_id) WHERE mate AND known AND p.x >= lo AND p.x < hi),
s1 AS (SELECT event_id, i, 0 AS j, v.x AS ax, v.y AS ay, m.x AS bx, m.y AS ty FROM mt m JOIN vs v USING (event_id)),
s2 AS (SELECT event_id, a.i, b.i AS j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS ty FROM mt a JOIN mt b USING (event_id) WHERE a.i <> b.i)""" + passes("s1", "p1") + passes("s2", "p2") + f""",
al AS (SELECT event_id, 2 AS hops, a.p * b.p * b.g AS threat FROM p2 b JOIN p1 a USING (event_id, i)),
op AS (SELECT event_id, hops, threat FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY threat DESC) AS place FROM al) WHERE place <= {routing.MOST_PAIRS}
    UNION ALL SELECT event_id, 1, p * g FROM p1 UNION ALL SELECT event_id, 0, {_goal("x", "y")} FROM vs WHERE event_id IN (SELECT event_id FROM mt)),
oo AS (SELECT event_id, count(*) AS options, max(threat) FILTER (place = 1) AS threat, max(threat) FILTER (place = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY threat DESC) AS place FROM op) GROUP BY event_id)"""

SHOTS = BASE + """,
sq AS (SELECT ln(least(greatest(xg, 1e-4), 1)) AS y, sqrt(pow(x - 120, 2) + pow(y - 40, 2)) AS a, abs(y - 40) AS b FROM ev WHERE type = 'Shot' AND coalesce(sub_type, '') <> 'Penalty' AND xg IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
sm AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM sq),
sb AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM sm)"""
# Links, their use and the units that have an outcome; the test data's least number of possessions is 5.
LINKS = BASE + f""",
st AS (SELECT match_id, team_id, count(*) AS n FROM (SELECT DISTINCT match_id, team_id, possession FROM e WHERE kind IS NOT NULL) GROUP BY ALL),
ux AS (SELECT o.match_id, o.team_id, o.opp_id, o.xg, n AS p FROM (SELECT match_id, team_id, opp_id, sum(xg) AS xg FROM ot GROUP BY ALL) o JOIN st USING (match_id, team_id) WHERE n >= 5),
uy AS (SELECT *, (sum(xg) OVER a - xg) / nullif(sum(p) OVER a - p, 0) AS made, (sum(xg) OVER b - xg) / nullif(sum(p) OVER b - p, 0) AS allowed, (sum(xg) OVER () - sum(xg) OVER m) / nullif(sum(p) OVER () - sum(p) OVER m, 0) AS league FROM ux WINDOW a AS (PARTITION BY team_id), b AS (PARTITION BY opp_id), m AS (PARTITION BY match_id)),
un AS (SELECT match_id, team_id FROM uy WHERE xg / p / nullif(made * (allowed / nullif(league, 0)), 0) IS NOT NULL),
lm AS (SELECT match_id, team_id, {_region('z0')} AS r0, {_region('"out"')} AS r1, sum(n) AS n FROM ot WHERE "out" < {pitch.ZONES} GROUP BY ALL),
lt AS (SELECT *, sum(total) OVER (PARTITION BY team_id) - total AS rest FROM (SELECT match_id, team_id, sum(n) AS total FROM lm GROUP BY ALL)),
lk AS (SELECT team_id, r0, r1, sum(n) AS every FROM lm WHERE r0 <> r1 GROUP BY ALL),
lu AS (SELECT k.r0, k.r1, (every - coalesce(m.n, 0)) / nullif(rest, 0) AS usual FROM un JOIN lt USING (match_id, team_id) JOIN lk k ON k.team_id = un.team_id LEFT JOIN lm m ON m.match_id = un.match_id AND m.team_id = un.team_id AND m.r0 = k.r0 AND m.r1 = k.r1)
SELECT CAST(row_number() OVER (ORDER BY r0, r1) - 1 AS INT) AS k, CAST(r0 AS INT) AS r0, CAST(r1 AS INT) AS r1, round(s + {pitch.NUDGE}, 6) AS usage FROM (SELECT r0, r1, sum(usual) / (SELECT count(*) FROM un) AS s FROM lu GROUP BY ALL) WHERE s >= {fits.LINK_LEAST}"""

ORACLE: dict[str, str] = {
    "shot_fit": SHOTS + f" SELECT name, round(value + {pitch.NUDGE}, 6) AS value FROM (SELECT 'intercept' AS name, my - p * ma - q * mb AS value FROM sb UNION ALL SELECT 'distance', p FROM sb UNION ALL SELECT 'lateral', q FROM sb)",
    "tested_links": LINKS,
    "plan_players": PLAYERS,
    "asof_chains": DATED + f""", lp AS (SELECT match_date, z0, "out", (n + CASE WHEN "out" = {pitch.LOSS} THEN 1 ELSE 0 END) / (sum(n) OVER (PARTITION BY match_date, z0) + 1) AS pl FROM la)
        SELECT side, team_id, match_date, z0, "out", n, round((n + {replay.KAPPA} * pl) / (rows_n + {replay.KAPPA}) + {pitch.NUDGE}, 6) AS p, n_prior FROM (SELECT *, sum(n) OVER (PARTITION BY side, team_id, match_date, z0) AS rows_n FROM ac) JOIN lp USING (match_date, z0, "out") JOIN np USING (side, team_id, match_date) WHERE n_prior >= {replay.LEAST_PRIOR}""",
    "shape_features": SHAPE + " SELECT match_id, event_id, " + ", ".join(f"CASE WHEN held THEN round(CAST({c} AS DOUBLE) + {pitch.NUDGE}, 6) END AS {c}" for c in _shape) + " FROM sf",
    "pass_options": OPTIONS + " SELECT match_id, event_id, coalesce(m, 0) AS mates, coalesce(options, 0) AS options, round(threat, 6) AS threat, round(second, 6) AS second FROM vs LEFT JOIN oo USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS m FROM mt GROUP BY event_id) USING (event_id)",
}
