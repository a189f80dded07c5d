"""DuckDB equivalents of solved chains, style, flows and match-ups, over the prefix of `oracle`: kappa is 30."""

from __future__ import annotations

from ..functions import pitch
from ..operators import matchup, season
from .oracle import BASE, Z

N = pitch.ZONES
CZ = f""",
st AS (SELECT match_id, team_id, opp_id, {Z('px', 'py')} AS z0, count(*) AS n FROM (SELECT match_id, team_id, opp_id, possession, arg_min(x, idx) AS px, arg_min(y, idx) AS py FROM e WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL),
sided AS (SELECT 'attack' AS side, match_id, team_id, z0, "out", n, xg FROM ot UNION ALL SELECT 'conceded', match_id, opp_id, z0, "out", n, xg FROM ot),
starts AS (SELECT 'attack' AS side, match_id, team_id, z0, n FROM st UNION ALL SELECT 'conceded', match_id, opp_id, z0, n FROM st),
zn AS (SELECT CAST(range AS INT) AS z0 FROM range({N})),
lz AS (SELECT z0, coalesce(g, 0e0) AS g, coalesce(coalesce(ns, 0) / (SELECT sum(n) FROM st), 1e0 / {N}) AS start FROM zn LEFT JOIN (SELECT z0, sum(xg) / sum(n) AS g FROM ot WHERE "out" = {pitch.SHOT} GROUP BY z0) USING (z0)
    LEFT JOIN (SELECT z0, sum(n) AS ns FROM st GROUP BY z0) USING (z0)),
tm AS (SELECT DISTINCT side, team_id FROM sided),
zs AS (SELECT side, team_id, z0, (coalesce(xg, 0) + {season.KAPPA_XG} * g) / (coalesce(shots, 0) + {season.KAPPA_XG}) AS g, (coalesce(ns, 0) + 30 * start) / sum(coalesce(ns, 0) + 30 * start) OVER (PARTITION BY side, team_id) AS start
    FROM tm CROSS JOIN lz LEFT JOIN (SELECT side, team_id, z0, sum(xg) AS xg, sum(n) AS shots FROM sided WHERE "out" = {pitch.SHOT} GROUP BY ALL) USING (side, team_id, z0) LEFT JOIN (SELECT side, team_id, z0, sum(n) AS ns FROM starts GROUP BY ALL) USING (side, team_id, z0)
    UNION ALL SELECT 'league', {season.LEAGUE}, z0, g, start FROM lz),
cl AS (SELECT side, team_id, z0, "out", (coalesce(n, 0) + 30 * p) / (sum(coalesce(n, 0)) OVER (PARTITION BY side, team_id, z0) + 30) AS p
    FROM tm CROSS JOIN lg LEFT JOIN (SELECT side, team_id, z0, "out", CAST(sum(n) AS BIGINT) AS n FROM sided GROUP BY ALL) USING (side, team_id, z0, "out") UNION ALL SELECT 'league', {season.LEAGUE}, z0, "out", p FROM lg)"""


def solve(cells: str, zones: str, keys: str, name: str) -> str:
    """CTE `name` (keys, z0, g, start, value, visits) by 400 rounds of both fixed points."""
    k = keys.split(", ")
    on = f"USING ({keys})"
    return f""",
{name}_r AS (SELECT {keys}, z0, list(p ORDER BY "out") FILTER ("out" < {N}) AS line, sum(p) FILTER ("out" = {pitch.SHOT}) AS s FROM {cells} GROUP BY {keys}, z0),
{name}_c AS (SELECT {keys}, "out", list(p ORDER BY z0) AS line FROM {cells} WHERE "out" < {N} GROUP BY {keys}, "out"),
{name}_m AS (SELECT * FROM (SELECT {keys}, list(line ORDER BY z0) AS m, list(s * g ORDER BY z0) AS b, list(start ORDER BY z0) AS st FROM {name}_r JOIN {zones} USING ({keys}, z0) GROUP BY {keys})
    JOIN (SELECT {keys}, list(line ORDER BY "out") AS t FROM {name}_c GROUP BY {keys}) {on}),
{name}_i(step, {keys}, v, u) AS (SELECT 0, {keys}, b, st FROM {name}_m UNION ALL SELECT step + 1, {", ".join(f"{name}_m.{x}" for x in k)}, list_transform(range(1, {N + 1}), lambda i: b[i] + list_inner_product(m[i], v)),
    list_transform(range(1, {N + 1}), lambda i: st[i] + list_inner_product(t[i], u)) FROM {name}_i JOIN {name}_m ON {" AND ".join(f"{name}_i.{x} = {name}_m.{x}" for x in k)} WHERE step < 400),
{name} AS (SELECT {keys}, z0, g, start, v[z0 + 1] AS value, u[z0 + 1] AS visits FROM (SELECT * FROM {name}_i WHERE step = 400) JOIN {zones} {on})"""


SOLVED = BASE + CZ + solve("cl", "zs", "side, team_id", "sv")
REGION = lambda z: f"(CASE WHEN {z} < 10 THEN 0 WHEN {z} < 20 THEN 1 ELSE 2 END * 5 + {z} % 5)"
FLOW = SOLVED + f""", fl AS (SELECT side, team_id, CAST({REGION('z0')} AS INT) AS r0, CAST({REGION('"out"')} AS INT) AS r1, sum(visits * p) AS flow FROM cl JOIN sv USING (side, team_id, z0) WHERE "out" < {N} GROUP BY ALL),
fu AS (SELECT f.*, l.flow AS usual FROM fl f LEFT JOIN (SELECT r0, r1, flow FROM fl WHERE side = 'league') l USING (r0, r1) WHERE side <> 'league' AND r0 <> r1)"""
LANES = f"""(SELECT a.z0, b.z0 AS "out", {pitch.lane(matchup.middle_crossing('a.z0', 'b.z0'))} AS lane FROM zn a, zn b WHERE a.z0 < 20 AND b.z0 >= 20)"""


def lanes(cells: str, solved: str, keys: str, name: str) -> str:
    return f""",
{name}_n AS (SELECT {keys}, lane, sum(visits * p) AS n FROM {cells} JOIN {LANES} USING (z0, "out") JOIN {solved} USING ({keys}, z0) GROUP BY ALL),
{name} AS (SELECT {keys}, lane, coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY {keys}), 0), 2e-1) AS share FROM (SELECT DISTINCT {keys}, CAST(range AS INT) AS lane FROM {solved}, range(5)) LEFT JOIN {name}_n USING ({keys}, lane))"""


RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN least(greatest({a} / {b}, {matchup.CLIP[0]}), {matchup.CLIP[1]}) ELSE 1 END"
PAIRS = SOLVED + f""",
fx AS (SELECT DISTINCT team_id, opp_id FROM ot),
mc AS (SELECT team_id, opp_id, z0, "out", p / sum(p) OVER (PARTITION BY team_id, opp_id, z0) AS p FROM (SELECT f.team_id, f.opp_id, a.z0, a."out", a.p * {RATIO('b.p', 'l.p')} AS p
    FROM fx f JOIN cl a ON a.side = 'attack' AND a.team_id = f.team_id JOIN cl b ON b.side = 'conceded' AND b.team_id = f.opp_id AND b.z0 = a.z0 AND b."out" = a."out" JOIN cl l ON l.side = 'league' AND l.z0 = a.z0 AND l."out" = a."out")),
mz AS (SELECT team_id, opp_id, z0, g, w / sum(w) OVER (PARTITION BY team_id, opp_id) AS start FROM (SELECT f.team_id, f.opp_id, a.z0, a.g * {RATIO('b.g', 'l.g')} AS g, a.start * {RATIO('b.start', 'l.start')} AS w
    FROM fx f JOIN zs a ON a.side = 'attack' AND a.team_id = f.team_id JOIN zs b ON b.side = 'conceded' AND b.team_id = f.opp_id AND b.z0 = a.z0 JOIN zs l ON l.side = 'league' AND l.z0 = a.z0))""" + solve("mc", "mz", "team_id, opp_id", "ms")
DISTANCES = SOLVED + """, vw AS (SELECT side, team_id, z0, greatest(visits, 0) / sum(greatest(visits, 0)) OVER (PARTITION BY side, team_id) AS w FROM sv),
ca AS (SELECT team_id, z0, "out", p, w FROM cl JOIN vw USING (side, team_id, z0) WHERE side = 'attack'),
dj AS (SELECT a.team_id AS team_a, b.team_id AS team_b, (a.w + b.w) / 2 AS w, a.p AS p, b.p AS q, (a.p + b.p) / 2 AS m FROM ca a JOIN ca b ON a.z0 = b.z0 AND a."out" = b."out" AND a.team_id < b.team_id),
di AS (SELECT team_a, team_b, round(sum(w * (CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2), 6) AS distance FROM dj GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "team_zones": SOLVED + " SELECT side, team_id, z0, " + ", ".join(f"round({c} + {pitch.NUDGE}, 6) AS {c}" for c in ("g", "start", "value", "visits")) + " FROM sv",
    "team_threats": SOLVED + " SELECT side, team_id, round(sum(start * value), 6) AS threat FROM sv GROUP BY ALL",
    "region_flows": FLOW + " SELECT side, team_id, r0, r1, round(flow, 6) AS flow FROM fl",
    "strongest_links": FLOW + " SELECT side, team_id, r0, r1, place, round(flow, 6) AS flow, round(flow / nullif(usual, 0), 6) AS vs_league FROM (SELECT *, CAST(row_number() OVER (PARTITION BY side, team_id ORDER BY round(flow, 9) DESC, r0, r1) AS INT) AS place FROM fu) WHERE place <= 10",
    "leaks": FLOW + " SELECT team_id, r0, r1, place, round(flow, 6) AS flow, round(flow - coalesce(usual, 0), 6) AS excess FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team_id ORDER BY round(flow - coalesce(usual, 0), 9) DESC, r0, r1) AS INT) AS place FROM fu WHERE side = 'conceded') WHERE place <= 5",
    "entry_lanes": SOLVED + lanes("cl", "sv", "side, team_id", "el") + " SELECT side, team_id, lane, round(share, 6) AS share FROM el",
    "matchup_outlook": PAIRS + lanes("mc", "ms", "team_id, opp_id", "el") + lanes("cl", "sv", "side, team_id", "eo") + """, t AS (SELECT team_id, opp_id, sum(start * value) AS threat FROM ms GROUP BY ALL), u AS (SELECT team_id, sum(start * value) AS usual FROM sv WHERE side = 'attack' GROUP BY ALL)
        SELECT el.team_id, el.opp_id, el.lane, round(el.share, 6) AS share, round(eo.share, 6) AS own_share, round(threat, 6) AS threat, round(threat / nullif(usual, 0) - 1, 6) AS vs_usual
        FROM el JOIN eo ON eo.side = 'attack' AND eo.team_id = el.team_id AND eo.lane = el.lane JOIN t ON t.team_id = el.team_id AND t.opp_id = el.opp_id JOIN u ON u.team_id = el.team_id""",
    "style_distances": DISTANCES + " SELECT * FROM di",
    "similar_teams": DISTANCES + """, b AS (SELECT team_a, team_b, distance FROM di UNION ALL SELECT team_b, team_a, distance FROM di),
        r AS (SELECT team_a AS team_id, team_b AS other, CAST(row_number() OVER (PARTITION BY team_a ORDER BY distance, team_b) AS INT) AS place, distance FROM b) SELECT * FROM r WHERE place <= 3""",
}
