"""DuckDB equivalents of players, line-ups, passing and pressing, over the prefix of `oracle`."""

from __future__ import annotations

from ..functions import pitch
from ..operators import players
from ..sources import adapters
from .oracle import BASE, VALUED
from .oracle_audit import CALLS

ACTS = """, pa AS (SELECT match_id, possession, idx, team_id, opp_id, player_id, recipient_id, kind, coalesce(xg, 0) AS xg FROM e WHERE kind IS NOT NULL AND player_id IS NOT NULL AND NOT (kind = 'move' AND type = 'Carry'))"""
LINE = f""",
sn AS (SELECT match_id, team_id, player_id, min(idx) AS idx FROM ev WHERE player_id % 10 = team_id GROUP BY ALL),
lu AS (SELECT match_id, team_id, player_id, CASE WHEN idx IS NULL THEN '{adapters.UNUSED}' WHEN row_number() OVER (PARTITION BY match_id, team_id ORDER BY idx NULLS LAST, player_id) <= 11 THEN '{adapters.STARTED}' ELSE '{adapters.CAME_ON}' END AS positions
    FROM (SELECT DISTINCT team_id, player_id FROM sn) JOIN (SELECT DISTINCT team_id, match_id FROM sn) USING (team_id) LEFT JOIN sn USING (match_id, team_id, player_id)),
xi AS (SELECT match_id, team_id, list(DISTINCT player_id) AS eleven FROM lu WHERE contains(positions, 'Starting XI') GROUP BY ALL)"""
_weight = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 1e0 ELSE pow(len(list_intersect({a}, {b})) / {players.ELEVEN}, {players.POWER}) END"


def _side(key: str, eleven: str, name: str) -> str:
    return f"""{name} AS (SELECT match_id, team_id, feature, coalesce(sum(w * v), 0) AS s, coalesce(sum(w) FILTER (v IS NOT NULL), 0) AS d, CASE WHEN sum(w) > 0 THEN count(*) / sum(w) ELSE 1 END AS k
    FROM (SELECT t.match_id, t.team_id, t.feature, p.v, {_weight(f't.{eleven}', f'p.{eleven}')} AS w FROM nw t JOIN nw p ON t.feature = p.feature AND t.{key} = p.{key} AND p.match_date < t.match_date) GROUP BY ALL)"""


_mean = lambda n, k: f"(coalesce({n}.s, 0) * {k} + 5 * league) / (coalesce({n}.d, 0) * {k} + 5)"
ORACLE: dict[str, str] = {
    "player_cells": BASE + ACTS + f""", c AS (SELECT match_id, team_id, player_id AS src, CASE kind WHEN 'shot' THEN {players.SHOT} WHEN 'turnover' THEN {players.LOSS} ELSE recipient_id END AS dst, CASE WHEN kind = 'shot' THEN xg ELSE 0 END AS xg, false AS first FROM pa
        UNION ALL SELECT match_id, team_id, arg_min(player_id, idx), NULL, 0, true FROM pa GROUP BY match_id, team_id, possession) SELECT match_id, team_id, src, dst, first, count(*) AS n, round(sum(xg), 6) AS xg FROM c GROUP BY ALL""",
    "opponent_adjusted_rates": BASE + ACTS + f""", pm AS (SELECT match_id, team_id, opp_id, sum(xg) / count(DISTINCT possession) AS rate FROM pa GROUP BY ALL), b AS (SELECT pm.* FROM pm JOIN pm q ON pm.match_id = q.match_id AND pm.opp_id = q.team_id),
        u AS (SELECT *, (sum(rate) OVER w - rate) / nullif(count(*) OVER w - 1, 0) AS usual FROM b WINDOW w AS (PARTITION BY opp_id)) SELECT match_id, team_id, opp_id, round(rate + {pitch.NUDGE}, 6) AS rate, round(rate / nullif(usual, 0) + {pitch.NUDGE}, 6) AS adjusted FROM u WHERE usual <> 0""",
    "line_ups": BASE + LINE + " SELECT * FROM lu",
    "missing_regulars": BASE + LINE + f""", s AS (SELECT DISTINCT match_id, team_id, player_id, match_date FROM lu JOIN (SELECT DISTINCT match_id, match_date FROM ev) USING (match_id) WHERE contains(positions, 'Starting XI')), g AS (SELECT DISTINCT match_id, match_date, team_id FROM s),
        og AS (SELECT g.*, (SELECT count(*) FROM g q WHERE q.team_id = g.team_id AND q.match_date < g.match_date) AS "of" FROM g), c AS (SELECT og.match_id, og.team_id, s.player_id, "of", count(*) AS started FROM og JOIN s ON s.team_id = og.team_id AND s.match_date < og.match_date WHERE "of" >= {players.REGULAR_LEAST} GROUP BY ALL)
        SELECT match_id, team_id, player_id, started, "of" FROM c WHERE started >= {players.REGULAR_LEAST} AND started >= {players.REGULAR_SHARE} * "of" AND (match_id, team_id, player_id) NOT IN (SELECT match_id, team_id, player_id FROM s)""",
    "lineup_calls": CALLS + LINE + f""", nw AS (SELECT lf.*, xi.eleven, th.eleven AS theirs FROM lf LEFT JOIN xi USING (match_id, team_id) LEFT JOIN xi th ON th.match_id = lf.match_id AND th.team_id = lf.opp_id), {_side('team_id', 'eleven', 'ow')}, {_side('opp_id', 'theirs', 'op')}
        SELECT ao.match_id, ao.team_id, opp_id, ao.feature, {", ".join(f"round({c} + {pitch.NUDGE}, 6) AS {c}" for c in ("actual", "league", "league_sd", "own", "call"))}, CAST(n_prior AS BIGINT) AS n_prior, scored,
        round({_mean('ow', '1')} + {_mean('op', '1')} - league + {pitch.NUDGE}, 6) AS call_xi, round({_mean('ow', 'coalesce(ow.k, 1)')} + {_mean('op', 'coalesce(op.k, 1)')} - league + {pitch.NUDGE}, 6) AS call_xin
        FROM ao LEFT JOIN ow USING (match_id, team_id, feature) LEFT JOIN op USING (match_id, team_id, feature)""",
    "involvement": BASE + VALUED + """, a AS (SELECT *, greatest(value, 0) AS v FROM av WHERE action IS NOT NULL), t AS (SELECT team_id, sum(v) AS t FROM a GROUP BY team_id), u AS (SELECT team_id, player_id, v AS made, 0e0 AS got, 1 AS acts FROM a WHERE player_id IS NOT NULL UNION ALL SELECT team_id, recipient_id, 0, v, 0 FROM a WHERE recipient_id IS NOT NULL),
        g AS (SELECT team_id, player_id, sum(made) AS made, sum(got) AS got, CAST(sum(acts) AS BIGINT) AS actions FROM u GROUP BY ALL HAVING sum(acts) > 0) SELECT team_id, player_id, actions, round((made + got) / CASE WHEN t > 0 THEN t ELSE 1 END, 6) AS involvement, round(made / CASE WHEN t > 0 THEN t ELSE 1 END, 6) AS created FROM g JOIN t USING (team_id)""",
    "passing_edges": BASE + VALUED + " SELECT team_id, player_id, recipient_id, count(*) AS n, round(sum(value), 6) AS value, round(sum(greatest(value, 0)), 6) AS positive FROM av WHERE type = 'Pass' AND action = 'move' AND player_id IS NOT NULL AND recipient_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 3",
    "pressing_nodes": BASE + " SELECT team_id, player_id, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y FROM e WHERE type = 'Pressure' AND player_id IS NOT NULL GROUP BY ALL",
    "head_to_head": BASE + f""", g AS (SELECT match_id, match_date, team_id, opp_id, count(*) FILTER ({pitch.GOAL}) AS goals, round(coalesce(sum(xg) FILTER (type = 'Shot'), 0) + 1e-10, 2) AS xg FROM e GROUP BY ALL) SELECT g.*, o.goals AS opp_goals, o.xg AS opp_xg FROM g JOIN g o ON g.match_id = o.match_id AND g.opp_id = o.team_id""",
}
PRESSED = BASE + f""", fp AS (SELECT match_id, possession, team_id, arg_min(x, clock * 100000 + idx) AS x, arg_min(y, clock * 100000 + idx) AS y, arg_min(player_id, clock * 100000 + idx) AS player_id, min(clock) AS clock FROM e WHERE type = 'Pressure' GROUP BY ALL),
tg AS (SELECT fp.*, t.position, abs(t.clock - fp.clock) AS gap, t.idx FROM fp LEFT JOIN e t ON t.match_id = fp.match_id AND t.possession = fp.possession AND t.under_pressure AND t.position IS NOT NULL AND t.team_id <> fp.team_id),
pr2 AS (SELECT match_id, possession, team_id, x, y, player_id, CASE WHEN min(gap) <= {players.NEAR_SECONDS} THEN arg_min(position, gap * 1000000 + idx) END AS pressed_position FROM tg GROUP BY ALL)"""
ORACLE |= {
    "press_starts": PRESSED + " SELECT * FROM pr2",
    "pressed_shares": PRESSED + ", g AS (SELECT team_id, pressed_position, count(*) AS n FROM pr2 WHERE pressed_position IS NOT NULL GROUP BY ALL) SELECT team_id, pressed_position, n, round(n / sum(n) OVER (PARTITION BY team_id), 6) AS share, round(sum(n) OVER (PARTITION BY pressed_position) / sum(n) OVER (), 6) AS league FROM g",
}
