"""DuckDB equivalents of claim estimates and link rows, over the prefixes of `oracle` and `oracle_season`."""

from __future__ import annotations

from ..operators import experiments, season
from ..operators.value import SEASON_CLAIMS
from .oracle import BASE, THREAT
from .oracle_calls import W
from .oracle_season import CZ, REGION

ROWS = " UNION ALL ".join(f"SELECT match_id, team_id, half, '{k}' AS claim, CAST({n} AS DOUBLE) AS num, CAST({d} AS DOUBLE) AS den FROM hf" for k, n, d in SEASON_CLAIMS)
_of = lambda c: f"sum(num) FILTER ({c}) / nullif(sum(den) FILTER ({c}), 0)"
_points = lambda a, b: f"(CASE WHEN coalesce({a}, false) THEN 1 ELSE 0 END + CASE WHEN coalesce({b}, false) THEN 1 ELSE 0 END)"
ESTIMATES = BASE + THREAT + f""",
hf AS (SELECT *, (row_number() OVER (PARTITION BY team_id ORDER BY match_id) - 1) % 2 AS half FROM sl), cm AS ({ROWS}),
cv AS (SELECT team_id, claim, count(*) AS matches, {_of('true')} AS value, {_of('half = 0')} AS first, {_of('half = 1')} AS second FROM cm GROUP BY ALL),
cd AS (SELECT team_id, claim, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM (SELECT team_id, claim, rep, sum(w * num) / nullif(sum(w * den), 0) AS r FROM (SELECT *, {W} AS w FROM cm, (SELECT range AS rep FROM range(1, 201))) GROUP BY ALL) GROUP BY ALL),
ce AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY claim) AS league, count(*) OVER (PARTITION BY claim) AS "of", CAST(rank() OVER (PARTITION BY claim ORDER BY round(value, 9) DESC) AS INT) AS rank FROM cv JOIN cd USING (team_id, claim) WHERE value IS NOT NULL),
cr AS (SELECT team_id, claim, matches, {", ".join(f"round({c}, 6) AS {c}" for c in ("value", "lo", "hi", "league", "first", "second"))}, round(value / nullif(league, 0), 6) AS vs_league, rank, "of", CASE WHEN rank <= "of" / 2 THEN rank ELSE "of" - rank + 1 END AS k FROM ce),
cf AS (SELECT * EXCLUDE (k), CASE WHEN matches < 2 THEN 'Low' ELSE list_extract(['Low', 'Medium', 'High'], 1 + {_points('lo > league OR hi < league', '(first - league) * (second - league) > 0')}) END AS confidence,
    CASE WHEN k = 1 THEN '' ELSE k || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END || ' ' END || CASE WHEN rank <= "of" / 2 THEN 'highest' ELSE 'lowest' END AS words FROM cr)"""
_loo = lambda by: f"(sum(xg) OVER (PARTITION BY {by}) - xg) / nullif(sum(p) OVER (PARTITION BY {by}) - p, 0)"
LINKS = BASE + CZ + f""",
rm AS (SELECT match_id, team_id, opp_id, CAST({REGION('z0')} AS INT) AS r0, CAST({REGION('"out"')} AS INT) AS r1, sum(n) AS n FROM ot WHERE "out" < {season.N} GROUP BY ALL),
rt AS (SELECT *, sum("all") OVER (PARTITION BY team_id) - "all" AS rest FROM (SELECT match_id, team_id, opp_id, sum(n) AS "all" FROM rm GROUP BY ALL)),
rv AS (SELECT team_id, r0, r1, sum(n) AS of_link FROM rm WHERE r0 <> r1 GROUP BY ALL),
ru AS (SELECT rt.*, r0, r1, coalesce(n, 0) AS n, (of_link - coalesce(n, 0)) / nullif(rest, 0) AS usual FROM rt JOIN rv USING (team_id) LEFT JOIN rm USING (match_id, team_id, opp_id, r0, r1)),
rx AS (SELECT a.match_id, a.team_id, a.opp_id, xg, p FROM (SELECT match_id, team_id, opp_id, sum(xg) AS xg FROM ot GROUP BY ALL) a JOIN (SELECT match_id, team_id, sum(n) AS p FROM st GROUP BY ALL) USING (match_id, team_id) WHERE p >= 5),
rw AS (SELECT *, {_loo('team_id')} AS made, {_loo('opp_id')} AS allowed, (sum(xg) OVER () - sum(xg) OVER (PARTITION BY match_id)) / nullif(sum(p) OVER () - sum(p) OVER (PARTITION BY match_id), 0) AS league FROM rx),
ry AS (SELECT match_id, team_id, opp_id, xg / p / nullif(made * (allowed / nullif(league, 0)), 0) - 1 AS y FROM rw),
lk AS (SELECT match_id, team_id, opp_id, r0, r1, round(y, 6) AS y, round(least(greatest(n / "all" / usual - 1, {experiments.CLIP_USE[0]}), {experiments.CLIP_USE[1]}), 6) AS u FROM ru JOIN ry USING (match_id, team_id, opp_id) WHERE usual >= {experiments.USUAL_LEAST} AND y IS NOT NULL)"""

ORACLE: dict[str, str] = {
    "claim_estimates": ESTIMATES + " SELECT * FROM cf",
    "half_agreement": ESTIMATES + " SELECT claim, count(*) AS n, round(avg(CAST((first - league) * (second - league) > 0 AS DOUBLE)), 6) AS agreement FROM cf WHERE first IS NOT NULL AND second IS NOT NULL GROUP BY claim",
    "link_rows": LINKS + " SELECT * FROM lk",
    "link_slopes": LINKS + " SELECT r0, r1, count(*) AS n, round(covar_pop(y, u) / nullif(var_pop(u), 0), 6) AS slope FROM lk GROUP BY ALL",
}
