"""DuckDB equivalents of scores, players and match-ups, over the prefix of `oracle`."""

from __future__ import annotations

from ..functions import pitch
from ..operators import matchup, people, scoring
from ..operators.stats import CLAIMS
from ..operators.value import SEASON_CLAIMS
from .oracle import BASE, THREAT, VALUED
from .oracle import ORACLE as FIRST

U = "CAST('0x' || substr(md5(CAST(match_id AS VARCHAR) || ':' || CAST(rep AS VARCHAR)), 1, 8) AS BIGINT)"
W = " + ".join(f"CAST({U} >= {t} AS INT)" for t in scoring.POISSON)
P = scoring.PSEUDO
LOO = f"""lt AS (SELECT sum(xg) AS s, count(*) AS n FROM res),
lo AS (SELECT r.*, (s - sum(xg) OVER (PARTITION BY match_id)) / nullif(n - count(*) OVER (PARTITION BY match_id), 0) AS league FROM res r, lt),
lp AS (SELECT match_id, team_id, xg, league, (sum(xg) OVER (PARTITION BY team_id) - xg + {P} * league) / (count(*) OVER (PARTITION BY team_id) - 1 + {P}) AS team,
    (sum(xg) OVER (PARTITION BY opp_id) - xg + {P} * league) / (count(*) OVER (PARTITION BY opp_id) - 1 + {P}) AS against FROM lo),
pd AS (SELECT match_id, team_id, round(xg, 6) AS actual, round(league, 9) AS league, round(team, 9) AS team, round(team + against - league, 9) AS "both" FROM lp WHERE league IS NOT NULL)"""
SCORED = f"""WITH sc AS (SELECT match_id, CASE WHEN hg > ag THEN 'home' WHEN hg = ag THEN 'draw' ELSE 'away' END AS outcome, home, draw, away FROM ({FIRST['result_chances']}) c
    JOIN ({BASE} SELECT h.match_id, h.goals AS hg, a.goals AS ag FROM res h JOIN res a ON h.match_id = a.match_id AND h.home AND NOT a.home) g USING (match_id))
"""
ROLE_LIST = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in people.ROLES)

def intervals(source: str, table) -> str:
    """Intervals of claims over the ledger `source`."""
    drawn = " UNION ALL ".join(f"SELECT team_id, rep, '{k}' AS claim, w * CAST({n} AS DOUBLE) AS num, w * CAST({d} AS DOUBLE) AS den FROM dr" for k, n, d in table)
    return f""", dw AS (SELECT {source}.*, rep FROM {source}, (SELECT range AS rep FROM range(1, 201))), dr AS (SELECT *, {W} AS w FROM dw), v AS (SELECT team_id, rep, claim, sum(num) / nullif(sum(den), 0) AS v FROM ({drawn}) GROUP BY ALL)
        SELECT team_id, claim, round(quantile_cont(v, 0.05), 6) AS lo, round(quantile_cont(v, 0.95), 6) AS hi FROM v GROUP BY ALL"""


ORACLE: dict[str, str] = {
    "claim_intervals": BASE + intervals("led", CLAIMS),
    "season_claim_intervals": BASE + THREAT + intervals("sl", SEASON_CLAIMS),
    "loo_predictions": BASE + f", {LOO} SELECT * FROM pd",
    "audit_scores": BASE + f""", {LOO}, s AS (SELECT count(*) AS n, sum(pow(actual - league, 2)) AS l, sum(pow(actual - team, 2)) AS t, sum(pow(actual - "both", 2)) AS b FROM pd),
        q AS (SELECT n, round(1 - t / nullif(l, 0), 6) AS r2_team, round((t - b) / nullif(l, 0), 6) AS gain_opponent FROM s)
        SELECT *, CASE WHEN r2_team >= {scoring.TIER_LEAD} THEN 'lead' WHEN r2_team >= {scoring.TIER_USABLE} THEN 'usable' ELSE 'drop' END AS tier FROM q""",
    "pooled_skill": BASE + """SELECT count(*) AS n, round(1 - sum(pow(actual - call, 2)) / nullif(sum(pow(actual - league, 2)), 0), 6) AS skill, round(1 - sum(pow(actual - own, 2)) / nullif(sum(pow(actual - league, 2)), 0), 6) AS skill_team,
        round(avg(CAST(abs(actual - call) < abs(actual - league) AS DOUBLE)), 6) AS closer FROM calls""",
    "ranked_scores": SCORED + "SELECT *, round((pow(home - CASE WHEN outcome = 'home' THEN 1 ELSE 0 END, 2) + pow(home + draw - CASE WHEN outcome = 'away' THEN 0 ELSE 1 END, 2)) / 2, 6) AS rps FROM sc",
    "calibration": SCORED + ", l AS (SELECT outcome, 'home' AS side, home AS p FROM sc UNION ALL SELECT outcome, 'draw', draw FROM sc UNION ALL SELECT outcome, 'away', away FROM sc) SELECT CAST(least(floor(p * 6), 5) AS INT) AS bin, count(*) AS n, round(avg(p) + 1e-10, 6) AS p, round(avg(CAST(side = outcome AS DOUBLE)), 6) AS hit FROM l GROUP BY 1",
    "fixture_halves": BASE + """SELECT match_id, team_id, CAST((row_number() OVER (PARTITION BY team_id ORDER BY match_id) - 1) % 2 AS INT) AS half,
        row_number() OVER (PARTITION BY team_id ORDER BY match_date, match_id) - 1 >= floor(count(*) OVER (PARTITION BY team_id) * 0.5) AS later FROM res""",
    "lane_baseline": BASE + "SELECT lane_final AS lane, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM prog WHERE lane_final IS NOT NULL GROUP BY lane_final",
    "lane_noise": BASE + """, p AS (SELECT round(count(*) / sum(count(*)) OVER (), 6) AS p FROM prog WHERE lane_final IS NOT NULL GROUP BY lane_final),
        c AS (SELECT match_id, team_id, count(*) AS n FROM prog WHERE lane_final IS NOT NULL GROUP BY ALL), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM c, p WHERE p > 0 AND p < 1),
        d AS (SELECT match_id, team_id, n, abs(k / n - p) * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS d FROM k)
        SELECT match_id, team_id, n, round(sum(d) / 2 + 1e-10, 6) AS floor FROM d GROUP BY ALL""",
    "ppda": BASE + "SELECT match_id, team_id, round(opp_passes_low / greatest(def_actions, 1), 6) AS ppda FROM led WHERE opp_passes_low > 0",
    "state_rates": BASE + VALUED + f""", a AS (SELECT *, {people.STATE} AS state FROM av WHERE action IS NOT NULL), g AS (SELECT opp_id AS team_id, state, round(sum(greatest(value, 0)), 6) AS conceded, count(DISTINCT (match_id, possession)) AS possessions FROM a GROUP BY ALL)
        SELECT *, round(conceded / possessions, 6) AS rate FROM g""",
    "entries": BASE + f"SELECT match_id, possession, min(idx) AS idx, arg_min(team_id, idx) AS team_id, arg_min(player_id, idx) AS player_id, arg_min({pitch.crossing_lane(80)}, idx) AS lane FROM e WHERE {pitch.crosses(80)} GROUP BY ALL",
    "dependency": BASE + """, p AS (SELECT match_id, possession, team_id, idx_final FROM prog WHERE idx_final IS NOT NULL), n AS (SELECT team_id, count(*) AS entries FROM p GROUP BY team_id),
        t AS (SELECT team_id, player_id, count(DISTINCT (match_id, possession)) AS touched FROM e JOIN p USING (match_id, possession, team_id) WHERE action IS NOT NULL AND player_id IS NOT NULL AND idx <= idx_final GROUP BY ALL)
        SELECT team_id, player_id, touched, round(touched / entries, 6) AS share FROM t JOIN n USING (team_id)""",
    "role_leaders": BASE + f""", r AS (SELECT team_id, player_id, unnest(list_filter([{ROLE_LIST}], lambda x: x IS NOT NULL)) AS role FROM e), c AS (SELECT team_id, role, player_id, count(*) AS n FROM r GROUP BY ALL),
        d AS (SELECT *, round(n / sum(n) OVER (PARTITION BY team_id, role), 6) AS share, CAST(row_number() OVER (PARTITION BY team_id, role ORDER BY n DESC, player_id) AS INT) AS place FROM c) SELECT * FROM d WHERE place <= 5""",
    "level_table": BASE + """, d AS (SELECT *, least(greatest(coalesce(period_seconds - lag(period_seconds) OVER (PARTITION BY match_id, period ORDER BY idx), 0), 0), 120) AS dt FROM e), l AS (SELECT * FROM d WHERE home_goals = away_goals),
        mi AS (SELECT match_id, sum(dt) / 60 AS minutes FROM l GROUP BY match_id HAVING sum(dt) / 60 >= 20),
        g AS (SELECT match_id, team_id, coalesce(sum(xg) FILTER (kind = 'shot'), 0) AS xg, count(*) FILTER (type = 'Pass') AS passes, count(*) FILTER (type = 'Pressure') AS presses FROM l GROUP BY ALL)
        SELECT match_id, team_id, round(minutes, 6) AS minutes, round(xg * 90 / minutes, 6) AS xg_90, round(passes * 90 / minutes, 6) AS passes_90, round(presses * 90 / minutes, 6) AS presses_90 FROM g JOIN mi USING (match_id)""",
    "zone_means": BASE + f""", a AS (SELECT {pitch.zone('x', 'y')} AS zone, xg_after FROM e WHERE kind IS NOT NULL), z AS (SELECT zone, avg(xg_after) AS v FROM a GROUP BY zone)
        SELECT CAST(range AS INT) AS zone, round(coalesce(v, (SELECT avg(xg_after) FROM a)), 9) AS value FROM range({pitch.ZONES}) LEFT JOIN z ON zone = range""",
    "matchup_chains": BASE + f""", cc AS (SELECT opp_id, z0, "out", CAST(sum(n) AS BIGINT) AS n FROM ot GROUP BY ALL),
        tb AS (SELECT opp_id, z0, "out", (coalesce(n, 0) + 30 * p) / (sum(coalesce(n, 0)) OVER (PARTITION BY opp_id, z0) + 30) AS pb FROM (SELECT DISTINCT opp_id FROM ot) CROSS JOIN lg LEFT JOIN cc USING (opp_id, z0, "out")),
        j AS (SELECT team_id, opp_id, z0, "out", tc.p * CASE WHEN lg.p > 0 THEN least(greatest(pb / lg.p, {matchup.CLIP[0]}), {matchup.CLIP[1]}) ELSE 1 END AS p
            FROM (SELECT DISTINCT team_id, opp_id FROM ot) JOIN tc USING (team_id) JOIN tb USING (opp_id, z0, "out") JOIN lg USING (z0, "out"))
        SELECT team_id, opp_id, z0, "out", round(p / sum(p) OVER (PARTITION BY team_id, opp_id, z0) + 1e-10, 6) AS p FROM j""",
    "observed_lanes": BASE + f"""SELECT team_id, {pitch.lane(matchup.middle_crossing('z0', '"out"'))} AS lane, CAST(sum(n) AS BIGINT) AS n FROM ot WHERE "out" < {pitch.ZONES} AND floor(z0 / 5) < 4 AND floor("out" / 5) >= 4 GROUP BY ALL""",
    "entropy_rates": f"WITH g AS ({FIRST['zone_graph']}), w AS (SELECT *, sum(n) OVER (PARTITION BY team_id, r0) AS rw, sum(n) OVER (PARTITION BY team_id) AS t FROM g) SELECT team_id, round(-sum(n / t * log2(n / rw)), 6) AS entropy FROM w GROUP BY team_id",
    "reciprocity": f"""WITH g AS ({FIRST['zone_graph']}), u AS (SELECT team_id, least(r0, r1) AS a, greatest(r0, r1) AS b, sum(n) AS gross, abs(sum(CASE WHEN r0 < r1 THEN n ELSE -n END)) AS net FROM g WHERE r0 <> r1 GROUP BY ALL)
        SELECT team_id, round(1 - sum(net) / sum(gross), 6) AS reciprocity FROM u GROUP BY team_id""",
}
