"""Every registered query equals its DuckDB form on sf0.001; the chain solve equals a direct one."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield import registry
from tallyfield.functions import pitch
from tallyfield.operators import chain, enrich, matchup, people, scoring, season, stats, value
from tallyfield.sources.adapters import load

DIR = "/root/testdata/sf0.001"


def rows(df, cols):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "-"
        if hasattr(v, "year"):
            return str(v)[:10]
        return round(float(v) + 0.0, 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v

    return sorted((tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_duckdb(spark, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    want = con.execute(registry.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


def test_values_solve_the_chain(spark):
    """Line chain 0 -> 1 -> 2 -> shot, half of each row lost: V = [.025, .05, .1] at a shot worth .2."""
    cells = [(7, z, z + 1 if z < 2 else pitch.SHOT, 0.5) for z in range(3)] + [(7, z, pitch.LOSS, 0.5) for z in range(3)]
    df = spark.createDataFrame(cells, "team_id long, z0 int, out int, p double")
    full = spark.range(pitch.ZONES * (pitch.ZONES + 2)).selectExpr("cast(7 as long) as team_id", f"cast(id div {pitch.ZONES + 2} as int) as z0", f"cast(id % {pitch.ZONES + 2} as int) as out").join(df, ["team_id", "z0", "out"], "left").fillna(0.0)
    zones = spark.range(pitch.ZONES).selectExpr("cast(7 as long) as team_id", "cast(id as int) as z0", "case when id = 2 then 0.2d else 0d end as g", "1d / 30 as start")
    got = {r["z0"]: r["value"] for r in season.solved(full, zones, "team_id").collect()}
    assert np.allclose([got[z] for z in range(3)], [0.025, 0.05, 0.1])


def test_edges_belong_to_the_upper_cell(spark):
    got = spark.sql(f"select {pitch.lane('cast(30 as double)')} as a, {pitch.lane('cast(62 as double)')} as b, {pitch.zone('cast(80 as double)', 'cast(null as double)')} as c").first()
    assert tuple(got) == (2, 4, 20)


def test_graph_measures_of_known_flows():
    ring = np.zeros((15, 15))
    for a, b in ((0, 1), (1, 2), (2, 0)):
        ring[a, b] = 4
    assert matchup.circulation_of(ring) == pytest.approx(1)
    down = np.zeros((15, 15))
    down[0, 1] = down[1, 2] = 3
    assert matchup.circulation_of(down) == pytest.approx(0)
    assert matchup.spectral_gap_of(np.ones((15, 15))) == pytest.approx(1)


def test_denial_loses_more_than_adapting(spark):
    got = registry.QUERIES["denial_plan"](spark, DIR).toPandas()
    assert len(got) and (got["drop_losing"] >= -1e-6).all() and (got["drop_losing"] <= 1 + 1e-6).all()
    move = np.array([[0.0, 0.6, 0.2], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    blocked = np.array([[False, True, False]] + [[False] * 3] * 2)
    assert matchup.denied(move, blocked, True)[0].tolist() == pytest.approx([0, 0, 0.8])
    assert matchup.denied(move, blocked, False)[0].tolist() == pytest.approx([0, 0, 0.2])


@pytest.fixture(scope="module")
def rich(spark):
    """Events with recoveries, restarts and failed interceptions, which the adapter does not make."""
    ev = load(spark, DIR).selectExpr("*", "event_id % 4 as f").selectExpr("* except (type, outcome, f)", "case when type in ('Dispossessed', 'Pressure') and f = 1 then 'Ball Recovery' when type = 'Pressure' and f in (2, 3) then 'Interception' else type end as type", "case when type = 'Pressure' and f = 2 then 'Lost Out' else outcome end as outcome")
    return enrich.enrich(ev).cache()


def test_season_claims_equal_brute_force(rich):
    ev = rich.toPandas()
    n, to = 192, lambda x, y: int(min(max(x // 7.5, 0), 15)) * 12 + int(min(max(y // (80 / 12), 0), 11))
    count, xg = np.zeros((n, n + 2)), np.zeros(n)
    for r in ev[ev["kind"].notna()].itertuples():
        z = to(r.x, r.y)
        count[z, to(r.end_x, r.end_y) if r.kind == "move" else n if r.kind == "shot" else n + 1] += 1
        xg[z] += r.xg if r.kind == "shot" else 0
    total = count.sum(1) + 1
    v = np.linalg.solve(np.eye(n) - count[:, :n] / total[:, None], count[:, n] / total * np.divide(xg, count[:, n], out=np.zeros(n), where=count[:, n] > 0))
    teams = set(ev["team_id"])
    made, won, met = {t: np.zeros(3) for t in teams}, {t: np.zeros(2) for t in teams}, {t: {} for t in teams}
    for r in ev.itertuples():
        met[r.team_id][r.match_id] = r.opp_id
        fail = isinstance(r.outcome, str) and r.outcome
        if r.type == "Ball Recovery" or r.type == "Interception" and fail not in ("Lost", "Lost In Play", "Lost Out"):
            won[r.team_id] += (1, r.x >= 80)
        if r.team_id != r.possession_team_id:
            continue
        gain = None
        if r.type == "Shot" and r.sub_type != "Penalty":
            gain = r.xg - v[to(r.x, r.y)]
        elif r.type in ("Pass", "Carry") and not fail:
            gain = v[to(r.end_x, r.end_y)] - v[to(r.x, r.y)]
        if gain is not None and gain > 0:
            made[r.team_id, r.match_id] = made.get((r.team_id, r.match_id), np.zeros(3)) + gain * np.array([1, r.transition, r.bucket == "60-90+"])
    want = {}
    for t in teams:
        us = sum(made.get((t, m), np.zeros(3)) for m in met[t])
        them = sum(made.get((o, m), np.zeros(3)) for m, o in met[t].items())
        want |= {(t, "threat_per_match"): us[0] / len(met[t]), (t, "conceded_per_match"): them[0] / len(met[t]), (t, "conceded_in_transition"): them[1] / them[0], (t, "conceded_late"): them[2] / them[0], (t, "high_regains"): won[t][1] / won[t][0]}
    got = {(r["team_id"], r["claim"]): r["value"] for r in stats.claims(value.season_ledger(rich), value.SEASON_CLAIMS).collect()}
    assert {c for _, c in got} == {c for c, _, _ in value.SEASON_CLAIMS} and len(value.SEASON_CLAIMS) == 13
    assert all(got[k] == pytest.approx(w, abs=2e-5) for k, w in want.items())
    ends = scoring.claim_intervals(value.season_ledger(rich), 20, value.SEASON_CLAIMS).where("claim = 'high_regains'").collect()
    assert ends and all(r["lo"] <= r["hi"] for r in ends)


def test_level_rates_of_a_known_match(spark):
    cols = "match_id long, period int, idx long, period_seconds double, team_id long, opp_id long, home_goals long, away_goals long, type string, sub_type string, outcome string, x double, y double, end_x double, end_y double, xg double"
    rows, who = [], [("Pass", None, None, 85.0, 25.0, 90.0, 40.0, None), ("Pass", None, None, 30.0, 5.0, 75.0, 40.0, None), ("Shot", None, None, 100.0, 40.0, None, None, 0.3), ("Shot", "Penalty", None, 108.0, 40.0, None, None, 0.8), ("Carry", None, None, 90.0, 5.0, 95.0, 5.0, None)]
    for k, a in enumerate(who + [("Pressure", None, None, 81.0, 10.0, None, None, None), ("Pass", None, "Incomplete", 20.0, 40.0, 50.0, 40.0, None)]):
        team = 1 if k < 5 else 2
        rows.append((9, 1, k, 200.0 * k, team, 3 - team, 0, 0, *a[:3], *a[3:]))
    rows.append((9, 1, 7, 1400.0, 1, 2, 1, 0, "Pass", None, None, 85.0, 25.0, 90.0, 40.0, None))  # not level
    ev = spark.createDataFrame(rows, cols)
    got = {r["team_id"]: tuple(r)[3:] for r in people.level_rates(ev, 10.0).collect()}
    assert got[1] == pytest.approx((12.0, 0.0, 0.5, 0.25, 0.5, 2.25))
    assert got[2][:3] == pytest.approx((12.0, 0.5, 0.0)) and got[2][3] is None and got[2][4:] == pytest.approx((0.0, -2.25))
    assert all(tuple(r)[4:] == (None,) * 5 for r in people.level_rates(ev).collect())


def test_result_calls_equal_brute_force(spark):
    res = stats.results(enrich.with_kind(load(spark, DIR))).cache()
    r = res.toPandas()
    r["day"] = r["match_date"].astype(str)
    side = {h: r[r["home"] == h].set_index("match_id") for h in (True, False)}

    def chances(a, b):
        p = [np.array([math.exp(-x) * x**k / math.factorial(k) for k in range(13)]) for x in (a, b)]
        g = np.outer(*p)
        return np.array([np.tril(g, -1).sum(), np.trace(g), np.triu(g, 1).sum()]) / g.sum()

    want = {}
    for m in set(side[True].index) & set(side[False].index):
        h, a = side[True].loc[m], side[False].loc[m]
        prior = r[r["day"] < h["day"]]
        lx, lg = prior["xg"].mean(), prior["goals"].mean()
        if not len(prior) or not lx > 0 or not lg > 0:
            continue
        lh, la = prior[prior["home"]]["goals"].mean(), prior[~prior["home"]]["goals"].mean()
        ends = [np.sign(side[True].loc[k, "goals"] - side[False].loc[k, "goals"]) for k in prior["match_id"].unique() if k in side[True].index and k in side[False].index]

        def call(t, o, f, mean):
            own, against = prior[prior["team_id"] == t][f], prior[prior["opp_id"] == o][f]
            return (own.sum() + 5 * mean) / (len(own) + 5) + (against.sum() + 5 * mean) / (len(against) + 5) - mean

        x = [max(call(t, o, "xg", lx), 0.05) * lg / lx * f / lg for t, o, f in ((h["team_id"], h["opp_id"], lh), (a["team_id"], a["opp_id"], la))]
        g = [max(call(t, o, "goals", lg), 0.05) * f / lg for t, o, f in ((h["team_id"], h["opp_id"], lh), (a["team_id"], a["opp_id"], la))]
        want |= {(m, "xg"): chances(*x), (m, "goals"): chances(*g), (m, "blend"): chances((x[0] + g[0]) / 2, (x[1] + g[1]) / 2), (m, "base"): np.array([np.mean(np.equal(ends, k)) for k in (1, 0, -1)])}
    got = {(q["match_id"], q["model"]): (q["home"], q["draw"], q["away"]) for q in stats.result_calls(res).collect()}
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(w, abs=2e-6) for k, w in want.items())
    # A match's own figures say nothing of its calls.
    last = max(want)[0]
    other = res.withColumn("xg", F.when(F.col("match_id") == last, 9.0).otherwise(F.col("xg"))).withColumn("goals", F.when(F.col("match_id") == last, 7).otherwise(F.col("goals")))
    again = {q["model"]: (q["home"], q["draw"], q["away"]) for q in stats.result_calls(other).where(F.col("match_id") == last).collect()}
    assert all(again[k] == got[last, k] for k in again) and len(again) == 4
    scores = scoring.ranked_scores(stats.result_calls(res), res, "model", "scored")
    assert scores.count() == len(want) and {q["model"] for q in scoring.call_calibration(scores.withColumn("scored", F.lit(True))).collect()} == {"xg", "goals", "blend", "base"}


def test_team_calls_equal_brute_force(spark):
    res = stats.results(enrich.with_kind(load(spark, DIR))).cache()
    chances, calls = stats.result_calls(res).cache(), stats.asof_calls(res).cache()
    p = {(q["match_id"], q["model"]): q for q in chances.collect()}
    c = {(q["match_id"], q["team_id"]): q for q in calls.collect()}
    goals = {(q["match_id"], q["team_id"]): q["goals"] for q in res.collect()}
    got = {(q["match_id"], q["team_id"]): q for q in scoring.team_calls(chances, res, calls).collect()}
    teams = {}
    for q in res.collect():
        m, t, o = q["match_id"], q["team_id"], q["opp_id"]
        if (m, "xg") not in p or (m, t) not in c or (m, o) not in c:
            assert (m, t) not in got
            continue
        flip = lambda model: [p[m, model][k] for k in (("home", "draw", "away") if q["home"] else ("away", "draw", "home"))]  # noqa: B023, E731
        x, base, end = flip("xg"), flip("base"), int(np.sign(goals[m, o] - goals[m, t])) + 1
        score = lambda v: ((v[0] - (end == 0)) ** 2 + (v[0] + v[1] - (end < 2)) ** 2) / 2  # noqa: B023, E731
        g = got.pop((m, t))
        assert (g["win"], g["draw"], g["loss"], g["base_win"], g["base_draw"], g["base_loss"]) == (*x, *base)
        assert (g["rate_for"], g["rate_against"]) == tuple(p[m, "xg"][k] for k in (("home_rate", "away_rate") if q["home"] else ("away_rate", "home_rate")))
        assert g["result"] == ("win", "draw", "loss")[end] and g["points"] == (3, 1, 0)[end]
        assert (g["rps"], g["rps_base"], g["expected_points"]) == pytest.approx((score(x), score(base), 3 * x[0] + x[1]), abs=2e-6)
        assert (g["call_for"], g["call_against"], g["actual_for"], g["actual_against"]) == (c[m, t]["call"], c[m, o]["call"], c[m, t]["actual"], c[m, o]["actual"])
        teams.setdefault(t, []).append((score(x), int(np.argmax(x)) == end, 3 * x[0] + x[1], (3, 1, 0)[end], c[m, t], c[m, o]))
    assert not got and len(teams) > 3
    for s in scoring.team_call_summary(scoring.team_calls(chances, res, calls)).collect():
        rows = teams.pop(s["team_id"])
        assert s["n"] == len(rows) and (s["top_pick_right"], s["points"]) == (sum(r[1] for r in rows), sum(r[3] for r in rows))
        assert (s["rps"], s["expected_points"]) == pytest.approx((np.mean([r[0] for r in rows]), sum(r[2] for r in rows)), abs=1e-5)
        for k, at in (("for", 4), ("against", 5)):
            call, actual, league = (np.array(v) for v in zip(*((r[at]["call"], r[at]["actual"], r[4]["league"]) for r in rows), strict=True))
            assert s[f"closer_{k}"] == (abs(call - actual) < abs(league - actual)).sum()
            assert s[f"skill_{k}"] == pytest.approx(1 - ((call - actual) ** 2).sum() / ((league - actual) ** 2).sum(), abs=2e-6)
            assert (s[f"called_{k}"], s[f"made_{k}"]) == pytest.approx((call.sum(), actual.sum()), abs=2e-6)
    assert not teams


def test_noise_floor_equals_simulation(spark):
    share = [0.1, 0.2, 0.25, 0.45]
    shares = spark.createDataFrame([(p,) for p in share], "share double")
    got = {q["n"]: q["floor"] for q in scoring.noise_floor(spark.createDataFrame([(n,) for n in (0, 1, 7, 20, 3000)], "n long"), shares).collect()}
    for n in (1, 7, 20, 3000):
        drawn = np.random.default_rng(n).multinomial(n, share, size=200_000) / n
        assert got[n] == pytest.approx(0.5 * abs(drawn - share).sum(1).mean(), rel=5e-3)
    assert got[0] is None
    sure = spark.createDataFrame([(1.0,), (0.0,)], "share double")
    assert scoring.noise_floor(spark.createDataFrame([(9,)], "n long"), sure).first()["floor"] == pytest.approx(0.0, abs=1e-9)


def test_kappa_is_the_best_of_the_grid(spark):
    counts = registry.QUERIES["outcome_table"](spark, DIR).cache()

    def brute(c):
        n, league = {}, np.zeros((30, 32))
        for q in c.collect():
            n.setdefault(q["team_id"], {}).setdefault(q["match_id"], np.zeros((30, 32)))[q["z0"], q["out"]] += q["n"]
        league = sum(m for t in n.values() for m in t.values())
        league[:, pitch.LOSS] += 1
        league = league / league.sum(1, keepdims=True)
        score = {}
        for k in chain.KAPPAS:
            ll = seen = 0.0
            for t in n.values():
                for m in t.values() if len(t) >= 3 else ():
                    rest = sum(t.values()) - m
                    p = (rest + k * league) / (rest.sum(1, keepdims=True) + k)
                    ll, seen = ll + (m[m > 0] * np.log(np.clip(p[m > 0], 1e-12, None))).sum(), seen + m.sum()
            score[k] = ll / max(seen, 1.0)
        return max(score, key=score.get)

    assert chain.select_kappa(counts).first()["kappa"] == brute(counts) != registry.KAPPA
    # Matches of like flow but one style each: own counts tell more than the league, so a smaller kappa is best.
    styles = spark.range(60).selectExpr("id as match_id", "id % 6 as team_id", "(id + 1) % 6 as opp_id", "cast(id % 6 as int) as z0", "cast((id % 6) * 5 as int) as out", "40L as n", "0d as xg")
    styles = styles.union(styles.selectExpr("match_id", "team_id", "opp_id", "0", "out", "n", "xg"))
    assert chain.select_kappa(styles).first()["kappa"] == brute(styles) == 1
    few = styles.where("match_id < 12")  # two matches each
    assert chain.select_kappa(few).first()["kappa"] == brute(few) == 1
    one = counts.unionByName(styles.where("match_id < 2").selectExpr("match_id", "100 + team_id as team_id", "opp_id", "z0", "out", "1000 * n as n", "xg"))
    assert chain.select_kappa(one).first()["kappa"] == brute(one)
    got = {(q["team_id"], q["z0"], q["out"]): q["p"] for q in registry.QUERIES["season_chains"](spark, DIR).collect()}
    want = chain.team_chains(counts, float(brute(counts))).collect()
    assert len(got) == len(want) and all(got[q["team_id"], q["z0"], q["out"]] == pytest.approx(q["p"], abs=1e-6) for q in want)
    for name in ("season_distances", "season_similar_teams", "season_values", "season_matchups", "season_denial_plan"):
        assert registry.QUERIES[name](spark, DIR).count() > 0
