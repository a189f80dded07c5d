"""Chains, experiments, players, reliability and geometry against plain numpy, and hand-solved cases."""

import collections
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield import registry
from tallyfield.functions import pitch
from tallyfield.operators import audit, chain, enrich, experiments, geometry, matchup, players, reliability, season, stats
from tallyfield.sources import adapters

DIR = "/root/testdata/sf0.001"
N = 30


@pytest.fixture(scope="module")
def parts(spark):
    ev = enrich.with_kind(adapters.load(spark, "/root/testdata/sf0.01")).where("match_id < 600").cache()
    return stats.outcome_table(ev).cache(), stats.start_table(ev).cache()


def dense(counts, starts):
    c, x, s, who = (collections.defaultdict(lambda: np.zeros((N, N + 2))), collections.defaultdict(lambda: np.zeros(N)), collections.defaultdict(lambda: np.zeros(N)), {})
    for r in counts.collect():
        k = r["match_id"], r["team_id"]
        c[k][r["z0"], r["out"]] += r["n"]
        x[k][r["z0"]] += r["xg"]
        who[k] = r["opp_id"]
    for r in starts.collect():
        s[r["match_id"], r["team_id"]][r["z0"]] += r["n"]
    return c, x, s, who


def league_of(c, x, s):
    c = c.copy()
    c[:, N + 1] += 1
    shots = c[:, N]
    return c / c.sum(1, keepdims=True), np.divide(x, shots, out=np.zeros(N), where=shots > 0), s / s.sum()


def shrunk(c, x, s, league, k):
    p, g, st = league
    w = s + k * st
    return (c + k * p) / (c.sum(1, keepdims=True) + k), (x + 10 * g) / (c[:, N] + 10), w / w.sum()


def met(a, b, league):
    r = [np.clip(np.divide(q, z, out=np.ones_like(q), where=z > 0), 0.25, 4) for q, z in zip(b, league, strict=True)]
    p, s = a[0] * r[0], a[2] * r[2]
    return p / p.sum(1, keepdims=True), a[1] * r[1], s / s.sum()


def threat(ch):
    return float(ch[2] @ np.linalg.solve(np.eye(N) - ch[0][:, :N], ch[0][:, N] * ch[1]))


def test_matchup_rows_equal_brute_force(spark, parts):
    counts, starts = parts
    c, x, s, who = dense(counts, starts)
    got = {(r["match_id"], r["team_id"]): r for r in experiments.matchup_rows(counts, starts, 30.0, 3, 5).collect()}
    total = [sum(d.values()) for d in (c, x, s)]
    for k in sorted(got)[:12]:
        m, t = k
        mates = [q for q in c if q[0] == m]
        league = league_of(*(v - sum(d[q] for q in mates) for v, d in zip(total, (c, x, s), strict=True)))
        a = shrunk(*(sum((d[q] for q in c if q[1] == t and q[0] != m), np.zeros_like(d[k])) for d in (c, x, s)), league, 30.0)
        b = shrunk(*(sum((d[q] for q in c if who[q] == who[k] and q[0] != m), np.zeros_like(d[k])) for d in (c, x, s)), league, 30.0)
        want = {"own": threat(a), "defence": threat(b), "strength": threat(a) * threat(b) / threat(league), "matchup": threat(met(a, b, league))}
        assert all(got[k][f"pred_{n}"] == pytest.approx(v, abs=1e-9) for n, v in want.items())
        assert got[k]["y"] == pytest.approx(x[k].sum() / s[k].sum()) and got[k]["possessions"] == s[k].sum()
    assert len(got) > 20
    out = experiments.matchup_summary(experiments.matchup_rows(counts, starts, 30.0, 3, 5).cache(), 50).first()
    assert out["threat_matchup_vs_own_lo"] <= out["threat_matchup_vs_own_hi"] and out["lane_own"] < 0


def test_season_chain_of_a_line(spark):
    """Line 0 -> 1 -> 2 -> shot with half of each row lost: visits halve; denying the only way leaves nothing."""
    cells = [("attack", 7, z, o, p) for z in range(N) for o, p in (((z + 1 if z < 2 else pitch.SHOT), 0.5), (pitch.LOSS, 0.5))]
    full = spark.createDataFrame(cells, "side string, team_id long, z0 int, out int, p double")
    grid = spark.range(N * (N + 2)).selectExpr("'attack' as side", "cast(7 as long) as team_id", f"cast(id div {N + 2} as int) as z0", f"cast(id % {N + 2} as int) as out")
    cells = grid.join(full, ["side", "team_id", "z0", "out"], "left").fillna(0.0)
    zones = spark.range(N).selectExpr("'attack' as side", "cast(7 as long) as team_id", "cast(id as int) as z0", "case when id = 2 then 0.2 else 0.0 end as g", "case when id = 0 then 1.0 else 0.0 end as start")
    s = {r["z0"]: r for r in season.solved(cells, zones, "side", "team_id").collect()}
    assert [s[k]["visits"] for k in range(3)] == pytest.approx([1, 0.5, 0.25]) and [s[k]["value"] for k in range(3)] == pytest.approx([0.025, 0.05, 0.1])
    assert season.threats(season.solved(cells, zones, "side", "team_id"), "side").first()["threat"] == pytest.approx(0.025)
    cells, zones = cells.drop("side"), zones.drop("side")
    one = season.solved(cells, zones, "team_id")
    same = season.distances(cells, one, (cells, one)).first()
    assert same["distance"] == 0


def test_shrinkage_limits_and_matchup_identity(spark, parts):
    counts, starts = parts
    league = {(r["z0"], r["out"]): r["p"] for r in chain.league_chain(counts).collect()}
    assert all(abs(r["p"] - league[r["z0"], r["out"]]) < 1e-6 for r in chain.team_chains(counts, 1e12).collect())
    cells, zones = season.season_chains(counts, starts, 1e12)
    got = season.matchups(cells, zones, counts.select("team_id", "opp_id").distinct()).collect()
    assert got and all(r["share"] == pytest.approx(r["own_share"], abs=1e-5) for r in got)


def test_scaling_keeps_distances(spark):
    pts = np.array([[0.0, 0], [3, 0], [0, 4], [3, 4]])
    d = [(i, j, float(np.linalg.norm(pts[i] - pts[j]))) for i in range(4) for j in range(i + 1, 4)]
    xy = {r["team_id"]: np.array([r["x"], r["y"]]) for r in season.scaled(spark.createDataFrame(d, "team_a long, team_b long, distance double")).collect()}
    assert all(np.linalg.norm(xy[i] - xy[j]) == pytest.approx(v) for i, j, v in d)


def test_two_player_chain():
    cells = pd.DataFrame([(1, 2, False, 40, 0.0), (2, players.SHOT, False, 20, 4.0), (2, players.LOSS, False, 20, 0.0), (1, np.nan, True, 40, 0.0)], columns=["src", "dst", "first", "n", "xg"])
    c = players.PlayerChain(cells, 10)
    assert c.players == [1, 2] and c.start.tolist() == [1, 0, 0]
    assert c.p.sum(1) == pytest.approx(1) and c.g[1] == pytest.approx((4 + 5 * 0.2) / 25)
    assert c.without(2, False) <= c.without(2, True) < c.threat()  # the finisher
    plain = players.PlayerChain(cells, 1)
    plain.p = np.array([[0, 1, 0, 0, 0], [0, 0, 0, 0.5, 0.5], [0, 0, 0, 0, 1.0]])
    plain.g = np.array([0, 0.1, 0])
    assert plain.threat() == pytest.approx(0.05) and plain.without(2, True) == 0 and plain.without(1, True) == pytest.approx(0.025)


def test_line_up_weights(spark):
    rows = [(1, list(range(11)), list(range(1, 12))), (2, None, [1]), (3, list(range(11)), list(range(11)))]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, a array<long>, b array<long>").select("k", players.overlap_weight(F.col("a"), F.col("b"))).collect()}
    assert got[1] == pytest.approx((10 / 11) ** 4) and got[2] == got[3] == 1


def test_possession_context_of_known_events(spark):
    """Fixture: pass, shot, the opponent's pressure, goal; a corner and an ordinary pass; a recovery with later passes."""
    cols = "match_id long, event_id string, idx long, period long, period_seconds double, minute long, type string, team_id long, possession long, possession_team_id long, play_pattern string, x double, y double, end_x double, end_y double, outcome string, xg double, sub_type string, home_team_id long, away_team_id long"
    ev = lambda i, kind, t=0.0, team=1, pos=1, **k: (1, str(i), i, 1, float(t), int(t // 60), kind, team, pos, 1, k.get("pattern", "Regular Play"), k.get("x", 60.0), 40.0, k.get("end_x"), 40.0 if k.get("end_x") else None, k.get("outcome"), k.get("xg"), k.get("sub"), 1, 2)
    rows = [ev(1, "Pass", end_x=80.0), ev(2, "Shot", xg=0.2), ev(3, "Pressure", team=2), ev(4, "Shot", xg=0.3, outcome="Goal"), ev(5, "Pass", pos=2, pattern="From Corner", sub="Corner", end_x=100.0), ev(6, "Pass", pos=2, pattern="From Corner", end_x=90.0)]
    rows += [ev(7, "Ball Recovery", 0, pos=3), ev(8, "Pass", 4, pos=3, end_x=70.0), ev(9, "Pass", 25, pos=3, end_x=70.0), ev(10, "Own Goal For", 30, pos=4, team=2), ev(11, "Pass", 40, pos=5, end_x=70.0)]
    e = {int(r["event_id"]): r for r in enrich.enrich(spark.createDataFrame(rows, cols)).collect()}
    assert [e[k]["xg_after"] for k in (1, 2, 3, 4)] == pytest.approx([0.5, 0.5, 0.3, 0.3]) and all(e[k]["goal_after"] for k in (1, 2, 3, 4)) and [e[k]["in_possession"] for k in (1, 2, 3, 4)] == [True, True, False, True]
    assert (e[5]["restart"], e[6]["restart"]) == ("Corner", None) and e[5]["kind"] is None and e[5]["action"] == "move"
    assert [e[k]["transition"] for k in (7, 8, 9)] == [True, True, False] and not e[6]["transition"]
    assert (e[4]["home_goals"], e[5]["home_goals"], e[10]["away_goals"], e[11]["away_goals"]) == (0, 1, 0, 1)


def test_labels_and_ranks(spark):
    df = spark.createDataFrame([(1.0, 0.8, 1.2, 0.5, 0.9, 1.1), (1.0, 0.4, 1.2, 0.5, 0.9, 1.1), (1.0, 0.4, 1.2, 0.5, 0.4, 1.1), (1.0, 0.9, 1.1, None, 0.9, 1.0)], "v double, lo double, hi double, league double, a double, b double")
    got = [r[0] for r in df.select(reliability.label(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["High", "Medium", "Low", "High"]
    words = [r[0] for r in spark.range(1, 21).select(reliability.rank_words(F.col("id"), F.lit(20))).collect()]
    assert words[0] == "highest" and words[1] == "2nd highest" and words[2] == "3rd highest" and words[-1] == "lowest" and words[-2] == "2nd lowest"


def test_estimate_of_any_statistic(spark):
    rng = np.random.default_rng(1)
    rows = [(m, 5, float(v)) for m in range(40) for v in rng.normal(10, 1, 3)]
    df = spark.createDataFrame(rows, "match_id long, team_id long, v double")
    e = reliability.estimate(df, F.sum("v") / F.countDistinct("match_id"), "team_id", reps=100).first()
    want = sum(r[2] for r in rows) / 40
    assert e["value"] == pytest.approx(want) and e["lo"] < want < e["hi"] and e["hi"] - e["lo"] < 2 and e["confidence"] == "High"


def test_calls_do_not_see_later_matches(spark, parts):
    counts, starts = parts
    table = audit.season_table(counts, starts, 2, 3)
    dates = spark.createDataFrame([(m, f"2024-01-{1 + m // 100:02d}") for m in {r[0] for r in counts.select("match_id").collect()}], "match_id long, match_date string").selectExpr("match_id", "cast(match_date as date) as match_date")
    long = audit.long_form(table, dates, ("possession", "turnover_rate"))
    late = long.withColumn("v", F.when(F.col("match_id") >= 400, 99.0).otherwise(F.col("v")))
    key = lambda df: {(r["match_id"], r["team_id"], r["feature"]): r["call"] for r in audit.asof(df).where("match_id < 500").collect()}
    a, b = key(long), key(late)
    assert len(a) > 30 and all(b[k] == a[k] for k in a)
    spread = [(m, f, float(10 * t + rng)) for t in range(4) for m, f, rng in ((k, "f", math.sin(7 * k + t)) for k in range(8))]
    df = spark.createDataFrame([(m, i // 8, f, v) for i, (m, f, v) in enumerate(spread)], "match_id int, team_id int, feature string, v double")
    g = np.array([v for *_, v in spread]).reshape(4, 8)
    s2 = g.var(axis=1, ddof=1).mean()
    tau = g.mean(1).var(ddof=1) - s2 / 8
    assert audit.pseudo_matches(df, 0.0, 30.0).first()["k"] == pytest.approx(s2 / tau)


def test_geometry_equals_numpy(spark):
    rng = np.random.default_rng(2)
    frames, events = [], []
    for i in range(25):
        pts = rng.uniform([0, 0], [120, 80], (int(rng.integers(3, 16)), 2))
        mate = rng.random(len(pts)) < 0.5
        mate[0], mate[1] = True, False
        keeper = np.zeros(len(pts), bool)
        keeper[1] = i % 3 == 0
        frames += [(1, str(i), n, bool(mate[n]), n == 0, bool(keeper[n]), *map(float, pts[n])) for n in range(len(pts))]
        events.append((1, str(i), "Pass", 1, 5 if i % 2 else 6, 5, *map(float, pts[0])))
    f = spark.createDataFrame(frames, "match_id long, event_id string, n int, teammate boolean, actor boolean, keeper boolean, x double, y double")
    e = spark.createDataFrame(events, "match_id long, event_id string, type string, possession long, team_id long, possession_team_id long, x double, y double")
    a = spark.createDataFrame([(1, "1", "[0, 0, 10, 0, 10, 10, 0, 10]")], "match_id long, event_id string, visible_area string")
    snaps = geometry.snapshots(e, f, a).cache()
    got = {r["event_id"]: r for r in geometry.features(snaps).collect()}
    for i, (_, k, *_rest, bx, by) in enumerate(events):
        mine = i % 2 == 1
        ps = [p for p in frames if p[1] == k]
        turn = (lambda x, y: (x, y)) if mine else (lambda x, y: (120 - x, 80 - y))
        d = np.array([turn(p[6], p[7]) for p in ps if p[3] != mine]).reshape(-1, 2)
        kp = np.array([p[5] for p in ps if p[3] != mine], bool)
        at = np.array([turn(p[6], p[7]) for p in ps if p[3] == mine]).reshape(-1, 2)
        if not len(d):
            assert k not in got
            continue
        o, b = d[~kp], np.array(turn(bx, by))
        if not len(o):
            assert got[k]["line_height"] is None
            continue
        back = o[np.argsort(-o[:, 0])[:4]]
        seg = np.array([120, 40]) - b
        t = np.clip(((d - b) @ seg) / max(seg @ seg, 1e-9), 0, 1)
        lane = np.exp(-0.5 * (np.linalg.norm(d - (b + t[:, None] * seg), axis=1) / 1.25) ** 2).sum()
        want = {"line_height": back[:, 0].mean(), "space_behind": 120 - back[:, 0].max(), "block_depth": np.ptp(o[:, 0]), "block_width": np.ptp(o[:, 1]), "max_lateral_gap": np.diff(np.sort(back[:, 1])).max() if len(back) > 1 else 80, "between_lines_gap": np.diff(np.sort(o[:, 0])).max() if len(o) > 1 else 120,
            "ballside_ratio": ((o[:, 1] - 40) * (b[1] - 40) >= 0).mean(), "defenders_goalside": (d[:, 0] > b[0]).sum(), "nearest_defender": np.linalg.norm(d - b, axis=1).min(), "lane_to_goal": lane, "box_defenders": ((d[:, 0] >= 102) & (abs(d[:, 1] - 40) <= 22)).sum(),
            "attackers_goalside": (at[:, 0] > b[0]).sum(), "overload": (at[:, 0] > b[0]).sum() - (d[:, 0] > b[0]).sum(), "n_visible": len(d) + len(at)}
        assert all(got[k][n] == pytest.approx(v, abs=1e-9) for n, v in want.items()), k
    inside = snaps.where("event_id = '1'").select(*(geometry.visible(F.col("area"), F.lit(x), F.lit(y)).alias(str(n)) for n, (x, y) in enumerate([(5.0, 5.0), (11.0, 5.0), (5.0, -1.0)]))).first()
    assert tuple(inside) == (True, False, False)
    flags = geometry.typology(geometry.features(snaps), geometry.features(snaps))
    assert flags.where("line_height").count() >= 3
    p = spark.range(1).select(geometry.shot_probability(F.lit(118.0), F.lit(40.0)), geometry.shot_probability(F.lit(90.0), F.lit(40.0)), geometry.pass_success(F.lit(0.0), F.lit(0.0), F.lit(10.0)), geometry.pass_success(F.lit(2.0), F.lit(0.5), F.lit(10.0))).first()
    assert p[0] > p[1] and p[2] > p[3] and p[2] == pytest.approx(1 / (1 + math.exp(-(3.4747 - 0.141 - 0.0533))))


def test_interval_queries_run(spark):
    for name in ("removal_effects", "missed_matches", "absence_summary", "denial_plan", "season_table", "feature_skills", "pseudo_matches", "reidentification", "denial_agreement"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_matchup_measures_without_net_flow():
    assert math.isnan(matchup.circulation_of(np.ones((15, 15))))
