"""Fits against numpy's least squares over the whole table, and the terms that go into them against plain loops."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import pitch
from tallyfield.operators import enrich, experiments, fits, replay, scoring, stats
from tallyfield.sources import adapters

N = 30
REGION = np.array([0, 0, 1, 1, 2, 2])[np.arange(N) // 5] * 5 + np.arange(N) % 5


@pytest.fixture(scope="module")
def parts(spark):
    ev = enrich.with_kind(adapters.load(spark, "/root/testdata/sf0.01")).cache()
    counts, starts = stats.outcome_table(ev).cache(), stats.start_table(ev).cache()
    use, units = experiments.link_use(counts).cache(), experiments.outcome_rows(counts, starts, 5).cache()
    return counts, starts, use, units, fits.tested_links(use, units, 0.008).cache()


def weights(spark, matches, rep):
    rows = spark.createDataFrame([(m, rep) for m in matches], "m long, r int").withColumn("w", scoring.replicate_weight("m", "r")).collect()
    return {r["m"]: r["w"] for r in rows}


def table(use, units, links):
    """y, X and match of each unit by plain loops."""
    at = {(r["r0"], r["r1"]): r["k"] for r in links.collect()}
    x = collections.defaultdict(lambda: np.zeros(len(at)))
    for r in use.collect():
        if (r["r0"], r["r1"]) in at and r["usual"] is not None and r["usual"] >= 0.002:
            x[r["match_id"], r["team_id"]][at[r["r0"], r["r1"]]] = np.clip(r["n"] / r["all"] / r["usual"] - 1, -1, 3)
    rows = units.collect()
    return np.array([r["y"] for r in rows]), np.array([x[r["match_id"], r["team_id"]] for r in rows]), [(r["match_id"], r["team_id"]) for r in rows]


def test_joint_slopes_equal_least_squares(spark, parts):
    _, _, use, units, links = parts
    y, x, keys = table(use, units, links)
    assert 5 < x.shape[1] < 60 < len(y)
    got = collections.defaultdict(dict)
    for r in fits.joint_slopes(use, units, links, 3).collect():
        got[r["rep"]][r["r0"], r["r1"]] = r["slope"]
    order = [(r["r0"], r["r1"]) for r in links.orderBy("k").collect()]
    for rep in (0, 1, 3):
        w = weights(spark, {m for m, _ in keys}, rep) if rep else {m: 1 for m, _ in keys}
        root = np.sqrt([w[m] for m, _ in keys])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]) * root[:, None], y * root, rcond=None)[0][1:]
        assert [got[rep][k] for k in order] == pytest.approx(want, abs=1e-6)
    assert sorted(got) == [0, 1, 2, 3]


def test_rank_agreement_equals_numpy(spark, parts):
    counts, starts, use, units, links = parts
    slopes, drops = fits.joint_slopes(use, units, links, 4).cache(), fits.league_drops(counts, starts, links).cache()
    one = fits.rank_agreement(slopes, drops).first()
    mid = {(r["r0"], r["r1"]): (r["adapting"] + r["losing"]) / 2 for r in drops.collect()}
    rows = sorted((r["r0"], r["r1"], r["slope"], r["usage"]) for r in slopes.where("rep = 0").collect())
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    s = rank([r[2] for r in rows])
    assert one["model"] == pytest.approx(np.corrcoef(s, rank([mid[r[:2]] for r in rows]))[0, 1], abs=1e-6)
    assert one["by_usage"] == pytest.approx(np.corrcoef(s, rank([r[3] for r in rows]))[0, 1], abs=1e-6) and one["links"] == len(rows)
    effects = {(r["r0"], r["r1"]): r for r in fits.link_effects(slopes, drops).collect()}
    assert all(effects[r[:2]]["slope"] == pytest.approx(r[2], abs=1e-6) and effects[r[:2]]["lo"] <= effects[r[:2]]["hi"] for r in rows)


def test_gamma_equals_numpy(spark, parts):
    counts, starts, use, units, links = parts
    few = units.where("match_id < 400").cache()
    excess = fits.excess_terms(counts, starts, few, 30.0).cache()
    got = fits.gamma_test(use, few, links, excess, fits.PRIMARY, 2).first()
    c, x, s = collections.defaultdict(lambda: np.zeros((N, N + 2))), collections.defaultdict(lambda: np.zeros(N)), collections.defaultdict(lambda: np.zeros(N))
    for r in counts.collect():
        c[r["match_id"], r["team_id"]][r["z0"], r["out"]] += r["n"]
        x[r["match_id"], r["team_id"]][r["z0"]] += r["xg"]
    for r in starts.collect():
        s[r["match_id"], r["team_id"]][r["z0"]] += r["n"]
    worth = {(r["match_id"], r["team_id"]): r["e"] for r in excess.collect()}
    keys = sorted(worth)

    def mid(p, g, st, link):
        threat = lambda m: float(st @ np.linalg.inv(np.eye(N) - m) @ (p[:, pitch.SHOT] * g))
        blocked = (REGION[:, None] == link[0]) & (REGION[None] == link[1])
        lost = np.where(blocked, 0, p[:, :N])
        again = lost * np.where(lost.sum(1) > 0, p[:, :N].sum(1) / np.maximum(lost.sum(1), 1e-300), 0)[:, None]
        return 1 - (threat(lost) + threat(again)) / 2 / threat(p[:, :N])

    for m, t in keys[::9]:
        of = lambda d, keep: sum((v for k, v in d.items() if keep(k)), np.zeros_like(next(iter(d.values()))))  # noqa: B023, E731
        rest, team = (lambda k: k[0] != m), (lambda k: k[1] == t and k[0] != m)  # noqa: B023
        lc, lx, ls = (of(d, rest) for d in (c, x, s))
        shots = lc[:, pitch.SHOT]
        lg = np.divide(lx, shots, out=np.zeros(N), where=shots > 0)
        lc[:, pitch.LOSS] += 1
        lp, lst = lc / lc.sum(1, keepdims=True), ls / ls.sum()
        tc, tx, ts = (of(d, team) for d in (c, x, s))
        tp, tg, w = (tc + 30 * lp) / (tc.sum(1, keepdims=True) + 30), (tx + 10 * lg) / (tc[:, pitch.SHOT] + 10), ts + 30 * lst
        want = [mid(tp, tg, w / w.sum(), link) - mid(lp, lg, lst, link) for link in fits.SECONDARY]
        assert worth[m, t] == pytest.approx(want, abs=1e-9)
    y, xs, units_ = table(use, few, links)
    u = collections.defaultdict(float)
    for r in use.collect():
        if (r["r0"], r["r1"]) in fits.PRIMARY and r["usual"] is not None and r["usual"] >= 0.002:
            u[r["match_id"], r["team_id"]] += np.clip(r["n"] / r["all"] / r["usual"] - 1, -1, 3) * (worth.get((r["match_id"], r["team_id"])) or [0] * 4)[fits.SECONDARY.index((r["r0"], r["r1"]))]
    z = np.array([u[k] for k in units_])
    want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), xs, z]), y, rcond=None)[0][-1]
    assert got["n"] == len(y) and got["gamma"] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_logistic_meets_its_conditions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0, 0.0])))).astype(float)
    rows = spark.createDataFrame([(int(i % 7), float(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x, strict=True))], "match_id long, y double, x array<double>").repartition(5)
    beta = fits.logistic(rows, 3, 1.0)
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert (y - p).sum() == pytest.approx(0, abs=1e-6) and x.T @ (y - p) - beta[1:] == pytest.approx(np.zeros(3), abs=1e-6)
    assert beta[1] > 0.5 and beta[2] < -1 and fits.logistic(rows.where("false"), 3) == pytest.approx(np.zeros(4))


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 2)), rng.normal(size=90)
    rows = spark.createDataFrame([(int(i // 9), float(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x, strict=True))], "match_id long, y double, x array<double>")
    a, b = ({r["rep"]: r["beta"] for r in fits.least_squares(rows.repartition(n), 2, 5).collect()} for n in (1, 7))
    assert sorted(a) == list(range(6)) and all(a[k] == pytest.approx(b[k]) for k in a)
    assert a[0] == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(90), x]), y, rcond=None)[0])
    assert fits.least_squares(rows.limit(0), 2).count() == 0


def test_pass_rows_equal_the_frames(spark):
    ev = adapters.load(spark, "/root/testdata/sf0.001")
    from tallyfield.operators import geometry, routing

    snaps = geometry.snapshots(ev, *adapters.freeze_frames(ev)).cache()
    rows = fits.pass_rows(snaps, ev).withColumn("k", F.hash("x")).collect()
    assert {r["y"] for r in rows} == {0.0, 1.0}
    ends = {(r["match_id"], r["event_id"]): (r["end_x"], r["end_y"]) for r in ev.where("type = 'Pass'").collect()}
    want = []
    for r in snaps.where("type = 'Pass'").collect():
        a, b, d = np.array([[r["ball"]["x"], r["ball"]["y"]]]), np.array([ends[r["match_id"], r["event_id"]]]), np.array([[q["x"], q["y"]] for q in r["defenders"]])
        size = np.linalg.norm(b - a)
        want.append([routing.lane_terms(a, b, d).sum(), routing.reception(np.linalg.norm(b - d, axis=1).min()), size, size**2 / 100])
    assert np.array(sorted(r["x"] for r in rows)) == pytest.approx(np.array(sorted(want)), abs=1e-9) and replay.KAPPA == 1000
