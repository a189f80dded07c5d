"""Value hold-outs by season against a fit over the other seasons' events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import enrich, holdout, value
from tallyfield.sources import adapters


def zone(x, y):
    return int(np.clip(np.floor(x / 7.5), 0, 15)) * 12 + int(np.clip(np.floor(y / (80 / 12)), 0, 11))


@pytest.fixture(scope="module")
def ev(spark):
    return adapters.with_season(enrich.enrich(adapters.load(spark, "/root/testdata/sf0.01"))).cache()


def test_holdout_equals_training_on_the_rest(ev):
    got = {(r["season"], r["model"]): r for r in holdout.holdout(ev, "season", 100).collect()}
    acts = [r for r in ev.where("kind is not null").select("season", "kind", "x", "y", "end_x", "end_y", "xg", "xg_after").collect() if r["x"] is not None and r["y"] is not None]
    seasons = sorted({r["season"] for r in acts})
    assert len(seasons) == 2 or len(seasons) == 3
    for s in seasons:
        train, test = [r for r in acts if r["season"] != s], [r for r in acts if r["season"] == s]
        if len(test) < 100:
            assert (s, "markov") not in got
            continue
        c, xg, sums, n = np.zeros((192, 194)), np.zeros(192), np.zeros(192), np.zeros(192)
        for r in train:
            z = zone(r["x"], r["y"])
            sums[z], n[z] = sums[z] + r["xg_after"], n[z] + 1
            if r["kind"] == "move":
                c[z, zone(r["end_x"], r["end_y"])] += 1
            elif r["kind"] == "shot":
                c[z, 192] += 1
                xg[z] += r["xg"] or 0.0
            else:
                c[z, 193] += 1
        p = c / (c.sum(1, keepdims=True) + 1)
        v = np.linalg.inv(np.eye(192) - p[:, :192]) @ (p[:, 192] * np.divide(xg, c[:, 192], out=np.zeros(192), where=c[:, 192] > 0))
        base = sums.sum() / n.sum()
        y, zs = np.array([r["xg_after"] for r in test]), [zone(r["x"], r["y"]) for r in test]
        scale = base / ((n * v).sum() / n.sum())
        for name, grid in (("markov", v), ("markov_scaled", v * scale), ("zone_mean", np.where(n > 0, sums / np.maximum(n, 1), base))):
            pred, r = grid[zs], got[s, name]
            assert r["n"] == len(test) and r["mse"] == pytest.approx(np.mean((y - pred) ** 2)) and r["skill"] == pytest.approx(1 - np.mean((y - pred) ** 2) / np.mean((y - base) ** 2), abs=1e-9)
            assert r["calib"] == pytest.approx(pred.mean() / y.mean()) and r["corr"] == pytest.approx(np.corrcoef(y, pred)[0, 1], abs=1e-6)


def test_small_seasons_and_flat_values(spark, ev):
    assert holdout.holdout(ev, "season", 10**6).count() == 0 and holdout.holdout(ev.limit(0)).count() == 0
    flat = holdout.holdout(ev.withColumn("xg", F.lit(0.0)), "season", 100).where("model = 'markov'").first()
    assert flat["corr"] == 0.0 and flat["calib"] == 0.0


def test_monotone_share(spark, ev):
    v = value.grid_values(ev)
    cols = np.array([r["value"] for r in v.orderBy("zone").collect()]).reshape(16, 12).mean(1)
    assert holdout.monotone_share(v).first()["share"] == pytest.approx(np.mean(np.diff(cols) > 0))
