"""Odd and large inputs: many events in a match, many players in a team."""

import hashlib
import math
import time
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import players, routing, stats


def test_chances_of_high_rates(spark):
    """Rates whose exp(-rate) is 0 in double precision, against exact fractions; before, division by zero."""
    rates = [(1, 500.0, 480.0), (2, 4000.0, 0.05), (3, 0.0, 900.0), (4, 1.5, 1.1), (5, 740.0, 10.0), (6, 1e9, 1e9)]
    got = {r["match_id"]: r for r in stats.chances(spark.createDataFrame(rates, "match_id long, home_rate double, away_rate double")).collect()}
    for m, h, a in rates:
        w = [[Fraction(r) ** k / math.factorial(k) for k in range(13)] for r in (h, a)]
        total = sum(w[0]) * sum(w[1])
        home = sum(w[0][i] * w[1][j] for i in range(13) for j in range(i)) / total
        draw = sum(x * y for x, y in zip(*w, strict=True)) / total
        assert [got[m][c] for c in ("home", "draw", "away")] == pytest.approx([float(home), float(draw), float(1 - home - draw)], abs=1e-6)


def player_table(seed, receivers, n=400):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"team_id": 1, "match_id": rng.integers(1, 9, n), "src": rng.integers(1, 15, n), "dst": rng.choice([*receivers, players.SHOT, players.LOSS, np.nan], n), "first": rng.random(n) < 0.2})
    rows.loc[rows["first"], "dst"] = np.nan
    rows["xg"] = np.where(rows["dst"] == players.SHOT, rng.integers(0, 60, n) / 100, 0.0)
    return rows.groupby(["team_id", "match_id", "src", "dst", "first"], dropna=False).agg(n=("xg", "size"), xg=("xg", "sum")).reset_index().round(6)


@pytest.mark.parametrize("receivers", [(1, 2, 3), (1, 2, 40), tuple(range(1, 15)), (40,)])
def test_chains_over_reached_nodes(receivers):
    """Chains of some matches over the nodes that can be reached equal those over all nodes; the table grows with the receivers, not squared."""
    g = player_table(len(receivers), receivers)
    t = players._team_cells(g, 20, g["match_id"].to_numpy())
    assert t.width <= len(receivers) + 6
    for some in (None, {1, 2, 3, 4, 5, 6}, {2, 7}, set()):
        part = g if some is None else g[g["match_id"].isin(some)]
        c = t.chain(some)
        if part.empty:
            assert not len(c.players)
            continue
        want = players.PlayerChain(part, 20)
        assert sorted(want.players) == c.players.tolist() and c.base == pytest.approx(want.threat(), abs=1e-12)
        for i, p in enumerate(c.players.tolist()):
            assert [c.without(i, a) for a in (True, False)] == pytest.approx([want.without(p, a) for a in (True, False)], abs=1e-12)


def test_many_players_of_a_team(spark):
    """A team of 3,000 players of whom three receive; before, two solves of 3,000 unknowns for each of them."""
    n = 3000
    cells = spark.range(n).selectExpr("1L as team_id", "1L as match_id", "id as src", "explode(array(1L, 2L, 3L, -2L, -3L, null)) as dst").selectExpr("*", "dst is null as first", "30L as n", "if(dst = -2, 3.0D, 0.0D) as xg")
    start = time.monotonic()
    got = players.removal_effects(cells, 20).agg(F.count("*").alias("n"), F.max("place").alias("place")).first()
    assert tuple(got) == (n, n) and time.monotonic() - start < 60


def test_absence_summary_against_loops(spark):
    """Shuffles deal the observed drops out by hash to the keys in order; keys are ordered as texts over all ranges."""
    rng = np.random.default_rng(3)
    rows = [(int(t), int(p), None if p % 9 == 4 else float(o), float(a), float(b)) for t, p, o, a, b in zip(rng.integers(1, 4, 40), range(5, 45), rng.random(40), rng.random(40), rng.random(40), strict=True)]
    got = players.absence_summary(spark.createDataFrame(rows, "team_id long, player_id long, observed double, drop_adapting double, drop_losing double").repartition(3), 50).first()
    kept = sorted((f"{t}-{p}", o, (a + b) / 2) for t, p, o, a, b in rows if o is not None)
    mid = np.array([m for _, _, m in kept])
    dealt = [[o for _, o in sorted((hashlib.md5(f"{k}:{rep}".encode()).hexdigest(), o) for k, o, _ in kept)] for rep in range(1, 51)]
    r = np.corrcoef([o for _, o, _ in kept], mid)[0, 1]
    assert got["n"] == len(kept) and got["r"] == pytest.approx(r, abs=1e-6) and got["p"] == pytest.approx(np.mean([np.corrcoef(d, mid)[0, 1] >= r for d in dealt]), abs=1e-6)


def test_far_lanes_are_not_costed_again(monkeypatch):
    """Without a far defender only lanes whose pressure changes are costed; before, all lanes were."""
    field = np.array([[-1, -1], [121, -1], [121, 81], [-1, 81]], float)
    d = np.array([[5.0, 5.0], [100.0, 40.0], [70.0, 20.0]])
    f, costed = routing.Frame(d, field, (60.0, 40.0)), []
    costs = routing.Frame.costs
    monkeypatch.setattr(routing.Frame, "costs", lambda self, edges, *more: costed.append(len(self.src[edges])) or costs(self, edges, *more))
    got = f.without(0)
    assert costed[0] < len(f.src) / 2
    assert np.array_equal(np.isfinite(got), np.isfinite(f.moves)) and np.allclose(got[f.src, f.dst], routing.Frame(d[1:], field, (60.0, 40.0)).moves[f.src, f.dst], atol=1e-12)
