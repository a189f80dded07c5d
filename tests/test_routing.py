"""Routes through freeze frames against Dijkstra, exhaustive search and full enumeration."""

import heapq
import itertools
import math

import numpy as np
import pytest

from tallyfield.operators import geometry, routing
from tallyfield.sources import adapters

FIELD = np.array([[-1, -1], [121, -1], [121, 81], [-1, 81]], float)


def random_frames(n, seed=0):
    rng = np.random.default_rng(seed)
    for i in range(n):
        d = rng.uniform([40, 0], [120, 80], (int(rng.integers(1, 12)), 2))
        lo = rng.uniform(-1, 60)
        area = FIELD if i % 3 else np.array([[lo, 5.0], [121, -1], [121, 81], [lo, 70.0]])
        yield d, area, tuple(rng.uniform([0, 0], [119, 79]))


def plain_costs(d, area):
    """Costs by loops over pairs of zones, straight from the definition."""
    c = [((i + 0.5) * 10, (j + 0.5) * 10) for i in range(12) for j in range(8)]

    def seen(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(area, np.roll(area, -1, axis=0), strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    view = [seen(*p) for p in c]
    edges, shots = {}, {}
    for i, a in enumerate(c):
        if view[i]:
            shots[i] = -math.log(min(max(math.exp(-0.9316 - 0.08619 * math.dist(a, (120, 40)) - 0.04681 * abs(a[1] - 40)), 1e-4), 1))
        for j, b in enumerate(c):
            if view[i] and view[j] and 1e-9 < math.dist(a, b) <= 45:
                lane = 0.0
                for q in d:
                    t = min(max(((q[0] - a[0]) * (b[0] - a[0]) + (q[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2, 0), 1)
                    lane += math.exp(-0.5 * (math.dist(q, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))) / 1.25) ** 2)
                recv = math.exp(-0.5 * (min(math.dist(q, b) for q in d) / 3) ** 2) if len(d) else 0.0
                z = 3.4747 - 1.4393 * lane - 3.0287 * recv - 0.0141 * math.dist(a, b) - 0.0533 * math.dist(a, b) ** 2 / 100
                edges[i, j] = -math.log(min(max(1 / (1 + math.exp(-z)), 1e-4), 1))
    return edges, shots, view


def dijkstra(edges, shots, start):
    out = {}
    for (i, j), w in edges.items():
        out.setdefault(i, []).append((j, w))
    best, heap, done = {start: 0.0}, [(0.0, start)], set()
    while heap:
        cost, i = heapq.heappop(heap)
        if i == "goal":
            return cost
        if i in done:
            continue
        done.add(i)
        for j, w in [*out.get(i, []), *([("goal", shots[i])] if i in shots else [])]:
            if cost + w < best.get(j, math.inf):
                best[j] = cost + w
                heapq.heappush(heap, (cost + w, j))
    return math.inf


def walked(edges, shots, path):
    return sum(edges[a, b] for a, b in itertools.pairwise(path)) + shots[path[-1]]


def test_unbounded_routes_equal_dijkstra():
    met = 0
    for d, area, ball in random_frames(8):
        f = routing.Frame(d, area, ball)
        edges, shots, view = plain_costs(d, area)
        assert f.seen.tolist() == view and all(f.moves[e] == pytest.approx(w, abs=1e-9) for e, w in edges.items()) and np.isfinite(f.moves).sum() == len(edges)
        threat, cost, path = routing.best_route(f.moves, f.shots, f.start, view[f.start], None)
        if not view[f.start]:
            assert (threat, cost, path) == (0.0, math.inf, [])
            continue
        met += 1
        assert cost == pytest.approx(dijkstra(edges, shots, f.start)) and threat == pytest.approx(math.exp(-cost)) and walked(edges, shots, path) == pytest.approx(cost)
    assert met >= 4


def exhaustive(moves, shots, start, depth):
    """Least cost over all ways of up to `depth` moves."""
    best, ends = shots[start], {start: 0.0}
    for _ in range(depth):
        new: dict = {}
        for i, c in ends.items():
            for j in np.flatnonzero(np.isfinite(moves[i])):
                new[int(j)] = min(new.get(int(j), math.inf), c + moves[i, j])
        ends = new
        best = min([best, *(c + shots[j] for j, c in ends.items())])
    return best


def test_bounded_routes_and_defenders_equal_exhaustive_search():
    for d, area, ball in random_frames(6, 1):
        f = routing.Frame(d, area, ball)
        for depth in (0, 1, 2, 3):
            threat, cost, path = routing.best_route(f.moves, f.shots, f.start, bool(f.seen[f.start]), depth)
            if not f.seen[f.start]:
                assert threat == 0.0
                continue
            assert cost == pytest.approx(exhaustive(f.moves, f.shots, f.start, depth)) and len(path) <= depth + 1
            assert sum(f.moves[a, b] for a, b in itertools.pairwise(path)) + f.shots[path[-1]] == pytest.approx(cost)
        for k in range(len(d)):
            alone = routing.Frame(np.delete(d, k, axis=0), area, ball)
            assert np.allclose(np.where(np.isfinite(alone.moves), alone.moves, -1), np.where(np.isfinite(f.without(k)), f.without(k), -1), atol=1e-9)


def test_options_equal_full_enumeration():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 10):
        for most in (1, 3, 20):
            mates, d, ball = rng.uniform([30, 0], [118, 80], (n, 2)), rng.uniform([40, 0], [120, 80], (int(rng.integers(1, 11)), 2)), rng.uniform([20, 0], [110, 80])
            got = routing.pass_options(ball, mates, d, most)
            if not n:
                assert got == []
                continue
            p = lambda a, b: float(routing.chance(routing.lane_terms(a[None], b[None], d).sum(1), routing.reception(np.linalg.norm(b - d, axis=1).min()), np.linalg.norm(b - a))[0])
            goal = lambda a: float(routing.scoring_chance(a[None])[0])
            one = [p(ball, m) * goal(m) for m in mates] + [goal(ball)]
            two = sorted((p(ball, mates[i]) * p(mates[i], mates[j]) * goal(mates[j]) for i in range(n) for j in range(n) if i != j), reverse=True)[:most]
            assert [o[0] for o in got] == pytest.approx(sorted(one + two, reverse=True))


def test_rows_of_frames(spark):
    rows = [(1, 1, (90.0, 40.0), [(100.0, 40.0, False)], [(90.0, 40.0, True), (105.0, 30.0, False)], [(-1.0, -1.0), (121.0, -1.0), (121.0, 81.0), (-1.0, 81.0)]), (1, 2, (90.0, 40.0), [(100.0, 40.0, False)], [(105.0, 30.0, False)], None), (1, 3, (150.0, -9.0), [(100.0, 40.0, True)], [], [(-1.0, -1.0), (121.0, -1.0), (121.0, 81.0), (-1.0, 81.0)])]
    s = spark.createDataFrame(rows, "match_id long, event_id long, ball struct<x: double, y: double>, defenders array<struct<x: double, y: double, keeper: boolean>>, attackers array<struct<x: double, y: double, actor: boolean>>, area array<struct<x: double, y: double>>")
    r = {x["event_id"]: x for x in routing.frame_routes(s).collect()}
    assert r[1]["threat"] > 0.05 and r[1]["observed"] == 1.0 and (r[2]["threat"], r[2]["cost"], r[2]["zones"], r[2]["observed"]) == (0.0, None, [], 0.0) and r[3]["threat"] > 0
    b = {x["event_id"]: x for x in routing.load_bearing(s).collect()}
    assert b[1]["gains"][0] >= 0 and b[2]["gains"] == [0.0]
    o = {x["event_id"]: x for x in routing.available(s).collect()}
    assert o[1]["mates"] == 1 and [x["hops"] for x in sorted(o[1]["options"], key=lambda x: x["hops"])] == [0, 1] and o[2]["options"] == [] == o[3]["options"]
    assert routing.frame_routes(s.limit(0)).count() == 0


def test_test_frames_hold_defenders_and_views(spark):
    ev = adapters.load(spark, "/root/testdata/sf0.001")
    s = geometry.snapshots(ev, *adapters.freeze_frames(ev)).collect()
    assert len(s) > 100 and {r["area"] is None for r in s} == {True, False} and all(r["defenders"] and sum(a["actor"] for a in r["attackers"]) == 1 for r in s)
