"""Ways to the goal through a freeze frame: cheapest routes over zones, who holds the block together, what was on offer.

Snapshots are those of `geometry`. A graph has the middles of 12 x 8 zones and the goal; an edge costs the negative logarithm of
a pass's (or shot's) chance, so that the cheapest route is the likeliest. Only zones in the camera's view are part of
it: no area is no view. Each row holds one graph of fixed size, relaxed as arrays; Spark deals the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .geometry import GOAL_Y, LANE_SIGMA, LENGTH, PASS, RECEPTION_SIGMA, SHOT, WIDTH

NX, NY, LONGEST, LEAST_CHANCE = 12, 8, 45.0, 1e-4  # fixed values: zones, longest pass, least chance of one
ZONES = NX * NY
BEHIND = 5.0  # fixed value: the corridor begins so far behind the ball
MOST_PAIRS = 20  # fixed value: two-pass options that are kept
GOAL = (LENGTH, GOAL_Y)


@lru_cache(1)
def zones() -> tuple[np.ndarray, np.ndarray]:
    """Middles of the zones, and distances between them."""
    x, y = np.meshgrid((np.arange(NX) + 0.5) * LENGTH / NX, (np.arange(NY) + 0.5) * WIDTH / NY, indexing="ij")
    c = np.column_stack([x.ravel(), y.ravel()])
    return c, np.linalg.norm(c[None] - c[:, None], axis=2)


def zone_of(x: float, y: float) -> int:
    return int(np.clip(x // (LENGTH / NX), 0, NX - 1)) * NY + int(np.clip(y // (WIDTH / NY), 0, NY - 1))


def inside(area: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon: crossings of a ray are odd. An empty polygon holds nothing."""
    held = np.zeros(len(points), bool)
    x, y = points[:, 0], points[:, 1]
    for (ax, ay), (bx, by) in zip(area, np.roll(area, -1, axis=0), strict=True):
        cross = (ay > y) != (by > y)
        held ^= cross & (x < ax + np.divide((y - ay) * (bx - ax), by - ay, out=np.zeros(len(y)), where=np.full(len(y), by != ay)))
    return held


def lane_terms(start: np.ndarray, end: np.ndarray, defenders: np.ndarray) -> np.ndarray:
    """What each defender adds to the pressure on each segment."""
    # By coordinate and with segments innermost: a row's few defenders make short axes, over which arrays are slow.
    (x0, y0), (sx, sy), (dx, dy) = np.ascontiguousarray(start.T), np.ascontiguousarray((end - start).T), defenders.T[:, :, None]
    t = np.clip(((dx - x0) * sx + (dy - y0) * sy) / np.maximum(sx**2 + sy**2, 1e-9), 0, 1)
    return np.ascontiguousarray(np.exp(-0.5 * (np.sqrt((dx - (x0 + t * sx)) ** 2 + (dy - (y0 + t * sy)) ** 2) / LANE_SIGMA) ** 2).T)


def reception(near: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * (near / RECEPTION_SIGMA) ** 2)


def chance(lane: np.ndarray, received: np.ndarray, length: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(PASS[0] + PASS[1] * lane + PASS[2] * received + PASS[3] * length + PASS[4] * length**2 / 100)))


def scoring_chance(points: np.ndarray) -> np.ndarray:
    return np.clip(np.exp(SHOT[0] + SHOT[1] * np.linalg.norm(points - GOAL, axis=1) + SHOT[2] * np.abs(points[:, 1] - GOAL_Y)), 1e-6, 0.999)


class Frame:
    """The graph of one snapshot: costs of moves between zones and of shots, infinite where there is none."""

    def __init__(self, defenders: np.ndarray, area: np.ndarray, ball: tuple[float, float]):
        c, apart = zones()
        self.seen, self.start = inside(area, c), zone_of(*ball)
        self.src, self.dst = np.nonzero((apart > 1e-9) & (apart <= LONGEST) & self.seen[:, None] & self.seen[None])
        self.length = apart[self.src, self.dst]
        self.terms = lane_terms(c[self.src], c[self.dst], defenders)
        self.lane = self.terms.sum(1)
        self.near = np.sqrt((c[:, :1] - defenders[:, 0]) ** 2 + (c[:, 1:] - defenders[:, 1]) ** 2) if len(defenders) else np.full((ZONES, 1), np.inf)
        self.nearest, self.order = self.near.min(1), np.sort(self.near, axis=1)
        self.moves = np.full((ZONES, ZONES), np.inf)
        self.moves[self.src, self.dst] = self.costs(slice(None), self.lane, self.nearest)
        self.shots = np.where(self.seen, -np.log(np.clip(scoring_chance(c), LEAST_CHANCE, 1)), np.inf)
        band = c[:, 0] >= ball[0] - BEHIND
        self.observed, self.corridor = float(self.seen.mean()), float(self.seen[band].mean()) if band.any() else 0.0

    def costs(self, edges, lane: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        return -np.log(np.clip(chance(lane[edges], reception(nearest[self.dst[edges]]), self.length[edges]), LEAST_CHANCE, 1))

    def without(self, k: int) -> np.ndarray:
        """Costs of moves if defender k were not there; only lanes whose pressure changes and zones that they are nearest to are costed again."""
        mine = self.near[:, k] <= self.nearest
        nearest = np.where(mine, self.order[:, 1] if self.order.shape[1] > 1 else np.inf, self.nearest)
        lane = self.lane - self.terms[:, k]
        touched = np.flatnonzero((lane != self.lane) | mine[self.dst])
        moves = self.moves.copy()
        moves[self.src[touched], self.dst[touched]] = self.costs(touched, lane, nearest)
        return moves


def relaxed(moves: np.ndarray, shots: np.ndarray, depth: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost from each zone to the goal with up to `depth` moves before the shot (None: as many as help), and for each
    round the zone that a better way goes to (-1: no better way than the round before)."""
    value, ways = shots.copy(), []
    while depth is None or len(ways) < depth:
        through = moves + value[None]
        to = through.argmin(1)
        best = through[np.arange(len(to)), to]
        better = best < value
        if depth is None and not better.any():
            break
        ways.append(np.where(better, to, -1))
        value = np.where(better, best, value)
    return value, ways


def path_of(start: int, ways: list[np.ndarray]) -> list[int]:
    """Zones of the best way from `start`: a move of round k goes on with what was best in the rounds before it."""
    path, layer = [start], len(ways) - 1
    while layer >= 0:
        to = int(ways[layer][path[-1]])
        layer -= 1
        if to >= 0:
            path.append(to)
    return path


def best_route(moves: np.ndarray, shots: np.ndarray, start: int, seen: bool, depth: int | None) -> tuple[float, float, list[int]]:
    """threat, cost, zones; no threat from a zone that is not in view or leads nowhere."""
    value, ways = relaxed(moves, shots, depth)
    if not seen or not np.isfinite(value[start]):
        return 0.0, float("inf"), []
    return float(np.exp(-value[start])), float(value[start]), path_of(start, ways)


def _points(rows, *more: str) -> np.ndarray:
    return np.array([[r["x"], r["y"], *(r[m] for m in more)] for r in (rows if rows is not None else ())], float).reshape(-1, 2 + len(more))


def _each(snaps: DataFrame, of: Callable[[dict], list], schema: str) -> DataFrame:
    kinds = dict(snaps.dtypes)
    schema = f"match_id {kinds['match_id']}, event_id {kinds['event_id']}, {schema}"
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield pd.DataFrame([[r["match_id"], r["event_id"], *of(r)] for r in g.to_dict("records")], columns=names)

    return snaps.select("match_id", "event_id", "ball", "defenders", "attackers", "area").mapInPandas(run, schema)


def _frame(r: dict) -> Frame:
    return Frame(_points(r["defenders"]), _points(r["area"]), (r["ball"]["x"], r["ball"]["y"]))


def frame_routes(snaps: DataFrame, depth: int | None = None) -> DataFrame:
    """match_id, event_id, threat, cost (null where there is no way), zones from the ball's to the shot, hops, shares of the pitch and of the
    corridor from the ball to the goal that are in view."""

    def of(r: dict) -> list:
        f = _frame(r)
        threat, cost, path = best_route(f.moves, f.shots, f.start, bool(f.seen[f.start]), depth)
        return [threat, cost if path else None, path, max(len(path) - 1, 0), f.observed, f.corridor]

    return _each(snaps, of, "threat double, cost double, zones array<int>, hops int, observed double, corridor double")


def load_bearing(snaps: DataFrame, depth: int = 2) -> DataFrame:
    """One row for each snapshot: threat, and how much more there would be without each defender, in their order."""

    def of(r: dict) -> list:
        f = _frame(r)
        seen = bool(f.seen[f.start])
        base = best_route(f.moves, f.shots, f.start, seen, depth)[0]
        return [base, [best_route(f.without(k), f.shots, f.start, seen, depth)[0] - base for k in range(len(r["defenders"]))]]

    return _each(snaps, of, "threat double, gains array<double>")


def pass_options(ball: np.ndarray, mates: np.ndarray, defenders: np.ndarray, most: int = MOST_PAIRS) -> list[tuple]:
    """(threat, hops, target, via, chance of the first pass, chance of the shot), best first: each pass to a mate, the own shot, and
    the `most` best of two passes. All pairs are costed at once: calls on a mate's few passes each cost more than the sums."""
    if not len(mates):
        return []

    def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = np.linalg.norm(b[:, None] - defenders[None], axis=2).min(1) if len(defenders) else np.full(len(b), np.inf)
        return chance(lane_terms(a, b, defenders).sum(1), reception(near), np.linalg.norm(b - a, axis=1))

    first, goal = passes(np.repeat(ball[None], len(mates), axis=0), mates), scoring_chance(mates)
    own = float(scoring_chance(ball[None])[0])
    out = [(float(p * g), 1, i, None, float(p), float(g)) for i, (p, g) in enumerate(zip(first, goal, strict=True))] + [(own, 0, None, None, 1.0, own)]
    i, j = np.nonzero(~np.eye(len(mates), dtype=bool))
    threat = first[i] * passes(mates[i], mates[j]) * goal[j]
    best = np.lexsort((j, i, -threat))[:most]
    pairs = [(t, 2, a, b, p, g) for t, a, b, p, g in zip(*(v[best].tolist() for v in (threat, i, j, first[i], goal[j])), strict=True)]
    return sorted(out + pairs, key=lambda o: (-o[0], o[1]))


def available(snaps: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """match_id, event_id, mates (in view, without the player on the ball), and options, best first; none where no mate is in view."""

    def of(r: dict) -> list:
        a = _points(r["attackers"], "actor")
        mates = a[a[:, 2] == 0, :2]
        mates = mates[inside(_points(r["area"]), mates)] if len(mates) else mates
        point = lambda k: None if k is None else {"x": float(mates[k][0]), "y": float(mates[k][1])}
        ball = np.array([r["ball"]["x"], r["ball"]["y"]], float)
        found = pass_options(ball, mates, _points(r["defenders"]), most)
        return [len(mates), [{"threat": t, "hops": h, "target": point(i), "via": point(j), "pass_chance": p, "shot_chance": g} for t, h, i, j, p, g in found]]

    point = "struct<x: double, y: double>"
    return _each(snaps, of, f"mates int, options array<struct<threat: double, hops: int, target: {point}, via: {point}, pass_chance: double, shot_chance: double>>")
