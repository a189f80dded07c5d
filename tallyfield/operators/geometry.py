"""Freeze frames: who stands where, what lies between the ball and the goal, shape of the defence. Arrays of points stay in
their row; all is expressions on them, without Python.

A snapshot: event_id, ball struct<x,y>, defenders array<struct<x,y,keeper>>, attackers array<struct<x,y,actor>>, area
array<struct<x,y>>, all in the frame of the side that attacks x = 120.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pitch, fitted constants of passes (intercept, lane, reception, length, length squared / 100) and shots
# (intercept, distance, lateral), widths of interference.
LENGTH, WIDTH, GOAL_Y, BOX_X, BOX_HALF = 120.0, 80.0, 40.0, 102.0, 22.0
PASS = (3.4747, -1.4393, -3.0287, -0.0141, -0.0533)
SHOT = (-0.9316, -0.08619, -0.04681)
LANE_SIGMA, RECEPTION_SIGMA = 1.25, 3.0
FLAGS = (("line_height", 1), ("space_behind", 1), ("max_lateral_gap", 1), ("between_lines_gap", 1), ("ballside_ratio", 1), ("block_depth", 1), ("nearest_defender", 1), ("overload", 1))


def snapshots(events: DataFrame, frames: DataFrame, areas: DataFrame) -> DataFrame:
    """One row for each event with a place, a team in possession and a visible defender. Events of the side out of
    possession are turned round, so that the attack always goes to x = 120."""
    p = F.struct("teammate", "actor", "keeper", "x", "y")
    f = frames.groupBy("match_id", "event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", p.alias("p")))), lambda r: r["p"]).alias("players"))
    e = events.where("x is not null and y is not null and possession_team_id is not null").join(f, ["match_id", "event_id"]).join(areas, ["match_id", "event_id"], "left")
    mine = F.coalesce(F.col("team_id") == F.col("possession_team_id"), F.lit(False))
    turn = lambda x, y: (F.when(mine, x).otherwise(LENGTH - x), F.when(mine, y).otherwise(WIDTH - y))

    def point(q: Column, *more: str) -> Column:
        x, y = turn(q["x"], q["y"])
        return F.struct(x.alias("x"), y.alias("y"), *(q[m].alias(m) for m in more))

    theirs = lambda q: q["teammate"] != mine
    flat = F.from_json("visible_area", "array<double>")
    corner = lambda i: F.struct(*(c.alias(n) for c, n in zip(turn(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)), "xy", strict=True)))
    area = F.when(F.size(flat) >= 6, F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), corner))
    bx, by = turn(F.col("x"), F.col("y"))
    s = e.select("match_id", "event_id", "type", "possession", F.struct(bx.alias("x"), by.alias("y")).alias("ball"), F.transform(F.filter("players", theirs), lambda q: point(q, "keeper")).alias("defenders"),
        F.transform(F.filter("players", lambda q: ~theirs(q)), lambda q: point(q, "actor")).alias("attackers"), area.alias("area"))
    return s.where(F.size("defenders") > 0)


def visible(area: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon: crossings of a ray are odd."""
    n = F.size(area)

    def crosses(i: Column) -> Column:
        a, b = F.get(area, i), F.get(area, (i + 1) % n)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def _apart(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def lane_pressure(x0: Column, y0: Column, x1: Column, y1: Column, defenders: Column, sigma: float = LANE_SIGMA) -> Column:
    """Interference of defenders along a segment, each by the distance to its nearest point on it."""
    dx, dy = x1 - x0, y1 - y0
    long = F.greatest(dx * dx + dy * dy, F.lit(1e-9))

    def one(d: Column) -> Column:
        t = F.least(F.greatest(((d["x"] - x0) * dx + (d["y"] - y0) * dy) / long, F.lit(0.0)), F.lit(1.0))
        return F.exp(-0.5 * F.pow(_apart(d["x"], d["y"], x0 + t * dx, y0 + t * dy) / sigma, 2))

    return _sum(F.transform(defenders, one))


def reception_pressure(x: Column, y: Column, defenders: Column, sigma: float = RECEPTION_SIGMA) -> Column:
    """Interference of the nearest defender where a pass arrives."""
    near = F.array_min(F.transform(defenders, lambda d: _apart(d["x"], d["y"], x, y)))
    return F.coalesce(F.exp(-0.5 * F.pow(near / sigma, 2)), F.lit(0.0))


def pass_success(lane: Column, reception: Column, length: Column) -> Column:
    z = PASS[0] + PASS[1] * lane + PASS[2] * reception + PASS[3] * length + PASS[4] * length * length / 100
    return 1 / (1 + F.exp(-z))


def shot_probability(x: Column, y: Column) -> Column:
    p = F.exp(SHOT[0] + SHOT[1] * _apart(x, y, F.lit(LENGTH), F.lit(GOAL_Y)) + SHOT[2] * F.abs(y - GOAL_Y))
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(0.999))


def features(snaps: DataFrame) -> DataFrame:
    """14 figures of a defence's shape; null where no outfield defender is seen."""
    x, y = F.col("ball.x"), F.col("ball.y")
    d, a = F.col("defenders"), F.col("attackers")
    s = snaps.withColumn("out", F.filter(d, lambda q: ~q["keeper"])).withColumn("back", F.slice(F.sort_array(F.transform(F.filter(d, lambda q: ~q["keeper"]), lambda q: F.struct((-q["x"]).alias("deep"), q["y"].alias("y")))), 1, 4))
    o, b = F.col("out"), F.col("back")
    of = lambda arr, c: F.transform(arr, lambda q: q[c])
    gap = lambda v: F.array_max(F.zip_with(F.slice(v, 2, 99), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda p, q: p - q))
    goalside = F.size(F.filter(d, lambda q: q["x"] > x)).cast("double")
    ahead = F.size(F.filter(a, lambda q: q["x"] > x)).cast("double")
    some = F.size(o) > 0
    cols = {
        "line_height": -_sum(of(b, "deep")) / F.size(b), "space_behind": LENGTH + F.array_min(of(b, "deep")), "block_depth": F.array_max(of(o, "x")) - F.array_min(of(o, "x")), "block_width": F.array_max(of(o, "y")) - F.array_min(of(o, "y")),
        "max_lateral_gap": F.when(F.size(b) >= 2, gap(F.array_sort(of(b, "y")))).otherwise(WIDTH), "between_lines_gap": F.when(F.size(o) >= 2, gap(F.array_sort(of(o, "x")))).otherwise(LENGTH),
        "ballside_ratio": F.size(F.filter(o, lambda q: (q["y"] - WIDTH / 2) * (y - WIDTH / 2) >= 0)) / F.size(o), "defenders_goalside": goalside, "nearest_defender": F.array_min(F.transform(d, lambda q: _apart(q["x"], q["y"], x, y))),
        "lane_to_goal": lane_pressure(x, y, F.lit(LENGTH), F.lit(GOAL_Y), d), "box_defenders": F.size(F.filter(d, lambda q: (q["x"] >= BOX_X) & (F.abs(q["y"] - GOAL_Y) <= BOX_HALF))).cast("double"),
        "attackers_goalside": ahead, "overload": ahead - goalside, "n_visible": (F.size(d) + F.size(a)).cast("double"),
    }
    return s.select("match_id", "event_id", *(F.when(some, c).alias(k) for k, c in cols.items()))


def typology(table: DataFrame, reference: DataFrame, percent: float = 0.85) -> DataFrame:
    """Flags of a snapshot: a figure at or above the reference's percentile."""
    limits = F.broadcast(reference.agg(*(F.percentile(k, F.lit(percent)).alias(f"{k}_at") for k, _ in FLAGS)))
    return table.crossJoin(limits).select("match_id", "event_id", *((F.col(k) >= F.col(f"{k}_at")).alias(k) for k, _ in FLAGS))
