"""Least squares and logistic fits whose sums are made where the rows are: each partition adds up its normal equations, once for each
resampled draw of matches, and one small system is solved for each draw. Rows carry y and an array x of the columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from . import geometry, replay
from .experiments import CLIP_USE, USUAL_LEAST, link_use, outcome_rows
from .scoring import POISSON

LINK_LEAST = 0.0025  # fixed value: least mean share of a link that is fitted
PRIMARY = ((11, 12), (13, 12))  # fixed values: links of the term that is a team's own
SECONDARY = (*PRIMARY, (10, 11), (14, 13))
RIDGE = 1e-9  # smaller eigenvalues of a system, against the largest, count as 0


@lru_cache(100_000)
def draws(match: object, reps: int) -> np.ndarray:
    """Weights of a match: 1, then those of `scoring.replicate_weight` in replicates 1 to reps."""
    u = np.array([int(hashlib.md5(f"{match}:{k}".encode()).hexdigest()[:8], 16) for k in range(1, reps + 1)], np.int64)
    return np.concatenate([[1.0], (u[:, None] >= np.array(POISSON)).sum(1)])


def normal_sums(rows: DataFrame, columns: int, reps: int = 0, unit: str = "match_id") -> DataFrame:
    """rep, n, a, b: sums of w x x' and w x y of each partition, x with a leading 1, as bytes of doubles."""
    size = columns + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros((reps + 1, size, size)), np.zeros((reps + 1, size)), 0
        for g in batches:
            if len(g):
                x = np.column_stack([np.ones(len(g)), np.stack(g["x"].to_numpy())])
                y, n = g["y"].to_numpy(float), n + len(g)
                w = np.stack([draws(m, reps) for m in g[unit]]) if reps else np.ones((len(g), 1))
                for r in range(reps + 1):
                    wx = x * w[:, r : r + 1]
                    a[r] += wx.T @ x
                    b[r] += wx.T @ y
        if n:
            yield pd.DataFrame({"rep": np.arange(reps + 1), "n": n, "a": [m.tobytes() for m in a], "b": [v.tobytes() for v in b]})

    return rows.select(F.col(unit).alias(unit), "y", "x").mapInPandas(run, "rep int, n long, a binary, b binary")


def least_squares(rows: DataFrame, columns: int, reps: int = 0, unit: str = "match_id") -> DataFrame:
    """rep, n, beta: the least-norm solution of each draw, intercept first."""
    size = columns + 1

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        a = np.sum([np.frombuffer(m).reshape(size, size) for m in g["a"]], axis=0)
        b = np.sum([np.frombuffer(v) for v in g["b"]], axis=0)
        return pd.DataFrame({"rep": [g["rep"].iloc[0]], "n": [g["n"].sum()], "beta": [np.linalg.pinv(a, RIDGE, hermitian=True) @ b]})

    return normal_sums(rows, columns, reps, unit).groupBy("rep").applyInPandas(solve, "rep int, n long, beta array<double>")


def logistic(rows: DataFrame, columns: int, penalty: float = 1.0, most_rounds: int = 50, within: float = 1e-9) -> np.ndarray:
    """Coefficients, intercept first, of P(y = 1), by reweighted least squares; all but the intercept are drawn to 0 by half their squares
    times `penalty`. Each round sums over the partitions once and brings one small system to the driver."""
    size = columns + 1
    beta = np.zeros(size)
    ridge = np.diag([0.0] + [penalty] * columns)
    for _ in range(most_rounds):

        def run(batches: Iterator[pd.DataFrame], beta=beta) -> Iterator[pd.DataFrame]:
            a, b = np.zeros((size, size)), np.zeros(size)
            for g in batches:
                if len(g):
                    x = np.column_stack([np.ones(len(g)), np.stack(g["x"].to_numpy())])
                    p = 1 / (1 + np.exp(-x @ beta))
                    a += (x * (p * (1 - p))[:, None]).T @ x
                    b += x.T @ (g["y"].to_numpy(float) - p)
            yield pd.DataFrame({"k": np.arange(size * size + size), "v": np.concatenate([a.ravel(), b])})

        sums = np.zeros(size * size + size)
        for r in rows.select("y", "x").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # columns squared rows
            sums[r["k"]] = r["v"]
        step = np.linalg.lstsq(sums[: size * size].reshape(size, size) + ridge, sums[size * size :] - ridge @ beta, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() <= within * max(1.0, np.abs(beta).max()):
            break
    return beta


def tested_links(use: DataFrame, units: DataFrame, least: float = LINK_LEAST) -> DataFrame:
    """k, r0, r1, usage: links between regions whose mean usual share over the units is `least` or more; at most 210."""
    n = units.agg(F.count("*").alias("units"))
    g = use.join(units.select("match_id", "team_id"), ["match_id", "team_id"], "left_semi").groupBy("r0", "r1").agg(F.sum("usual").alias("s")).crossJoin(F.broadcast(n))
    g = g.withColumn("usage", F.col("s") / F.col("units")).where(F.col("usage") >= least)
    return g.select((F.row_number().over(Window.orderBy("r0", "r1")) - 1).alias("k"), "r0", "r1", "usage")  # over at most 210 rows


def designed(use: DataFrame, units: DataFrame, links: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Units with y and x: how much more than usual each tested link was used (0 where it is hardly ever), and `extra` (match_id, team_id, z) last."""
    count = links.count()
    u = F.least(F.greatest(F.col("n") / F.col("all") / F.col("usual") - 1, F.lit(CLIP_USE[0])), F.lit(CLIP_USE[1]))
    used = use.where(F.col("usual") >= USUAL_LEAST).join(F.broadcast(links), ["r0", "r1"])  # at most 210 rows
    x = used.groupBy("match_id", "team_id").agg(F.map_from_entries(F.collect_list(F.struct("k", u.alias("u")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))) if count else F.array().cast("array<double>")
    out = units.join(x, ["match_id", "team_id"], "left").withColumn("x", dense)
    if extra is not None:
        out = out.join(extra, ["match_id", "team_id"]).withColumn("x", F.concat("x", F.array("z")))
    return out.select("match_id", "team_id", "y", "x"), count + (extra is not None)


def joint_slopes(use: DataFrame, units: DataFrame, links: DataFrame, reps: int = 200) -> DataFrame:
    """rep, r0, r1, usage, slope, n: slopes of y on the use of all tested links together, for all units (rep 0) and in draws of matches."""
    rows, count = designed(use, units, links)
    if not count:
        return links.selectExpr("0 as rep", "r0", "r1", "usage", "cast(null as double) as slope", "0L as n")
    fit = least_squares(rows, count, reps)
    return fit.join(F.broadcast(links)).select("rep", "r0", "r1", "usage", F.element_at("beta", F.col("k") + 2).alias("slope"), "n")


def link_effects(slopes: DataFrame, drops: DataFrame) -> DataFrame:
    """By link: its joint slope with a 5-95 % interval, usage, the planner's drops (r0, r1, adapting, losing), and whether the slope is between them."""
    g = slopes.groupBy("r0", "r1").agg(F.max("usage").alias("usage"), F.max(F.when(F.col("rep") == 0, F.col("slope"))).alias("slope"), *(F.percentile(F.when(F.col("rep") > 0, F.col("slope")), F.lit(q)).alias(k) for k, q in (("lo", 0.05), ("hi", 0.95))))
    j = g.join(drops, ["r0", "r1"], "left")
    return j.select("r0", "r1", *(F.round(c, 6).alias(c) for c in ("usage", "slope", "lo", "hi", "adapting", "losing")), F.col("slope").between(F.col("adapting"), F.col("losing")).alias("inside"))


def rank_agreement(slopes: DataFrame, drops: DataFrame) -> DataFrame:
    """One row: rank agreement of the joint slopes with the planner's mean drops and with plain usage, and of their difference, with 5-95 %
    intervals over the draws; the planner passes with 0.5, above 0, and above usage. Ranks are ordinal, ties by link."""
    j = slopes.join(drops, ["r0", "r1"]).withColumn("mid", (F.col("adapting") + F.col("losing")) / 2)
    rank = lambda c: F.row_number().over(Window.partitionBy("rep").orderBy(c, "r0", "r1"))  # noqa: E731  at most 210 rows
    j = j.withColumns({f"rank_{c}": rank(c) for c in ("slope", "mid", "usage")})
    r = lambda c: F.try_divide(F.covar_pop("rank_slope", f"rank_{c}"), F.stddev_pop("rank_slope") * F.stddev_pop(f"rank_{c}"))
    g = j.groupBy("rep").agg(F.count("*").alias("links"), r("mid").alias("model"), r("usage").alias("by_usage")).withColumn("difference", F.col("model") - F.col("by_usage"))
    one = lambda c: [F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c), *(F.percentile(F.when(F.col("rep") > 0, F.col(c)), F.lit(q)).alias(f"{c}_{k}") for k, q in (("lo", 0.05), ("hi", 0.95)))]
    t = g.agg(F.max("links").alias("links"), *(c for k in ("model", "by_usage", "difference") for c in one(k)))
    passes = F.coalesce((F.col("model") >= 0.5) & (F.col("model_lo") > 0) & (F.col("model") > F.col("by_usage")), F.lit(False))
    return t.select("links", *(F.round(f"{k}{e}", 6).alias(f"{k}{e}") for k in ("model", "by_usage", "difference") for e in ("", "_lo", "_hi")), passes.alias("passes"))


def league_drops(counts: DataFrame, starts: DataFrame, links: DataFrame) -> DataFrame:
    """r0, r1, adapting, losing: shares of the league's threat that go with each link if it finds another way and if not."""
    cells = counts.groupBy("z0", "out").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct((F.col("z0") * replay.WIDTH + F.col("out")).alias("c"), "n")).alias("cells"))
    z = counts.groupBy("z0").agg(F.sum("xg").alias("xg")).join(starts.groupBy("z0").agg(F.sum("n").alias("starts")), "z0", "full").fillna(0)
    zones = z.agg(F.collect_list(F.struct("z0", "xg", "starts")).alias("zones"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for r in g.to_dict("records"):
                chain = replay.league_of(*replay.sums(r["cells"], r["zones"]))
                rows.append((r["r0"], r["r1"], *replay.drops(chain, (r["r0"], r["r1"]))))
            yield pd.DataFrame(rows, columns=["r0", "r1", "adapting", "losing"])

    return links.select("r0", "r1").crossJoin(F.broadcast(cells)).crossJoin(F.broadcast(zones)).mapInPandas(run, "r0 int, r1 int, adapting double, losing double")


def excess_terms(counts: DataFrame, starts: DataFrame, units: DataFrame, kappa: float, links: tuple = SECONDARY) -> DataFrame:
    """match_id, team_id, e: for each link, what it is worth to the team's chain without the match beyond what it is worth to the league's
    without the match. Both are totals less the match: sparse lists of one match, one team and one league meet in a row."""
    pack_c = F.collect_list(F.struct((F.col("z0") * replay.WIDTH + F.col("out")).alias("c"), "n")).alias("cells")
    pack_z = F.collect_list(F.struct("z0", "xg", "starts")).alias("zones")

    def packed(name: str, *keys: str) -> DataFrame:
        c = counts.groupBy(*keys, "z0", "out").agg(F.sum("n").alias("n"))
        z = counts.groupBy(*keys, "z0").agg(F.sum("xg").alias("xg")).join(starts.groupBy(*keys, "z0").agg(F.sum("n").alias("starts")), [*keys, "z0"], "full").fillna(0, ["xg", "starts"])
        if not keys:
            return c.agg(pack_c).crossJoin(F.broadcast(z.agg(pack_z))).select(F.struct("cells", "zones").alias(name))
        return c.groupBy(*keys).agg(pack_c).join(z.groupBy(*keys).agg(pack_z), list(keys)).select(*keys, F.struct("cells", "zones").alias(name))

    j = units.select("match_id", "team_id").join(packed("mine", "match_id", "team_id"), ["match_id", "team_id"]).join(packed("team", "team_id"), "team_id").join(packed("match", "match_id"), "match_id").crossJoin(F.broadcast(packed("league")))
    kinds = dict(units.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for r in g.to_dict("records"):
                of = lambda k, r=r: replay.sums(r[k]["cells"], r[k]["zones"])
                less = lambda a, b, of=of: tuple(x - y for x, y in zip(of(a), of(b), strict=True))
                league = replay.league_of(*less("league", "match"))
                team = replay.shrunk(*less("team", "mine"), league, kappa)
                rows.append((r["match_id"], r["team_id"], [replay.cost(team, link) - replay.cost(league, link) for link in links]))
            yield pd.DataFrame(rows, columns=["match_id", "team_id", "e"])

    return j.mapInPandas(run, f"match_id {kinds['match_id']}, team_id {kinds['team_id']}, e array<double>")


def gamma_test(use: DataFrame, units: DataFrame, links: DataFrame, excess: DataFrame, tested: tuple = PRIMARY, reps: int = 200) -> DataFrame:
    """One row: does a link cost a team more where its own chain says so? The slope of the sum of use times excess over the tested links, beside
    the use of all links, with a 5-95 % interval over draws of matches; it passes above 0."""
    at = {link: k for k, link in enumerate(SECONDARY)}
    u = F.least(F.greatest(F.col("n") / F.col("all") / F.col("usual") - 1, F.lit(CLIP_USE[0])), F.lit(CLIP_USE[1]))
    which = F.create_map(*(F.lit(v) for a, b in tested for v in (a * 100 + b, at[a, b])))[F.col("r0") * 100 + F.col("r1")]
    met = use.where(F.col("usual") >= USUAL_LEAST).withColumn("at", which).where("at is not null").withColumn("u", u).join(excess, ["match_id", "team_id"])
    z = met.groupBy("match_id", "team_id").agg(F.sum(F.col("u") * F.get("e", F.col("at"))).alias("z"))
    z = units.select("match_id", "team_id").join(z, ["match_id", "team_id"], "left").fillna(0.0, ["z"])
    rows, count = designed(use, units, links, z)
    g = least_squares(rows, count, reps).withColumn("gamma", F.element_at("beta", -1))
    end = lambda q: F.round(F.percentile(F.when(F.col("rep") > 0, F.col("gamma")), F.lit(q)), 6)
    return g.agg(F.max("n").alias("n"), F.round(F.max(F.when(F.col("rep") == 0, F.col("gamma"))), 6).alias("gamma"), end(0.05).alias("lo"), end(0.95).alias("hi")).withColumn("passes", F.coalesce(F.col("lo") > 0, F.lit(False)))


def shot_fit(ev: DataFrame) -> DataFrame:
    """name, value: logarithm of xg as a line in distance and lateral distance to the goal, penalties left out."""
    s = ev.where("type = 'Shot' and coalesce(sub_type, '') <> 'Penalty' and xg is not null and x is not null and y is not null")
    d = F.sqrt(F.pow(F.col("x") - geometry.LENGTH, 2) + F.pow(F.col("y") - geometry.GOAL_Y, 2))
    rows = s.select("match_id", F.log(F.least(F.greatest("xg", F.lit(1e-4)), F.lit(1.0))).alias("y"), F.array(d, F.abs(F.col("y") - geometry.GOAL_Y)).alias("x"))
    names = F.array(*(F.lit(n) for n in ("intercept", "distance", "lateral")))
    return least_squares(rows, 2).select(F.explode(F.arrays_zip(names.alias("name"), F.col("beta").alias("value"))).alias("r")).select("r.name", F.round(F.col("r.value") + pitch.NUDGE, 6).alias("value"))


def pass_rows(snaps: DataFrame, ev: DataFrame) -> DataFrame:
    """match_id, y (the pass arrived), x: pressure on its lane, on the place it goes to, length, and length squared / 100."""
    p = ev.where("type = 'Pass' and end_x is not null and end_y is not null and team_id = possession_team_id").select("match_id", "event_id", "end_x", "end_y", F.col("outcome").isNull().cast("double").alias("y"))
    j = snaps.select("match_id", "event_id", "ball", "defenders").join(p, ["match_id", "event_id"])
    x, y = F.col("ball.x"), F.col("ball.y")
    size = F.sqrt(F.pow(F.col("end_x") - x, 2) + F.pow(F.col("end_y") - y, 2))
    return j.select("match_id", "y", F.array(geometry.lane_pressure(x, y, F.col("end_x"), F.col("end_y"), F.col("defenders")), geometry.reception_pressure(F.col("end_x"), F.col("end_y"), F.col("defenders")), size, size * size / 100).alias("x"))


def pass_fit(rows: DataFrame) -> DataFrame:
    """name, value: coefficients of the chance that a pass arrives, its Brier score and that of the mean. `rows` are read once a round: stage them."""
    beta = logistic(rows, 4)
    z = F.lit(float(beta[0])) + sum((F.get("x", F.lit(k)) * float(b) for k, b in enumerate(beta[1:])), F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    s = rows.agg(F.avg(F.pow(F.col("y") - p, 2)).alias("brier"), (F.avg("y") * (1 - F.avg("y"))).alias("brier_of_mean"))
    named = ", ".join(f"'{n}', cast({float(b)!r} as double)" for n, b in zip(("intercept", "lane", "reception", "length", "length_squared"), beta, strict=True))
    return s.selectExpr(f"stack(7, {named}, 'brier', brier, 'brier_of_mean', brier_of_mean) as (name, value)").select("name", F.round("value", 6).alias("value"))
