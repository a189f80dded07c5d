"""How well possession values foretell seasons they have not seen: each season's sparse counts are taken from the total, and what is left is
solved, all seasons in one grouped job. A prediction hangs on the zone alone, so scores are sums by zone; no event meets a prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .value import GRID, LOSS, NX, NY, SHOT, grid_zone, solved_grid

LEAST_ACTIONS = 1000  # fixed value: actions of a season that is held out
HOLDOUT_MODELS = ("markov", "markov_scaled", "zone_mean")


def value_sums(ev: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Cells (keys, z0, out, n, xg) and zones (keys, z0, n, y, yy): outcomes of open-play actions, and sums of the xg still to come in their possessions."""
    out = F.when(F.col("kind") == "move", grid_zone("end_x", "end_y")).when(F.col("kind") == "shot", SHOT).otherwise(LOSS)
    a = ev.where("kind is not null").select(*keys, grid_zone("x", "y").alias("z0"), out.alias("out"), F.when(F.col("kind") == "shot", F.coalesce("xg", F.lit(0.0))).otherwise(0.0).alias("xg"), F.col("xg_after").alias("y"))
    a = a.where("z0 is not null")
    cells = a.where("out is not null").groupBy(*keys, "z0", "out").agg(F.count("*").alias("n"), F.sum("xg").alias("xg"))
    return cells, a.groupBy(*keys, "z0").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))


def held_out_values(cells: DataFrame, key: str) -> DataFrame:
    """key, zone, value: values of all zones from every other season."""
    own = cells.select(key, F.struct((F.col("z0") * (GRID + 2) + F.col("out")).alias("c"), "n", "xg").alias("r")).groupBy(key).agg(F.collect_list("r").alias("own"))
    total = cells.groupBy("z0", "out").agg(F.sum("n").alias("n"), F.sum("xg").alias("xg")).agg(F.collect_list(F.struct((F.col("z0") * (GRID + 2) + F.col("out")).alias("c"), "n", "xg")).alias("total"))  # at most 37,000 cells
    kind = dict(cells.dtypes)[key]

    def run(batches):
        for g in batches:
            for r in g.to_dict("records"):
                c, x = np.zeros(GRID * (GRID + 2)), np.zeros(GRID * (GRID + 2))
                for name, sign in (("total", 1), ("own", -1)):
                    at = np.array([q["c"] for q in r[name]], int)
                    c[at] += sign * np.array([q["n"] for q in r[name]], float)
                    x[at] += sign * np.array([q["xg"] for q in r[name]], float)
                value = solved_grid(c.reshape(GRID, GRID + 2), x.reshape(GRID, GRID + 2).sum(1))
                yield pd.DataFrame({key: [r[key]] * GRID, "zone": np.arange(GRID), "value": value})

    return own.crossJoin(F.broadcast(total)).mapInPandas(run, f"{key} {kind}, zone int, value double")


def holdout(ev: DataFrame, key: str = "season", least: int = LEAST_ACTIONS) -> DataFrame:
    """key, model, n, mse, skill (over the mean of the other seasons), calib (mean prediction over mean outcome), corr (0 where predictions do not
    vary): values, values scaled to the mean of their training data, and means by zone, each from the other seasons."""
    cells, zones = value_sums(ev, key)
    total = zones.groupBy("z0").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "y")))
    every = zones.select(key).distinct()
    grid = every.crossJoin(F.broadcast(total)).join(zones, [key, "z0"], "left").fillna(0, ["n"]).fillna(0.0, ["y", "yy"])  # at most 192 zones a season
    grid = grid.withColumns({"train_n": F.col("all_n") - F.col("n"), "train_y": F.col("all_y") - F.col("y")})
    grid = grid.join(held_out_values(cells, key).withColumnRenamed("zone", "z0"), [key, "z0"])
    means = grid.groupBy(key).agg(F.try_divide(F.sum("train_y"), F.sum("train_n")).alias("base"), F.try_divide(F.sum(F.col("train_n") * F.col("value")), F.sum("train_n")).alias("predicted"))
    grid = grid.join(means, key)
    scaled = F.col("value") * F.col("base") / F.greatest("predicted", F.lit(1e-9))
    model = F.array(*(F.struct(F.lit(name).alias("model"), p.alias("p")) for name, p in zip(HOLDOUT_MODELS, (F.col("value"), scaled, F.coalesce(F.try_divide("train_y", "train_n"), F.col("base"))), strict=True)))
    m = grid.withColumn("m", F.explode(model)).select(key, "n", "y", "yy", "base", "m.*")
    p, n = F.col("p"), F.col("n")
    s = m.groupBy(key, "model").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"), F.sum(n * p).alias("p"), F.sum(n * p * p).alias("pp"), F.sum(F.col("y") * p).alias("py"), F.max("base").alias("base")).where(F.col("n") >= least)
    mse = (F.col("yy") - 2 * F.col("py") + F.col("pp")) / n
    mse0 = (F.col("yy") - 2 * F.col("base") * F.col("y") + n * F.col("base") * F.col("base")) / n
    spread = F.col("pp") / n - F.pow(F.col("p") / n, 2)
    corr = F.when(spread > 1e-18, F.try_divide(F.col("py") / n - F.col("p") / n * F.col("y") / n, F.sqrt(spread * (F.col("yy") / n - F.pow(F.col("y") / n, 2))))).otherwise(0.0)
    return s.select(key, "model", "n", mse.alias("mse"), (1 - F.try_divide(mse, mse0)).alias("skill"), F.try_divide("p", "y").alias("calib"), corr.alias("corr"))


def monotone_share(values: DataFrame) -> DataFrame:
    """One row: share of neighbouring columns of the grid whose mean value rises toward the goal. values: zone, value."""
    c = values.groupBy(F.floor(F.col("zone") / NY).cast("int").alias("x")).agg(F.avg("value").alias("v"))
    j = c.alias("a").join(c.alias("b"), F.col("b.x") == F.col("a.x") + 1)
    return j.agg((F.sum((F.col("b.v") > F.col("a.v")).cast("int")) / F.lit(NX - 1)).alias("share"))
