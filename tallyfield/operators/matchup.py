"""Chains against an opponent, graph measures of region moves, and what denying a link costs.

Chains stay in long form until the solve. Fixtures bound the pairs; a team's dense chain (30 x 32) is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.seasons import season_of
from .chain import league_chain, team_chains

CLIP = (0.25, 4.0)  # fixed values: bounds of an opponent's ratio to the league
REGIONS = 15
X_CENTRES, Y_CENTRES = (10, 30, 50, 70, 90, 110), (9, 24, 40, 56, 71)  # fixed values: middles of zones


def _middle(z: str, along: str) -> str:
    index, values = (f"floor({z} / 5)", X_CENTRES) if along == "x" else (f"({z} % 5)", Y_CENTRES)
    return "(case " + " ".join(f"when {index} = {i} then {v}.0" for i, v in enumerate(values)) + " end)"


def middle_crossing(z0: str, z1: str, line: int = 80) -> str:
    """Height at which the line between two zones' middles crosses `line`. Text for Spark and DuckDB alike."""
    x0, x1, y0, y1 = (_middle(z, a) for a in "xy" for z in (z0, z1))
    return f"({y0} + ({y1} - {y0}) * ({line} - {x0}) / nullif({x1} - {x0}, 0))"


def conceded_counts(counts: DataFrame) -> DataFrame:
    """The same counts seen from the side that concedes them."""
    return counts.select("match_id", F.col("opp_id").alias("team_id"), F.col("team_id").alias("opp_id"), "z0", "out", "n", "xg")


def matchup_chains(counts: DataFrame, kappa: float | DataFrame) -> DataFrame:
    """team_id, opp_id, z0, out, p of every pair that meets: own chain times what the opponent allows, normalised."""
    pairs = counts.select("team_id", "opp_id").distinct()
    own = team_chains(counts, kappa)
    against = team_chains(conceded_counts(counts), kappa).select(F.col("team_id").alias("opp_id"), "z0", "out", F.col("p").alias("pb"))
    league = league_chain(counts).withColumnRenamed("p", "pl")
    j = pairs.join(own, "team_id").join(against, ["opp_id", "z0", "out"]).withColumn("season", season_of()).join(league, ["season", "z0", "out"])
    r = F.when(F.col("pl") > 0, F.least(F.greatest(F.col("pb") / F.col("pl"), F.lit(CLIP[0])), F.lit(CLIP[1]))).otherwise(1.0)
    j = j.withColumn("p", F.col("p") * r)
    return j.select("team_id", "opp_id", "z0", "out", (F.col("p") / F.sum("p").over(Window.partitionBy("team_id", "opp_id", "z0"))).alias("p"))


def observed_lanes(counts: DataFrame, line: int = 80) -> DataFrame:
    """Entries across a line by lane of the zones' middles."""
    pairs = counts.sparkSession.range(pitch.ZONES**2).selectExpr(f"cast(id div {pitch.ZONES} as int) as z0", f"cast(id % {pitch.ZONES} as int) as out")  # 900 rows
    pairs = pairs.where(f"{_middle('z0', 'x')} < {line} and {_middle('out', 'x')} >= {line}").select("z0", "out", F.expr(pitch.lane(middle_crossing("z0", "out", line))).alias("lane"))
    return counts.join(F.broadcast(pairs), ["z0", "out"]).groupBy("team_id", "lane").agg(F.sum("n").alias("n"))


def entropy_rates(graph: DataFrame) -> DataFrame:
    """Bits for each move between regions, weighted by use."""
    g = graph.withColumn("row", F.sum("n").over(Window.partitionBy("team_id", "r0"))).withColumn("t", F.sum("n").over(Window.partitionBy("team_id")))
    return g.groupBy("team_id").agg(F.round(-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("row"))), 6).alias("entropy"))


def reciprocity(graph: DataFrame) -> DataFrame:
    """How much of the flow between regions comes back: each unordered pair is one group."""
    g = graph.where("r0 <> r1").groupBy("team_id", F.least("r0", "r1").alias("a"), F.greatest("r0", "r1").alias("b"))
    g = g.agg(F.sum("n").alias("gross"), F.abs(F.sum(F.when(F.col("r0") < F.col("r1"), F.col("n")).otherwise(-F.col("n")))).alias("net"))
    return g.groupBy("team_id").agg(F.round(1 - F.sum("net") / F.sum("gross"), 6).alias("reciprocity"))


def _matrix(g: pd.DataFrame) -> np.ndarray:
    m = np.zeros((REGIONS, REGIONS))
    np.add.at(m, (g["r0"].to_numpy(int), g["r1"].to_numpy(int)), g["n"].to_numpy(float))
    return m


def spectral_gap_of(m: np.ndarray) -> float:
    rows = m.sum(1, keepdims=True)
    p = np.where(rows > 0, m / np.maximum(rows, 1e-300), 1 / len(m))
    return float(1 - np.sort(np.abs(np.linalg.eigvals(p)))[-2])


def circulation_of(m: np.ndarray) -> float:
    """Share of squared net flow that no potential explains."""
    net = np.triu(m - m.T, 1)
    i, j = np.nonzero(np.triu(m + m.T, 1))
    if not len(i) or not (net[i, j] ** 2).sum():
        return float("nan")
    d = np.zeros((len(i), len(m)))
    d[np.arange(len(i)), i], d[np.arange(len(i)), j] = 1, -1
    y = net[i, j]
    rest = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
    return float((rest**2).sum() / (y**2).sum())


def graph_measures(graph: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Spectral gap and circulation of each team's region moves: at most 225 rows a group."""
    keys = keys or ["team_id"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(g)
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "spectral_gap": [round(spectral_gap_of(m), 6)], "circulation": [round(circulation_of(m), 6)]})

    return graph.select(*keys, "r0", "r1", "n").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} long" for k in keys) + ", spectral_gap double, circulation double")


def _region(z: np.ndarray) -> np.ndarray:
    return np.array([0, 0, 1, 1, 2, 2])[z // 5] * 5 + z % 5


def solve(move: np.ndarray, gain: np.ndarray, start: np.ndarray) -> float:
    return float(start @ np.linalg.solve(np.eye(len(move)) - move, gain))


def denied(move: np.ndarray, blocked: np.ndarray, adapt: bool) -> np.ndarray:
    """Moves without the blocked ones: these are lost, or go to what is left of the row where anything is."""
    kept = np.where(blocked, 0.0, move)
    if adapt:
        left = kept.sum(1)
        kept = kept * np.where(left > 0, move.sum(1) / np.maximum(left, 1e-300), 0.0)[:, None]
    return kept


def similar_teams(distances: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest teams of each; ties to the smaller id."""
    both = distances.select("team_a", "team_b", "distance").union(distances.select("team_b", "team_a", "distance"))
    place = F.row_number().over(Window.partitionBy("team_a").orderBy("distance", "team_b"))
    return both.withColumn("place", place).where(F.col("place") <= k).select(F.col("team_a").alias("team_id"), F.col("team_b").alias("other"), "place", "distance")
