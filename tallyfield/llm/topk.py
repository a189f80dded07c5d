"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers and are packed, where they are read, into blocks: one row holds up to `block_rows`
vectors, near ones together. In a block each dimension has a list of its rows by value. For a query, lists are
read from the end that suits the sign of the query's component, those with most left to contribute first; rows
met for the first time are scored in full. Reading stops when the bound, the product with the values that come
next in each list, cannot reach the kth result so far. That result carries over from block to block. A block is
not read at all if its best values cannot reach it, nor if a ball around its centre that holds its rows cannot.

Candidate blocks are dealt to lanes and query blocks to groups; a lane meets each group once. Lanes grow with the
candidates and groups with the queries, so what a task holds, the results of one group, is bounded; blocks
are small rows in a plain join, so they are streamed. A query's results over lanes are ranked in a window over
k rows for each lane.

Scores are exact: sums run in doubles while these hold them, in 64-bit integers beyond, and in Python integers
beyond that. A component or score that 64 bits cannot hold is written as the nearest number that they can.

Defined results: vectors that are null or hold a null or a non-finite component take no part, as queries or
as candidates; neither do rows without id. Vectors of another length than the query's are no candidates of
it. Rows that repeat an id are candidates each, but never of their own id. Ties go to the smaller id. A query
of zeros has score 0 with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "block long, n int, dims int, ids binary, data binary"
HELD = 8  # blocks whose rows are put in order together
PIVOTS = 32
GROUP = 64  # query blocks that a lane meets at once
Best = list[tuple[int, int]]  # (-score, id) ascending


def near_together(data: np.ndarray, block_rows: int) -> Iterator[np.ndarray]:
    """Row numbers in blocks of rows that point the same way: by the nearest of some far-apart rows."""
    x = data.astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    nearest, closest = np.zeros(len(x), int), x @ x[0]
    for k in range(1, min(PIVOTS, len(x))):
        now = x @ x[closest.argmin()]
        nearest[now > closest] = k
        closest = np.maximum(closest, now)
    order = np.argsort(nearest, kind="stable")
    begin = 0
    for end in [*(np.flatnonzero(np.diff(nearest[order])) + 1).tolist(), len(x)]:
        if end - begin >= block_rows // 4 or end == len(x):
            for a in range(begin, end, block_rows):
                yield order[a : min(a + block_rows, end)]
            begin = end


def _packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """id and vector (array of long) as blocks of one length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def out(dims: int) -> Iterator[pa.RecordBatch]:
            nonlocal count
            got = held.pop(dims)
            ids, data = np.array([x[0] for x in got], "<i8"), np.array([x[1] for x in got], "<i8").reshape(len(got), dims)
            for pick in near_together(data, block_rows):
                count += 1
                cols = [
                    pa.array([(part << 32) + count]), pa.array([len(pick)], pa.int32()), pa.array([dims], pa.int32()),
                    pa.array([ids[pick].tobytes()], pa.binary()), pa.array([data[pick].tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "n", "dims", "ids", "data"])

        for rb in batches:
            for i, v in zip(rb.column("id").to_pylist(), rb.column("v").to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= HELD * block_rows:
                    yield from out(len(v))
        for dims in list(held):
            yield from out(dims)

    return rows.mapInArrow(run, BLOCK)


def _largest(data: np.ndarray) -> int:
    return max(abs(int(data.max(initial=0))), abs(int(data.min(initial=0))))


class CandidateBlock:
    """Vectors of a block with, for each dimension, the list of rows by value."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data, self.largest = ids, data, _largest(data)
        self.order = np.argsort(data, axis=0, kind="stable")  # ascending, one column for each dimension
        self.sorted = np.take_along_axis(data, self.order, axis=0)
        self.centre = data.mean(axis=0) if len(data) else np.zeros(data.shape[1])
        self.radius = float(np.linalg.norm(data - self.centre, axis=1).max(initial=0))
        self.scored = self.skipped = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, found: list[Best]) -> list[Best]:
        """Results so far of each query, with this block's rows taken in."""
        most = queries.shape[1] * self.largest * _largest(queries)
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
        data, lists, q = self.data.astype(kind), self.sorted.astype(kind), queries.astype(kind)
        edge = np.maximum(q * lists[-1], q * lists[0]) if len(data) else q  # what each list can contribute at most
        size = np.linalg.norm(queries.astype(np.float64), axis=1)
        ball = queries.astype(np.float64) @ self.centre + size * self.radius
        ball += 1 + 1e-9 * size * (np.linalg.norm(self.centre) + self.radius)  # more than rounding can take away
        out = []
        for v, top, around, i, best in zip(q, edge, ball.tolist(), own.tolist(), found, strict=True):
            if not len(data) or len(best) == k and (around < -best[-1][0] or int(top.sum()) < -best[-1][0]):
                self.skipped += 1
                out.append(best)
            else:
                out.append(self._descend(data, lists, v, top, i, k, best))
        return out

    def _descend(self, data: np.ndarray, lists: np.ndarray, q: np.ndarray, top: np.ndarray, own: int, k: int, best: Best) -> Best:
        n, kind_is_plain = len(data), data.dtype != object
        use = np.flatnonzero(q != 0)
        if not len(use):
            return self._taken(data, q, np.arange(n), own, k, best)
        down, q_use, edge = q[use] > 0, q[use], top[use].copy()
        last = q_use * np.where(down, lists[0, use], lists[-1, use])  # what a list contributes at its end
        depth, seen, step = np.zeros(len(use), int), np.zeros(n, bool), 32
        take = max(1, len(use) // 2)
        # A tie may still bring a smaller id, so reading goes on at equality.
        while len(best) < k or int(edge.sum()) >= -best[-1][0]:
            pick = np.argpartition(last - edge, take - 1)[:take] if kind_is_plain else np.argsort(last - edge, kind="stable")[:take]
            at = np.minimum(depth[pick, None] + np.arange(step), n - 1)
            rows = self.order[np.where(down[pick, None], n - 1 - at, at), use[pick, None]]
            met = seen.copy()
            met[rows.ravel()] = True
            fresh = np.flatnonzero(met != seen)
            if len(fresh):
                best = self._taken(data, q, fresh, own, k, best)
            seen = met
            depth[pick] += step
            if depth.max() >= n:  # one list is read to its end: every row is met
                rest = np.flatnonzero(~seen)
                return self._taken(data, q, rest, own, k, best) if len(rest) else best
            edge[pick] = q_use[pick] * lists[np.where(down[pick], n - 1 - depth[pick], depth[pick]), use[pick]]
            step *= 2
        return best

    def _taken(self, data: np.ndarray, q: np.ndarray, rows: np.ndarray, own: int, k: int, best: Best) -> Best:
        """Rows scored in full; the k best of these and the results so far."""
        self.scored += len(rows)
        score, ids = (data @ q)[rows] if 2 * len(rows) > len(data) and data.dtype != object else data[rows] @ q, self.ids[rows]
        keep = ids != own
        if len(best) == k:
            keep &= (score >= -best[-1][0]).astype(bool)
        score, ids = score[keep], ids[keep]
        if len(score) > k:
            top = np.lexsort((ids, -score)) if score.dtype != object else sorted(range(len(ids)), key=lambda r: (-score[r], ids[r]))
            score, ids = score[top[:k]], ids[top[:k]]
        return sorted([*best, *((-int(s), int(i)) for s, i in zip(score, ids, strict=True))])[:k]


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Results of each query block in each lane; rows of a lane and group follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray, list[Best]]] = {}
        at, last, block = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            for ids, _, found in state.values():
                rows = [(int(q), i, max(-(2**63), min(2**63 - 1, -s))) for q, best in zip(ids, found, strict=True) for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])
            state.clear()

        for rb in batches:
            for r in rb.to_pylist():
                if at != (key := (r["lane"], r["grp"], r["dims"])):
                    yield from out()
                    at = key
                if last != r["block"]:
                    data = np.frombuffer(r["data"], "<i8").reshape(r["n"], r["dims"])
                    last, block = r["block"], CandidateBlock(np.frombuffer(r["ids"], "<i8"), data)
                if r["q_block"] not in state:
                    ids = np.frombuffer(r["q_ids"], "<i8")
                    state[r["q_block"]] = ids, np.frombuffer(r["q_data"], "<i8").reshape(r["q_n"], r["dims"]), [[] for _ in ids]
                ids, queries, found = state[r["q_block"]]
                state[r["q_block"]] = ids, queries, block.search(queries, ids, k, found)
        yield from out()

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * by, F.lit(-9.2e18)), F.lit(9.2e18))).cast("long"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 2048, lane_rows: int = 65_536, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with every other row."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_column}`")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), scaled(v).alias("v"), is_query.alias("q"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    n, wide = size["n"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, math.ceil(n / lane_rows), min(wide, math.ceil(n / block_rows)))
    groups = max(1, math.ceil((size["q"] or 0) / (GROUP * block_rows)))
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    dealt = lambda column, count: F.pmod(F.xxhash64(column), F.lit(count)).cast("int")
    candidates = _packed(rows.select("id", "v"), block_rows).select("*", dealt("block", lanes).alias("lane"), every(groups, "grp"))
    blocks = _packed(rows.where("q").select("id", "v"), block_rows)
    queries = blocks.select(every(lanes, "lane"), dealt("block", groups).alias("grp"), "dims", *(F.col(c).alias(f"q_{c}") for c in ("block", "n", "ids", "data")))
    pairs = candidates.hint("merge").join(queries, ["lane", "grp", "dims"])
    found = _searched(pairs, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
