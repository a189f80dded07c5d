"""Quality: ordinal cumulative-link regression on graded ratings.

Words and word shapes of a whole text are hashed into one vector of log counts, scaled to length 1. One
weight vector z = x.w is shared by all grades, and ordered thresholds cut it: P(grade <= k) = sigmoid(t_k - z).
The expected grade and the probability of the upper tail come from the same z.

Training takes at most `most_rows` labelled documents (lowest hash of the id first), as vectors of `DIMS`
floats: that bounds what reaches the driver.

Defined results: null or empty text is the zero vector. Null grades and ids teach nothing; a document with
several grades has the lowest. With fewer than two grades every document has the one grade (or 0) and tail 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, rows_and_text

DIMS, SHAPES = 1024, 256  # the last SHAPES places are for word shapes
UPPER, LOWER, DIGIT, RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\dA-Z_]"), re.compile(r"\d"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    return RUN.sub(r"\1", DIGIT.sub("0", LOWER.sub("a", UPPER.sub("A", word))))


class Hasher:
    def __init__(self, most_memo: int = 150_000):
        self.memo: dict[str, tuple[int, int]] = {}
        self.most_memo = most_memo

    def _places(self, w: str) -> tuple[int, int]:
        if len(self.memo) > self.most_memo:
            self.memo.clear()
        out = self.memo[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % (DIMS - SHAPES), DIMS - SHAPES + zlib.crc32(shape(w).encode("utf-8", "replace")) % SHAPES
        return out

    def vector(self, text: str | None) -> np.ndarray:
        ws = (text or "").split()
        if not ws:
            return np.zeros(DIMS, np.float32)
        memo, places = self.memo, self._places
        at = np.array([memo.get(w) or places(w) for w in ws]).ravel()
        x = np.log1p(np.bincount(at, minlength=DIMS)).astype(np.float32)
        return x / np.linalg.norm(x)


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade) for rows of x."""
        z = x @ self.weights
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))
        return np.diff(np.column_stack([np.zeros(len(z)), below, np.ones(len(z))]), axis=1)


def fit(x: np.ndarray, y: np.ndarray, grades: list[int], rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> Ordinal:
    """Adam on the ordinal likelihood; gaps between thresholds are exponentials, so they stay ordered."""
    k = len(grades) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y)
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n, d = x.shape
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))
        z = x @ p[:d]
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = lambda u: 1 / (1 + np.exp(-np.clip(u, -30, 30)))
        hi, lo = s(edge[y + 1] - z), s(edge[y] - z)
        mass = np.maximum(hi - lo, 1e-9)
        dh, dl = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        gz = (dh - dl) / n  # of the loss with respect to z
        gc = np.zeros(k + 2)
        np.add.at(gc, y + 1, -dh / n)
        np.add.at(gc, y, dl / n)
        gc = gc[1:-1]
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([x.T @ gz + ridge * p[:d], tail[:1], tail[1:] * np.exp(p[d + 1 :])])
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(grades, p[:d], np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])])))


def train(documents: DataFrame, labels: DataFrame, usable, most_rows: int = 4000) -> Ordinal:
    """A model from the labelled documents for which `usable`, a condition on doc_id, holds."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("grade")).where("doc_id is not null and grade is not null").where(usable).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "grade")  # most_rows bounds the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for rb in pieces(batches, "text"):
            x = [h.vector(t).tobytes() for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), rb.column("grade")], names=["x", "grade"])

    got = sample.mapInArrow(run, "x binary, grade int").limit(most_rows).toArrow()
    raw = np.array(got.column("grade").to_pylist(), int)
    grades = sorted(set(raw.tolist()))
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(DIMS), np.zeros(0))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
    return fit(x, np.searchsorted(grades, raw), grades)


def grade(documents: DataFrame, model: Ordinal, least: int | None = None, keep_at: float = 0.3) -> DataFrame:
    """doc_id, expected_grade, tail (probability of grade `least`, the highest by default, or more) and kept."""
    source = rows_and_text(documents, ["doc_id"])
    least = model.grades[-1] if least is None else least
    values = np.array(model.grades, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for rb in pieces(batches, "text"):
            p = model.probabilities(np.array([h.vector(t) for t in rb.column("text").to_pylist()], np.float64).reshape(-1, DIMS))
            yield pa.RecordBatch.from_arrays([rb.column("row"), pa.array(p @ values), pa.array(p[:, values >= least].sum(axis=1))], names=["row", "expected_grade", "tail"])

    schema = T.StructType([source.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])
    return source.mapInArrow(run, schema).select("row.doc_id", "expected_grade", "tail", (F.col("tail") >= keep_at).alias("kept"))
