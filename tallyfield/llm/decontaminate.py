"""Benchmark decontamination by an FM-index over each training shard.

A shard is a bounded run of documents in one task. Its words become symbols: words that no benchmark item
holds can stand in no window, so they all are the separator, and runs of known words that are shorter than
the shortest window are left out. Over the symbols of a shard:

* suffix array by prefix doubling, the Burrows-Wheeler transform, and a wavelet matrix whose bit ranks
  answer how often a symbol stands before a place;
* all windows of all items are searched backward at once, one rank step for each of their words;
* matches are located by walking to the nearest sampled suffix position;
* matched windows are merged into spans of words of each document.

Windows of the benchmark are made by Spark tasks in chunks of bounded size, as files in the shared folder. A task
reads one chunk after the other for the shard it holds, so neither the driver nor a task ever has them all.

Defined results: null or empty text has no words; an item without words has no window; an empty benchmark
hits nothing. Repeated items and documents count each. Null item ids are left out of the list of items.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, kept_between_tasks, pieces, rows_and_text, shared_file, staged

# ASCII letters and digits and all bytes of other characters make words; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class FmIndex:
    """Backward search over an array of symbols; a closing symbol below all others makes every rotation differ,
    so that walking back ends even where the text repeats itself throughout."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        text, symbols = np.append(text + 1, 0), symbols + 1
        n = len(text)
        sa = _suffixes(text)
        self.n, self.sample = n, sample
        bwt = text[(sa - 1) % n]
        self.less = np.zeros(symbols + 1, np.int64)
        self.less[1:] = np.cumsum(np.bincount(text, minlength=symbols))
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            r = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=r[1:])
            self.ranks.append(r)
            self.zeros.append(n - int(r[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        kept = sa % sample == 0
        self.mark = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=self.mark[1:])
        self.sampled = sa[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands in the transform before place `at`."""
        lo, hi = np.zeros_like(at), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            r, z = self.ranks[k], self.zeros[k]
            one = ((symbol >> level) & 1).astype(bool)
            a, b = r[lo].astype(np.int64), r[hi].astype(np.int64)
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b)
        return hi - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """Symbols of the transform at places `at`."""
        out, p = np.zeros(len(at), np.int64), at
        for k in range(self.levels):
            r, z = self.ranks[k], self.zeros[k]
            a = r[p].astype(np.int64)
            bit = r[p + 1] - a
            out = out << 1 | bit
            p = np.where(bit == 1, z + a, p - a)
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (right-aligned rows), all at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            s = patterns[live, width - 1 - k] + 1
            base = self.less[s]
            lo[live], hi[live] = base + self.rank(s, lo[live]), base + self.rank(s, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, row, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = row[live]
            hit = self.mark[r + 1] > self.mark[r]
            done = live[hit]
            out[done] = self.sampled[self.mark[row[done]]] + steps[done]
            live = live[~hit]
            if len(live):
                s = self.symbol(row[live])
                row[live] = self.less[s] + self.rank(s, row[live])
                steps[live] += 1
        return out % self.n


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array of the cyclic text by prefix doubling; only groups that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # place where the group begins
    k = 1
    while k < n:
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        sub = order[at]
        second = rank[(sub + k) % n]
        resort = np.lexsort((second, rank[sub]))
        sub, second = sub[resort], second[resort]
        order[at] = sub
        group = rank[sub]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        head[at] = new
        rank[sub] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        k *= 2
    return order


@dataclass
class Windows:
    """Windows of a chunk of items: vocabulary, distinct right-aligned patterns, their lengths and items."""

    vocab: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    shortest: int


def windows(items: list[tuple[object, str | None]], width: int) -> Windows | None:
    vocab: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
        for k in range(max(1, len(ids) - width + 1) if ids else 0):
            found.setdefault(tuple(ids[k : k + width]), set()).update([] if item_id is None else [str(item_id)])
    if not found:
        return None
    lengths = np.array([len(p) for p in found])
    patterns = np.zeros((len(found), width), np.int64)
    for k, p in enumerate(found):
        patterns[k, width - len(p) :] = p
    return Windows(vocab, patterns, lengths, [sorted(x) for x in found.values()], int(lengths.min()))


@dataclass
class _Doc:
    n_words: int
    spans: list[tuple[int, int]]
    items: set[str]


class Shard:
    """Documents of one task until there are enough symbols for an index."""

    def __init__(self, w: Windows):
        self.w, self.parts, self.place, self.n = w, [], [], 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.w.shortest:
                self.parts += [ids[a:b], np.zeros(1, np.int64)]
                self.place.append((self.n, doc, a))
                self.n += b - a + 1

    def hits(self) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document, first word, one past the last, items) of every occurrence of a window."""
        if not self.parts:
            return
        index = FmIndex(np.concatenate(self.parts), len(self.w.vocab) + 1)
        lo, hi = index.search(self.w.patterns, self.w.lengths)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        if not len(which):
            return
        before = np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        at = index.locate(np.repeat(lo, hi - lo) + np.arange(len(which)) - before)
        place = np.array(self.place, np.int64)
        run = np.searchsorted(place[:, 0], at, side="right") - 1
        doc, first = place[run, 1], place[run, 2] + at - place[run, 0]
        for d, i, k in zip(doc.tolist(), first.tolist(), which.tolist(), strict=True):
            yield d, i, i + int(self.w.lengths[k]), self.w.items[k]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(texts: list[str | None], chunks: list[Windows | str], shard_symbols: int = 1_000_000) -> list[_Doc]:
    """For each text its number of words, merged hit spans and items; texts are indexed shard by shard. Chunks are
    windows, or paths of files that hold them and are read one at a time."""
    split = [words(t) for t in texts]
    docs = [_Doc(len(ws), [], set()) for ws in split]
    for chunk in chunks:
        w = _read_chunk(chunk) if isinstance(chunk, str) else chunk
        get, shard = w.vocab.get, Shard(w)
        for d, ws in enumerate(split):
            if ws:
                shard.add(d, np.array([get(x, 0) for x in ws], np.int64))
            if shard.n >= shard_symbols or d == len(split) - 1:
                for doc, first, last, items in shard.hits():
                    docs[doc].spans.append((first, last))
                    docs[doc].items.update(items)
                shard = Shard(w)
    for d in docs:
        d.spans = merged(d.spans)
    return docs


@lru_cache(maxsize=1)
def _read_chunk(path: str) -> Windows:
    where, name = shared_file(path)
    with where.open_input_file(name) as f:
        return pickle.loads(f.read())  # written by `item_chunks`


kept_between_tasks("chunks", _read_chunk.cache_clear)


def item_chunks(benchmark: DataFrame, width: int, most_bytes: int = 8 << 20) -> list[str]:
    """Paths of files with the windows of the items, each of items of at most `most_bytes` of text (one item at least)."""
    spark = benchmark.sparkSession
    folder = fresh_path(spark, "benchmark-windows")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if w := windows(held, width):
                path = f"{folder}/{uuid.uuid4().hex}.windows"
                where, name = shared_file(path)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                with where.open_output_stream(name) as f:
                    f.write(pickle.dumps(w))
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for rb in batches:
            for i, text in zip(rb.column("item_id").to_pylist(), rb.column("text").to_pylist(), strict=True):
                if held and n + len(text or "") > most_bytes:
                    yield from out()
                    held, n = [], 0
                held.append((i, text))
                n += len(text or "")
        yield from out()

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").repartition(max(1, math.ceil(total / most_bytes)))
    # One short row for each chunk of several megabytes.
    return [r["path"] for r in staged(items.mapInArrow(run, "path string"), "benchmark-chunks").orderBy("path").collect()]


SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def find(documents: DataFrame, benchmark: DataFrame, width: int = 10, columns: list[str] | None = None, cut: bool = False) -> DataFrame:
    """`row` (a struct of `columns`, all by default), text, n_words, spans (merged, in words, end exclusive) and
    items for every document; with cut, the spans are cut from text. Documents stay in their place: no shuffle."""
    source = rows_and_text(documents, columns)
    chunks = item_chunks(benchmark, width)
    schema = T.StructType([source.schema["row"], source.schema["text"], T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text", keep="chunks"):
            texts = rb.column("text").to_pylist()
            found = search(texts, chunks)
            text = pa.array([cut_text(t, d.spans) for t, d in zip(texts, found, strict=True)], pa.string()) if cut else rb.column("text")
            spans = [[{"first": a, "last": b} for a, b in d.spans] for d in found]
            cols = [rb.column("row"), text, pa.array([d.n_words for d in found], pa.int64()), pa.array(spans, kind), pa.array([sorted(d.items) for d in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


def report(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated."""
    f = find(documents, benchmark, width, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return f.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    space = np.frombuffer(raw.translate(FOLD), np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """All columns of documents; hit spans are cut from the text, n_chars follows, documents without a word left
    by the cut go. Documents without a hit are as they were."""
    found = find(documents, benchmark, width, cut=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    left = found.where((F.size("spans") == 0) | (n_hit < F.col("n_words")))
    columns = [F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(documents.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns]
    return left.select(*columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
