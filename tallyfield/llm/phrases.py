"""Collocations by hierarchical pair naming.

Texts become sequences of word ids, in chunks of bounded size. A level replaces each two adjacent ids of frequent
(k-1)-grams by the id of their pair: a chunk names its pairs locally and sends them, packed by bucket of the pair's hash,
to where counts of all chunks meet; frequent pairs get a global id there, which goes back to the chunks that hold them.
The two ids that make a pair are its parents: the phrase without its last and without its first word. Counts of all
beginnings and ends of a phrase are inherited along them, and so is the question whether a longer phrase takes it in.

Every word of every text is counted. Parts of a frequent phrase are frequent, so that no pair is lost. A task holds one
chunk or one bucket at a time. Null text is empty, null lang `und`, repeated rows count each, null ids matter not; an empty
table gives an empty table; of the documents' columns only lang and text are read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, pieces, staged

CHUNK = 8 << 20  # bytes of text whose ids one row holds
BUCKET = 16 << 20  # bytes of text for each bucket of names
LEAST_BUCKETS = 64
SALT = 64
UNNAMED = -1

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
SENT = pa.schema([("chunk", pa.int64()), ("seq", pa.binary()), ("bucket", pa.int64()), ("first", pa.int32()), ("keys", pa.list_(pa.binary())), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())])
SENT_SQL = "chunk long, seq binary, bucket long, first int, keys array<binary>, left binary, right binary, n binary"
NAMED = pa.schema([("chunk", pa.int64()), ("local", pa.binary()), ("global", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
NAMED_SQL = "chunk long, local binary, global binary, id long, left long, right long, lang string, word string, n long"


def packed(ids: np.ndarray) -> bytes:
    """Ids in four bytes where they fit, else in eight; the reader knows how many there are."""
    return ids.astype("<u4" if not len(ids) or ids.max() < 2**32 else "<u8").tobytes()


def unpacked_ids(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(count, 1) or 4}").astype(np.int64)


def _rows(schema: pa.Schema, **columns: list) -> pa.Table:
    size = len(next(iter(columns.values())))
    return pa.table([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the names by bucket, place of each in it, and (bucket, begin, end)."""
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    found, begins = np.unique(bucket[order], return_index=True)
    return order, place, list(zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True))


class WordChunk:
    """Local ids of words by lang, and the sequence of a chunk's texts."""

    def __init__(self) -> None:
        self.ids: dict[str, dict[bytes, int]] = {}
        self.fresh, self.parts, self.size = itertools.count(), [], 0

    def add(self, lang: str | None, text: bytes | None) -> None:
        lang = "und" if lang is None else lang
        ids = self.ids.get(lang)
        if ids is None:
            ids = self.ids[lang] = defaultdict(self.fresh.__next__, {b".": UNNAMED})
        words = list(filter(None, (text or b"").translate(FOLD).replace(b".", b" . ").split(b" ")))
        words.append(b".")
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.size += len(text or b"")

    def rows(self, chunk: int, buckets: int) -> pa.Table:
        seq = np.concatenate([*self.parts, np.zeros(0, np.int32)])
        keys: list = [None] * next(self.fresh)
        for lang, ids in self.ids.items():
            head = lang.encode() + b"\t"
            for w, i in ids.items():
                if i >= 0:
                    keys[i] = head + w
        order, place, cuts = _by_bucket(np.fromiter((zlib.crc32(k) for k in keys), np.int64, len(keys)) % buckets)
        n = np.bincount(seq[seq >= 0], minlength=len(keys))[order].astype("<i4")
        seq = np.where(seq >= 0, place[seq], UNNAMED).astype("<i4") if len(keys) else seq.astype("<i4")
        sorted_keys = [keys[i] for i in order.tolist()]
        data = [None, *(n[a:b].tobytes() for _, a, b in cuts)]
        return _rows(SENT, chunk=[chunk] * len(data), seq=[seq.tobytes(), *[None] * len(cuts)], bucket=[None, *(x for x, _, _ in cuts)], first=[None, *(a for _, a, _ in cuts)], keys=[None, *(sorted_keys[a:b] for _, a, b in cuts)], n=data)


def _words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, chunk = TaskContext.get().partitionId(), 0, WordChunk()
        for rb in pieces(batches, "text"):
            for lang, text in zip(rb.column("lang").to_pylist(), rb.column("text").cast(pa.binary()).to_pylist(), strict=True):
                chunk.add(lang, text)
                if chunk.size >= CHUNK:
                    yield from chunk.rows(part << 32 | count, buckets).to_batches()
                    count, chunk = count + 1, WordChunk()
        if chunk.parts:
            yield from chunk.rows(part << 32 | count, buckets).to_batches()

    return run


def _bucket_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % buckets


def _distinct_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct pair, and every row's number among them."""
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    return order[new], codes


def _pairs(buckets: int, last: bool):
    """Relabel a chunk by the global ids that its names were given, and name its adjacent pairs."""

    def run(sequences: pa.Table, names: pa.Table) -> pa.Table:
        if not sequences.num_rows or not names.num_rows:
            return _rows(SENT, chunk=[])
        seq = np.frombuffer(sequences.column("seq")[0].as_py(), "<i4")
        globals_ = np.full(int(seq.max(initial=-1)) + 2, UNNAMED, np.int64)  # the last place is for UNNAMED
        for local, name in zip(names.column("local").to_pylist(), names.column("global").to_pylist(), strict=True):
            at = np.frombuffer(local, "<i4")
            globals_[at] = unpacked_ids(name, len(at))
        ids = globals_[seq]
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if not len(at):
            return _rows(SENT, chunk=[])
        left, right = ids[at], ids[at + 1]
        one, codes = _distinct_pairs(left, right)
        order, place, cuts = _by_bucket(_bucket_of(left[one], right[one], buckets))
        n = np.bincount(codes, minlength=len(one))[order].astype("<i4")
        left, right = left[one][order], right[one][order]
        head: list = []
        if not last:
            out = np.full(len(seq), UNNAMED, "<i4")
            out[at] = place[codes]
            named = out >= 0
            named[1:] |= named[:-1].copy()  # of unnamed places in a row only the first stays
            head = [out[named].tobytes()]
        pad = [None] * len(head)
        chunk = sequences.column("chunk")[0].as_py()
        return _rows(SENT, chunk=[chunk] * (len(head) + len(cuts)), seq=head + [None] * len(cuts), bucket=pad + [x for x, _, _ in cuts], first=pad + [a for _, a, _ in cuts],
                     left=pad + [packed(left[a:b]) for _, a, b in cuts], right=pad + [packed(right[a:b]) for _, a, b in cuts], n=pad + [n[a:b].tobytes() for _, a, b in cuts])

    return run


def _names(least: int, buckets: int):
    """Count the names of one bucket over all chunks; frequent ones get an id, which each chunk that holds them is told."""

    def run(sent: pa.Table) -> pa.Table:
        bucket = sent.column("bucket")[0].as_py()
        parts = [np.frombuffer(x, "<i4") for x in sent.column("n").to_pylist()]
        n, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        words = sent.column("keys")[0].as_py() is not None
        if words:
            keys = pa.chunked_array([x.flatten() for x in sent.column("keys").chunks]).combine_chunks().dictionary_encode()
            codes, count = keys.indices.to_numpy(zero_copy_only=False), len(keys.dictionary)
        else:
            left, right = (np.concatenate([unpacked_ids(x, len(p)) for x, p in zip(sent.column(c).to_pylist(), parts, strict=True)]) for c in ("left", "right"))
            one, codes = _distinct_pairs(left, right)
            count = len(one)
        total = np.zeros(count, np.int64)
        np.add.at(total, codes, n)
        kept = np.flatnonzero(total >= least)
        ids = np.full(count, UNNAMED, np.int64)
        ids[kept] = np.arange(len(kept)) * buckets + bucket
        out = []
        mine = ids[codes]
        told: dict[str, list] = {"chunk": [], "local": [], "global": []}
        for chunk, first, end, size in zip(sent.column("chunk").to_pylist(), sent.column("first").to_pylist(), ends.tolist(), map(len, parts), strict=True):
            part = mine[end - size : end]
            at = np.flatnonzero(part >= 0)
            if len(at):
                told["chunk"].append(chunk)
                told["local"].append((at + first).astype("<i4").tobytes())
                told["global"].append(packed(part[at]))
        out.append(_rows(NAMED, **told))
        if words:
            cut = [k.rpartition(b"\t") for k in keys.dictionary.to_pylist()]
            out.append(_rows(NAMED, id=ids[kept].tolist(), lang=[cut[i][0].decode() for i in kept.tolist()], word=[cut[i][2].decode() for i in kept.tolist()], n=total[kept].tolist()))
            spoken: dict[bytes, int] = defaultdict(int)
            for (lang, _, _), x in zip(cut, total.tolist(), strict=True):
                spoken[lang] += x
            out.append(_rows(NAMED, lang=[x.decode() for x in spoken], n=list(spoken.values())))
        else:
            out.append(_rows(NAMED, id=ids[kept].tolist(), left=left[one][kept].tolist(), right=right[one][kept].tolist(), n=total[kept].tolist()))
        return pa.concat_tables(out)

    return run


def frequent(documents: DataFrame, least: int = 30, longest: int = 4) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of 1 to `longest` words that occur `least` times or more: for each length a table (id, lang, phrase, last, n,
    pre, suf, left, right), pre and suf being the counts of its beginnings and ends by length; and the words of each lang."""
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts may be long
    text = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    buckets = max(LEAST_BUCKETS, math.ceil((text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BUCKET))
    grams: list[DataFrame] = []
    sent = staged(text.mapInArrow(_words(buckets), SENT_SQL), "phrase-1")
    for k in range(1, longest + 1):
        found = staged(sent.where("bucket is not null").groupBy("bucket").applyInArrow(_names(least, buckets), NAMED_SQL), f"names-{k}")
        names = found.where("id is not null")
        if k == 1:
            spoken = found.where("id is null and chunk is null").groupBy("lang").agg(F.sum("n").alias("words"))
            one = F.array("n")
            grams.append(names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", one.alias("pre"), one.alias("suf"), "left", "right"))
        else:
            a, b = (grams[-1].select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side, columns in (("left", ("lang", "phrase", "pre")), ("right", ("last", "suf"))))
            rows = names.select("id", "left", "right", "n").join(a, "left").join(b, "right")
            rows = rows.select("id", F.col("lang_left").alias("lang"), F.concat_ws(" ", "phrase_left", "last_right").alias("phrase"), F.col("last_right").alias("last"), "n",
                               F.concat("pre_left", F.array("n")).alias("pre"), F.concat("suf_right", F.array("n")).alias("suf"), "left", "right")
            grams.append(staged(rows, f"grams-{k}"))
        if k < longest:
            told = found.where("chunk is not null").select("chunk", "local", "global")
            held = sent.where("seq is not null").select("chunk", "seq")
            before, sent = sent, staged(held.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_pairs(buckets, k + 1 == longest), SENT_SQL), f"phrase-{k + 1}")
            drop_stage(before)
    drop_stage(sent)
    return grams, spoken


def collocations(documents: DataFrame, least: int = 30, longest: int = 4, taken_in: int = 80, most: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` phrases of each lang whose weakest cut binds best.

    A phrase goes where a longer one that holds it has `taken_in` percent of its count: it is enough to ask those of one
    word more, for between the two stands one that is as frequent as the longer and holds the shorter."""
    grams, spoken = frequent(documents, least, longest)
    scored = []
    for k in range(2, longest + 1):
        g = grams[k - 1].select("id", "lang", "phrase", F.col("n").alias("a"), "pre", "suf")
        if k < longest:
            longer = grams[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            g = g.join(longer, "id", "left").where(F.expr(f"longer is null or cast(100 as decimal(20, 0)) * longer < cast({taken_in} as decimal(20, 0)) * a"))
        cut = F.expr(f"""array_min(transform(sequence(1, {k - 1}), k -> named_struct('score', cast({scale} as decimal(12, 0)) * cast(a as decimal(20, 0)) div cast(pre[k - 1] + suf[{k - 1} - k] as decimal(20, 0)),
            'k', k, 'l', pre[k - 1], 'r', suf[{k - 1} - k])))""")
        scored.append(g.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    every = scored[0]
    for df in scored[1:]:
        every = every.unionByName(df)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    every = every.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALT)))  # a lang is ranked in parts, then the bests of the parts
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return every.join(spoken, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
