"""Token ids in binary files: fixed-width bit packing with block offsets.

A shard holds documents in ascending doc_id order. Each id takes the fewest bits that the vocabulary needs.
Blocks of `BLOCK` ids are packed one after the other, so a shard is written as a stream; the footer has the
byte offset of each block, the documents' ids and their starts. Eight ids fill exactly `bits` bytes, which
lets numpy unpack a block with eight shifts, and any document be read from its blocks alone.

Layout: payload; footer: doc_id (int64), null flag (uint8), start in the shard (int64, one more than
documents), block offsets (int64, one more than blocks); trailer of 48 bytes: bits, documents, ids, blocks,
place of the footer (int64 each), magic.

Shards are written to a new name and the manifest, a Spark table, lists those of tasks that succeeded, so a
task that is run twice leaves at worst a file nobody reads.

Defined results: null and empty text is the closing id alone. Rows without doc_id come first. Repeated rows
are kept each. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, pieces, shared_file, staged
from .tokens import encoder

BLOCK = 8192
MAGIC = b"TFIDS001"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids (uint32, each under 2**bits, bits up to 24 for speed or 32) in bits each; the last byte group is padded."""
    if bits in (8, 16, 32):  # whole bytes: eight ids are bits bytes as they are
        out = np.zeros(-(-len(ids) // 8) * 8, f"<u{bits // 8}")
        out[: len(ids)] = ids
        return out.tobytes()
    n = -(-len(ids) // 8)
    lanes = np.zeros((n, 8), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((n, bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        v = lanes[:, k] << np.uint64(shift)
        for j in range(-(-(bits + shift) // 8)):
            out[:, byte + j] |= ((v >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack_ids(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    groups = np.frombuffer(raw, np.uint8).reshape(-1, bits)
    wide = np.zeros((len(groups), bits + 8), np.uint64)
    wide[:, :bits] = groups
    out = np.empty((len(groups), 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        v = np.zeros(len(groups), np.uint64)
        for j in range(-(-(bits + shift) // 8)):
            v |= wide[:, byte + j] << np.uint64(8 * j)
        out[:, k] = ((v >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.ravel()[:count]


class ShardWriter:
    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at, self.total = sink, bits, 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.ids: list[int] = []
        self.nulls: list[int] = []
        self.starts, self.offsets = [0], [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        a = np.frombuffer(ids, "<u4")
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.total += len(a)
        self.starts.append(self.total)
        self.held.append(a)
        self.n_held += len(a)
        if self.n_held >= 32 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        a = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(a) if last else len(a) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            raw = pack_ids(a[i : min(i + BLOCK, whole)], self.bits)
            self.sink.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.held, self.n_held = [a[whole:]], len(a) - whole

    def close(self) -> None:
        self._flush(True)
        foot = self.at
        for x, kind in ((self.ids, "<i8"), (self.nulls, "u1"), (self.starts, "<i8"), (self.offsets, "<i8")):
            self.sink.write(np.array(x, kind).tobytes())
        self.sink.write(np.array([self.bits, len(self.ids), self.total, len(self.offsets) - 1, foot], "<i8").tobytes() + MAGIC)


@dataclass
class ShardReader:
    """Random access to one shard; only the footer and the blocks asked for are read."""

    source: pa.NativeFile

    def __post_init__(self):
        end = self.source.size()
        tail = self.source.read_at(48, end - 48)
        if tail[40:] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, n, self.total, blocks, foot = np.frombuffer(tail[:40], "<i8").tolist()
        raw = self.source.read_at(end - 48 - foot, foot)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, "u1", n, 8 * n)
        self.starts = np.frombuffer(raw, "<i8", n + 1, 9 * n)
        self.offsets = np.frombuffer(raw, "<i8", blocks + 1, 9 * n + 8 * (n + 1))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        raw = self.source.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        return unpack_ids(raw, self.bits, min(b * BLOCK, self.total) - a * BLOCK)[start - a * BLOCK : stop - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents as shards; the manifest: shard (order), path, n_docs, n_tokens, before (ids in earlier shards)."""
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    # Text and place of a row take part, so that ids that repeat, or are null, fill as many shards as they need.
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("place")]
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"))
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, end_id)
        writer, sink = None, None
        shard = TaskContext.get().partitionId()
        where, root = shared_file(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        try:
            for rb in pieces(batches, "text", 4 << 20, "tokens"):
                if writer is None:
                    where.create_dir(root, recursive=True)
                    sink = where.open_output_stream(name)
                    writer = ShardWriter(sink, bits_for(e.vocab))
                for doc_id, text in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist(), strict=True):
                    writer.add(doc_id, e.ids(text))
            if writer:
                writer.close()
        finally:
            if sink:
                sink.close()
        if writer:
            cols = [[shard], [f"{folder}/{name.rpartition('/')[2]}"], [len(writer.ids)], [writer.total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "path", "n_docs", "n_tokens"])

    manifest = staged(parts.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    # One row for each shard, so one task may sum them up.
    upto = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return manifest.withColumn("before", upto - F.col("n_tokens"))


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, little-endian 32-bit) out of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                where, name = shared_file(row["path"])
                with where.open_input_file(name) as f:
                    r = ShardReader(f)
                    n = len(r.ids)
                    for a in range(0, n, 1024):
                        b = min(n, a + 1024)
                        first = int(r.starts[a])
                        ids = r.read(first, int(r.starts[b])).astype("<u4")
                        docs = [ids[int(r.starts[k]) - first : int(r.starts[k + 1]) - first].tobytes() for k in range(a, b)]
                        cols = [
                            pa.array(r.ids[a:b], mask=r.nulls[a:b].astype(bool)),
                            pa.array(r.starts[a:b] + row["before"]),
                            pa.array(r.starts[a + 1 : b + 1] - r.starts[a:b]),
                            pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                        ]
                        if with_ids:
                            cols.append(pa.array(docs, pa.binary()))
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    shards = manifest.select("path", "before")
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
