"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Documents become pieces: a document over `size` tokens is cut into pieces of `size`, the first of which
   takes what is left over; others stay whole.
2. Plan. Best-fit decreasing runs over (length, count) pairs on the driver, never over documents: bins with
   the same room are one group, and a group takes as many pieces of a length as both have. The plan is a
   short table of slots: pieces of `length` with rank in [first, first + n) go to sequences
   [sequence, sequence + n) at `offset`. It has at most a few rows for each pair of length and room,
   whatever the number of documents.
3. Pieces get their rank within their length and join the plan on length and rank. Ranks come from counts by
   (length, bucket), so a length that most pieces share is ranked in many tasks.

Defined results: null and empty text is a piece of the closing id alone. Repeated rows are packed each.
Rows without doc_id are packed too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pieces, rows_and_text, staged
from .tokens import encoder

PLAN = "length long, first long, n long, sequence long, offset long"


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first, n, sequence, offset) by best fit, longest pieces first."""
    rooms: list[int] = []  # rooms that some open group has, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, number of sequences)]
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # no open sequence has room
                each = size // length
                full = left // each
                if full:
                    for j in range(each):
                        slots.append((length, rank, full, opened, j * length))
                        rank += full
                    put(size - each * length, opened, full)
                    opened += full
                    left -= full * each
                else:
                    for j in range(left):
                        slots.append((length, rank, 1, opened, j * length))
                        rank += 1
                    put(size - left * length, opened, 1)
                    opened += 1
                    left = 0
                continue
            room = rooms[k]
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                del rooms[k]
            take = min(left, n)
            slots.append((length, rank, take, first, size - room))
            put(room, first + take, n - take)
            put(room - length, first, take)
            rank += take
            left -= take
    return slots


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    head = n % size if n > size else n
    starts = [(0, head)] if head else []
    return starts + [(s, size) for s in range(head, n, size)]


def tokenised(documents: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    source = rows_and_text(documents, ["doc_id"])
    schema = T.StructType([source.schema["row"], T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.BinaryType())] * with_ids)))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, end_id)
        for rb in pieces(batches, "text", 2 << 20, "tokens"):
            out = []
            for text in rb.column("text").to_pylist():
                ids = e.ids(text)
                rows = []
                for start, n in cut(len(ids) // 4, size):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append({"start": start, "length": n, "ids_crc32": zlib.crc32(part)} | ({"ids": part} if with_ids else {}))
                out.append(rows)
            yield pa.RecordBatch.from_arrays([rb.column("row"), pa.array(out, kind)], names=["row", "pieces"])

    return source.mapInArrow(run, schema).select(F.col("row.doc_id").alias("doc_id"), F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.*")


def pack(documents: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for each piece."""
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(tokenised(documents, tokenizer, end_id, size, with_ids).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))), "pieces")
    counts = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(histogram, size), PLAN)
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = parts.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("k") + F.col("before"))
    p, s = ranked.alias("p"), F.broadcast(slots).alias("s")  # bounded by pairs of length and room
    joined = p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.first")) & (F.col("p.rank") < F.col("s.first") + F.col("s.n")))
    return joined.select("p.doc_id", F.col("p.piece").cast("int").alias("piece"), "p.start", "p.length", "p.ids_crc32", (F.col("s.sequence") + F.col("p.rank") - F.col("s.first")).alias("sequence_id"), F.col("s.offset").alias("offset"), *(["p.ids"] if with_ids else []))
