"""Sources mixed to target weights by pivotal dependent rounding, in DataFrame expressions only.

A document of size a is to be taken c times, c being its source's target over its source's size. The whole part of c is
taken as it is; the fractions are rounded together: two documents meet, and so many words move from one to the other,
in a direction drawn with the odds that keep both expectations, that one of the fractions becomes 0 or 1. The words taken
stay the same throughout. Documents of a source meet in blocks of bounded size (a fold over an array); each block
leaves one fraction, which meets those of other blocks on the next level of the tree, until a source has one left.

What is left in the end belongs to a large document. Documents are therefore rounded in three turns, those above twice the
mean size of their source, those down to half of it, and the small ones; each turn aims at what the turns before it left of
the target, so that the error left in the end is of the size of a small document.

Sources are ranked and filled by joins and aggregates; the sources' table has one row a source. Rows that share source, id and size
count as one entry with a number of rows, so that no repeated id makes a large group. Every draw is a hash of
ids: reruns agree, whatever the partitions. Null text has size 0, null source is a source of its own, a null id an id; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, staged

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 256  # mean number of entries that one block folds
TURNS = 3
ROWS = 10_000  # of one entry that are written from one array


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) out of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.shiftrightunsigned(F.xxhash64(text), 11).cast("double") / float(1 << 53)


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `place` from 0 by code point, null last: places within ranges of sources, and a running sum over the ranges."""
    cut = staged(sources.orderBy(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33)), "mix-sources")
    before = cut.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row for each partition of the sort
    return cut.join(before, "range").withColumn("place", F.col("before") + F.col("at")).drop("range", "at", "before")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (source, size, ...) with place and target: shares of all sizes by weight, stopped at `most` times the size."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = staged(ranked(sources).withColumn("weight", weight), "mix-ranked")
    total = int(s.agg(F.sum(F.col("size").cast("decimal(38,0)"))).first()[0] or 0)
    full = F.lit(False)  # sources that stop at their most, at the level reached so far
    share = F.lit(0.0)
    reached = -1
    while True:  # the level only rises, and each round stops one more source at least
        row = s.agg(F.sum(F.when(full, F.col("size")).otherwise(0).cast("decimal(38,0)")).alias("kept"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w"), F.sum(full.cast("int")).alias("stopped")).first()
        if row["stopped"] is None or row["stopped"] == reached or not row["w"]:
            break
        reached, left, w = row["stopped"], total - most * int(row["kept"]), int(row["w"])
        big = lambda v: F.lit(v).cast("decimal(38,0)")
        full = full | (big(most * w) * F.col("size") < big(left) * F.col("weight"))
        share = F.col("weight") * F.lit(left / w)
    return s.withColumn("target", F.when(full, most * F.col("size").cast("double")).otherwise(share))


#: One step of the fold: s (done, rest) meets e (key, a, q, u). A key that is settled goes to done with up 0 or 1.
STEP = """CASE
  WHEN e.q <= 0D OR e.a = 0 THEN named_struct('done', concat(s.done, array(named_struct('key', e.key, 'up', 0L))), 'rest', s.rest)
  WHEN s.rest IS NULL THEN named_struct('done', s.done, 'rest', named_struct('key', e.key, 'a', e.a, 'q', e.q))
  WHEN e.u * (least(s.rest.a * (1D - s.rest.q), e.a * e.q) + least(s.rest.a * s.rest.q, e.a * (1D - e.q))) < least(s.rest.a * s.rest.q, e.a * (1D - e.q)) THEN
    CASE WHEN s.rest.a * (1D - s.rest.q) = e.a * e.q THEN named_struct('done', concat(s.done, array(named_struct('key', s.rest.key, 'up', 1L), named_struct('key', e.key, 'up', 0L))), 'rest', cast(NULL AS {rest}))
      WHEN s.rest.a * (1D - s.rest.q) < e.a * e.q THEN named_struct('done', concat(s.done, array(named_struct('key', s.rest.key, 'up', 1L))), 'rest', named_struct('key', e.key, 'a', e.a, 'q', e.q - s.rest.a * (1D - s.rest.q) / e.a))
      ELSE named_struct('done', concat(s.done, array(named_struct('key', e.key, 'up', 0L))), 'rest', named_struct('key', s.rest.key, 'a', s.rest.a, 'q', s.rest.q + e.a * e.q / s.rest.a)) END
  WHEN s.rest.a * s.rest.q = e.a * (1D - e.q) THEN named_struct('done', concat(s.done, array(named_struct('key', s.rest.key, 'up', 0L), named_struct('key', e.key, 'up', 1L))), 'rest', cast(NULL AS {rest}))
  WHEN s.rest.a * s.rest.q < e.a * (1D - e.q) THEN named_struct('done', concat(s.done, array(named_struct('key', s.rest.key, 'up', 0L))), 'rest', named_struct('key', e.key, 'a', e.a, 'q', e.q + s.rest.a * s.rest.q / e.a))
  ELSE named_struct('done', concat(s.done, array(named_struct('key', e.key, 'up', 1L))), 'rest', named_struct('key', s.rest.key, 'a', s.rest.a, 'q', s.rest.q - e.a * (1D - e.q) / s.rest.a)) END"""


def _folded(entries: str, key: str) -> Column:
    """The fold over an array of (u, key, a, q), in its order."""
    rest = f"struct<key: {key}, a: bigint, q: double>"
    start = f"named_struct('done', cast(array() AS array<struct<key: {key}, up: bigint>>), 'rest', cast(NULL AS {rest}))"
    return F.expr(f"aggregate({entries}, {start}, (s, e) -> {STEP.format(rest=rest)})")


def _turn(entries: DataFrame, turn: int, blocks_of: int) -> tuple[DataFrame, DataFrame]:
    """Round entries (place, id, size, rows, copies as a fraction, entries of the place): blocks (place, block, done, rest,
    taken) and the decisions on what blocks left (place, block, up)."""
    whole = F.floor(F.col("rows") * F.col("copies"))
    key = F.struct("id", "size", "rows", whole.cast("long").alias("whole"))
    e = entries.withColumn("u", _draw(F.lit(f"turn {turn}"), F.col("place"), F.col("id"), F.col("size")))
    e = e.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id", "size"), F.ceil(F.col("entries") / blocks_of).cast("long")))
    e = e.select("place", "block", F.struct("u", key.alias("key"), F.col("size").alias("a"), (F.col("rows") * F.col("copies") - whole).alias("q")).alias("e"))
    kind = e.schema["e"].dataType["key"].dataType.simpleString()
    blocks = e.groupBy("place", "block").agg(F.sort_array(F.collect_list("e")).alias("es")).select("place", "block", _folded("es", kind).alias("f"))
    blocks = staged(blocks.select("place", "block", "f.done", "f.rest", F.expr("aggregate(f.done, cast(0 as bigint), (s, d) -> s + d.key.size * (d.key.whole + d.up))").alias("taken")), f"mix-turn-{turn}")
    rest = blocks.where("rest is not null").select("place", F.col("block").alias("key"), F.col("rest.a").alias("a"), F.col("rest.q").alias("q"))
    deepest = blocks.agg(F.max("block")).first()[0] or 0
    decisions, level = [], 0
    while True:
        level, deepest = level + 1, deepest // blocks_of
        u = _draw(F.lit(f"turn {turn} level {level}"), F.col("place"), F.col("key"))
        # A parent takes the blocks of a range of `blocks_of` ** level numbers.
        g = rest.withColumn("parent", F.floor(F.col("key") / float(blocks_of**level)).cast("long"))
        g = g.groupBy("place", "parent").agg(F.sort_array(F.collect_list(F.struct(u.alias("u"), "key", "a", "q"))).alias("es")).select("place", "parent", _folded("es", "bigint").alias("f"))
        done = staged(g.select("place", "f.done", "f.rest"), f"mix-turn-{turn}-level-{level}")
        decisions.append(done.select("place", F.explode("done").alias("d")).select("place", F.col("d.key").alias("block"), "d.up"))
        rest = done.where("rest is not null").select("place", "rest.key", "rest.a", "rest.q")
        if not deepest:
            last = _draw(F.lit(f"turn {turn} last"), F.col("place"), F.col("key"))
            decisions.append(rest.select("place", F.col("key").alias("block"), (last < F.col("q")).cast("long").alias("up")))
            break
    every = decisions[0]
    for d in decisions[1:]:
        every = every.union(d)
    return blocks, every


def plan(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = BLOCK) -> DataFrame:
    """source, doc_id, size, source_size, target, copies: one row for each document. `weights` repeat over the sources in order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = documents.select(F.col("source").cast("string").alias("source"), F.col("doc_id").alias("id"), size.alias("size"))
    entries = staged(rows.groupBy("source", "id", "size").agg(F.count("*").alias("rows")), "mix-entries")
    sums = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("documents"))
    sources = staged(targets(sums, weights, most), "mix-targets")
    mean = F.col("source_size") / F.col("documents")
    turn = F.when(F.col("size") > 2 * mean, 0).when(F.col("size") > mean / 2, 1).otherwise(2)
    known = sources.select(F.col("source").alias("named"), "place", F.col("size").alias("source_size"), "documents", "target")
    e = staged(entries.join(known, F.col("source").eqNullSafe(F.col("named"))).withColumn("turn", turn).select("place", "id", "size", "rows", "turn"), "mix-turns")
    sums_of = lambda k: (F.sum(F.when(F.col("turn") >= k, F.col("size") * F.col("rows")).otherwise(0)).alias(f"left_{k}"), F.sum((F.col("turn") == k).cast("long")).alias(f"entries_{k}"))
    parts = e.groupBy("place").agg(*(c for k in range(TURNS) for c in sums_of(k)))
    aims = staged(sources.select("place", "target").join(parts, "place"), "mix-aims")
    out = None
    for k in range(TURNS):
        copies = F.coalesce(F.least(F.greatest(F.try_divide(F.col("target"), F.col(f"left_{k}")), F.lit(0.0)), F.lit(float(most))), F.lit(0.0))
        mine = e.where(F.col("turn") == k).drop("turn").join(aims.select("place", copies.alias("copies"), F.col(f"entries_{k}").alias("entries")), "place")
        blocks, decisions = _turn(mine, k, block)
        settled = blocks.join(decisions, ["place", "block"], "left")
        if k + 1 < TURNS:
            left = F.coalesce(F.col("rest.a") * (F.col("rest.key.whole") + F.col("up")), F.lit(0))
            taken = settled.groupBy("place").agg(F.sum(F.col("taken") + left).alias("taken"))
            before, aims = aims, staged(aims.join(taken, "place", "left").withColumn("target", F.col("target") - F.coalesce("taken", F.lit(0))).drop("taken"), "mix-aims")
            drop_stage(before)
        items = F.concat("done", F.when(F.col("rest").isNotNull(), F.array(F.struct(F.col("rest.key").alias("key"), F.col("up")))).otherwise(F.array()))
        part = settled.select("place", F.explode(items).alias("d"))
        out = part if out is None else out.union(part)
    drop_stage(entries)
    # Rows of one entry share its copies: the first `over` of them take one more. They are written from arrays of bounded length.
    count = F.col("d.key.whole") + F.col("d.up")
    flat = out.select("place", "d.key.id", "d.key.size", F.col("d.key.rows").alias("rows"), count.alias("count"))
    flat = flat.withColumn("from", F.explode(F.expr(f"sequence(0L, rows - 1, {ROWS}L)"))).withColumn("row", F.explode(F.expr(f"sequence(from, least(from + {ROWS}, rows) - 1)")))
    copies = F.expr("count div rows + if(row < count % rows, 1, 0)")
    known = sources.select("place", "source", F.col("size").alias("source_size"), "target")
    return flat.join(known, "place").select("source", F.col("id").alias("doc_id"), "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken, all columns kept. Rows that share source, id and
    size take their copies in the order of their texts' hashes."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    own = [F.col(f"d.`{c}`") for c in documents.columns]
    keys = [F.col("source").cast("string").alias("key_source"), F.col("doc_id").alias("key_id"), size.alias("key_size")]
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d"), *keys)
    counted = plan(documents, weights, most).groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"), F.sum("copies").alias("count"))
    same = rows["key_source"].eqNullSafe(counted["source"]) & rows["key_id"].eqNullSafe(counted["doc_id"]) & (rows["key_size"] == counted["size"])
    met = rows.join(counted, same).select("d", "key_source", "key_id", "key_size", "rows", "count")
    even = met.where("count % rows = 0").withColumn("copies", F.expr("count div rows"))
    place = F.row_number().over(Window.partitionBy("key_source", "key_id", "key_size").orderBy(F.xxhash64("d.text")))
    odd = met.where("count % rows <> 0").withColumn("copies", F.expr("count div rows") + (place <= F.col("count") % F.col("rows")).cast("long"))
    return even.union(odd).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*own)
