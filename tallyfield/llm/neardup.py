"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct word shingles as 64-bit hashes. Documents with equal sets are one node.

1. One pass gives each document the digest of its set, MinHash values in bands, and an odd sketch: a bitmap
   in which bit h(i, minimum i) is flipped for every MinHash value i. The population count of the XOR of two
   sketches estimates how many values differ, most precisely where few do.
2. Nodes that share a band are candidates. Each node is first compared with one leader, the least node of
   its buckets; links are confirmed on full sets and give components.
   A second round compares each node with the hub of its leader's group: the member whose sketch is closest
   to a few sampled members, which in a group of copies is what they were copied from.
3. Buckets that still hold several components are joined for pairs of different components only. The largest
   component of a bucket is one side of a join with the others, and these are joined with each other, so a
   large group meets what is outside of it but never itself. Sizes and sketches decide in the join which pairs
   are worth full sets. Beside the odd sketch of
   MinHash values, an odd sketch of the full set bounds a pair exactly: its XOR count never exceeds the
   symmetric difference. So a group of near copies costs a few comparisons for each member, and no pair
   between components goes unseen.
4. Components come from alternating star contraction over the links, in the shared folder.

At a similarity of exactly 0.8 a pair shares no band with probability 1e-7, and the sketch test, at 5.3
standard deviations, turns it away with about the same.

Defined results: null or empty text, or text without words, has the empty set, is linked with nothing and
stays. Fewer words than a shingle make one shingle of all of them. A null doc_id takes no part: component is
null, kept is true. Rows that repeat a doc_id are judged each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import drop_stage, pieces, rows_and_text, staged, unpacked

ROWS = 5  # MinHash values in a band
BANDS = 40
BITS = 512  # of an odd sketch
LANES = [f"s{k}" for k in range(BITS // 64)]
FULL_BITS = 1024  # of the odd sketch of a full set
FULL = [f"f{k}" for k in range(FULL_BITS // 64)]
SAMPLES = 8  # members of a group that its hub is found with
MOST_BROADCAST = 500_000  # ids; beyond this a join is shuffled

_rng = np.random.default_rng(20_240_501)
_MULTIPLY = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_FOLD = _rng.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of texts; hashes of words are kept."""

    def __init__(self, width: int, most_memo: int = 150_000):
        self.width, self.most_memo = width, most_memo
        self.memo: dict[bytes, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not ws:
            return np.zeros(0, np.uint64)
        memo = self.memo
        got = list(map(memo.get, ws))
        if None in got:
            if len(memo) > self.most_memo:
                memo.clear()
            digest = xxhash.xxh3_64_intdigest
            for w in set(ws):
                if w not in memo:
                    memo[w] = digest(w)
            got = [memo[w] for w in ws]
        h = np.array(got, np.uint64)
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * _FOLD[k % 64] + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and the lanes of both odd sketches of sets that are not empty."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), ROWS * BANDS), np.uint64)
    for k in range(ROWS * BANDS):
        low[:, k] = np.minimum.reduceat(joined * _MULTIPLY[k] + _ADD[k], starts)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    grouped = low.reshape(len(sets), BANDS, ROWS)
    for r in range(ROWS):
        bands = _mixed(bands * _FOLD[r] + grouped[:, :, r])
    bands = _mixed(bands + np.arange(BANDS, dtype=np.uint64) * _FOLD[9])
    bit = (_mixed(low ^ np.arange(ROWS * BANDS, dtype=np.uint64) * _FOLD[11]) >> np.uint64(20)) % np.uint64(BITS)
    flat = (np.arange(len(sets), dtype=np.int64)[:, None] * BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(len(sets), BITS)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
    place = owner * FULL_BITS + ((joined * _FOLD[13]) >> np.uint64(64 - 10)).astype(np.int64)
    whole = (np.bincount(place, minlength=len(sets) * FULL_BITS) & 1).astype(np.uint8).reshape(len(sets), FULL_BITS)
    return bands.view(np.int64), np.concatenate([np.packbits(odd, axis=1).view(np.int64), np.packbits(whole, axis=1).view(np.int64)], axis=1)


def sketch_limit(similarity: float, deviations: float = 5.3) -> int:
    """Largest XOR population count at which a pair may still have the similarity."""
    k = ROWS * BANDS
    differ = 2 * k * (1 - similarity)
    mean = BITS / 2 * (1 - math.exp(-2 * differ / BITS))
    spread = 2 * math.sqrt(k * similarity * (1 - similarity)) * math.exp(-2 * differ / BITS)
    noise = math.sqrt(BITS / 4 * (1 - math.exp(-4 * differ / BITS)))
    return math.ceil(mean + deviations * math.hypot(spread, noise))


def sketched(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, null if empty), bands and sketch lanes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for rb in pieces(batches, "text", 4 << 20):
            sets = [s.set_of(t) for t in rb.column("text").to_pylist()]
            full = [x for x in sets if len(x)]
            bands, lanes = signatures(full) if full else (np.zeros((0, BANDS), np.int64), np.zeros((0, len(LANES + FULL)), np.int64))
            at = np.cumsum([len(x) > 0 for x in sets]) - 1
            empty = np.array([len(x) == 0 for x in sets], bool)
            pick = np.where(empty, 0, at)
            some = len(full) > 0
            band_rows = [None if e else bands[k] for e, k in zip(empty, pick, strict=True)]
            cols = [
                rb.column("doc_id").cast(pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                pa.array(band_rows, pa.list_(pa.int64())),
                *(pa.array(lanes[pick, k] if some else np.zeros(len(sets), np.int64), pa.int64()) for k in range(len(LANES + FULL))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "node", "bands", *LANES, *FULL])

    return rows_and_text(documents, ["doc_id"]).select("row.doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node binary, bands array<long>, " + ", ".join(f"{c} long" for c in LANES + FULL))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _sets_of(documents: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and its set for the nodes asked for (node, doc_id of one of its documents)."""
    n = nodes.count()
    texts = documents.select("doc_id", "text").join(_small(nodes.select("doc_id").distinct(), n), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for rb in pieces(batches, "text", 4 << 20):
            sets = [s.set_of(t) for t in rb.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    found = texts.mapInArrow(run, "node binary, shingles array<long>").where("node is not null")
    return found.join(_small(nodes.select("node"), n), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _differ(a: str, b: str, lanes: list[str]) -> Column:
    out = F.lit(0)
    for c in lanes:
        out = out + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return out


def _near(a: str, b: str, percent: int, limit: int) -> Column:
    """Sizes and MinHash sketches of two sides allow the similarity."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (_differ(a, b, LANES) <= limit)


def _full_near(a: str, b: str, percent: int) -> Column:
    """Sketches of full sets allow it: at the similarity p the symmetric difference is (1 - p) / (1 + p) of both sizes."""
    return (100 + percent) * _differ(a, b, FULL) <= (100 - percent) * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles"))


def _pairs(joined: DataFrame, member: str, other: str) -> DataFrame:
    """Pairs (a, b), a < b, each once, and the side of it that is not the centre of a group."""
    x, y = F.col(member), F.col(other)
    return joined.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), x.alias("member")).groupBy("a", "b").agg(F.min("member").alias("member"))


def _confirmed(pairs: DataFrame, documents: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of nodes whose full sets are similar enough. The member's set meets the pair first and travels on with it;
    the set of the other side, which may be the centre of many pairs, comes last and is not copied into a shuffle."""
    pairs = staged(pairs.withColumn("centre", F.when(F.col("member") == F.col("a"), F.col("b")).otherwise(F.col("a"))), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node")
    nodes = staged(nodes, "pair-nodes")
    sets = staged(_sets_of(documents, nodes, width), "pair-sets")
    side = lambda name, column: sets.select(F.col("node").alias(name), F.col("shingles").alias(column))
    both = pairs.join(side("member", "sa"), "member").join(side("centre", "sb"), "centre")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = staged(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links")
    for t in (nodes, sets, pairs):
        drop_stage(t)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, component (least node that can be reached) for every node with a link: alternating stars."""
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = staged(large.where("u <> v").distinct(), "large")
        # Small star: u and its smaller neighbours go to the least of these.
        least2 = staged(kept.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = kept.join(least2, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", F.col("m").alias("v")))
        after = staged(small.where("u <> v").distinct(), "edges")
        for t in (edges, least, kept, least2):
            drop_stage(t)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def classes(documents: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to, itself included), kept."""
    return _judged(documents, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The columns of classes, with node and the component that tells apart what shares a doc_id only."""
    limit = sketch_limit(percent / 100)
    sig = staged(sketched(documents, width), "sketches")
    live = sig.where("node is not null and doc_id is not null")
    reps = staged(live.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "sets")
    attributes = ["node", "n_shingles", *LANES, *FULL]
    # One row for each set: bands that at least two sets share, and the least of these.
    one = live.join(reps, ["node", "doc_id"]).dropDuplicates(["node"])
    bands = staged(one.select("node", F.explode("bands").alias("band")), "bands")
    buckets = staged(bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").select("band", "leader"), "buckets")
    shared = staged(bands.join(buckets, "band"), "shared")
    drop_stage(bands)
    about = staged(one.select(*attributes).join(shared.select("node").distinct(), "node", "left_semi"), "about")
    # Every node against one leader.
    first = shared.groupBy("node").agg(F.min("leader").alias("leader"))
    members = staged(first.join(about, "node"), "members")

    def against(centre: DataFrame) -> DataFrame:
        """Pairs of members with the node that `centre` has for their leader."""
        named = staged(centre.join(about.withColumnRenamed("node", "centre"), "centre"), "centres")
        pairs = members.alias("x").join(named.alias("y"), F.col("x.leader") == F.col("y.leader"))
        pairs = pairs.where((F.col("x.node") != F.col("y.centre")) & _near("x", "y", percent, limit) & _full_near("x", "y", percent))
        return _pairs(pairs, "x.node", "y.centre")

    tried = staged(against(members.select("leader").distinct().withColumn("centre", F.col("leader"))), "tried")
    links = _confirmed(tried, documents, reps, width, percent)
    grouped = components(links)
    # Every node against the hub of its leader's group, where they are still apart.
    lanes = F.struct(*LANES)
    samples = staged(members.groupBy("leader").agg(*(F.min_by(lanes, F.struct(F.xxhash64("node", F.lit(k)), "node")).alias(f"p{k}") for k in range(SAMPLES))), "samples")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.p{k}.{c}"))) for k in range(SAMPLES) for c in LANES), F.lit(0))
    # Written before it is grouped: the join may then split a large group, and the grouping combines on the map side.
    far = staged(members.alias("x").join(samples.alias("y"), F.col("x.leader") == F.col("y.leader")).select("x.leader", "x.node", apart.alias("apart")), "apart")
    hubs = far.groupBy("leader").agg(F.min_by("node", F.struct("apart", "node")).alias("centre"))
    label = lambda side: grouped.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    second = against(hubs).join(tried, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    second = second.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "member")
    second = staged(second, "second")
    links = links.union(_confirmed(second, documents, reps, width, percent))
    grouped = components(links)
    tried = tried.select("a", "b").union(second.select("a", "b"))
    # What is left: pairs of different components that share a bucket.
    placed = shared.join(grouped, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    placed = staged(placed, "placed")
    in_band = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    open_ = in_band.groupBy("band").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("k > 1").select("band", "largest")
    # Both sketches travel with the rows of a band: without the full one the join would let through too many pairs.
    rest = staged(placed.join(staged(open_, "open"), "band").join(about, "node"), "rest")
    outside = rest.where("component <> largest")

    def between(x: DataFrame, y: DataFrame, apart: Column) -> DataFrame:
        pairs = x.alias("x").join(y.alias("y"), (F.col("x.band") == F.col("y.band")) & apart & _near("x", "y", percent, limit) & _full_near("x", "y", percent))
        return _pairs(pairs, "x.node", "y.node")

    more = between(outside, rest.where("component = largest"), F.lit(True)).union(between(outside, outside, F.col("x.component") < F.col("y.component")))
    more = more.join(tried, ["a", "b"], "left_anti")
    late = _confirmed(more, documents, reps, width, percent)
    final = components(links.union(late))
    named = reps.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = staged(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least-id")
    known = staged(named.join(least, "component").select("node", "component", "component_id"), "classes")
    for t in (shared, buckets, about, members, samples, far, placed, rest):
        drop_stage(t)
    # Documents of one set may be many: both sides are plain tables, so a hot key is split.
    out = sig.select("doc_id", "n_shingles", "node").join(known, "node", "left")
    least_id = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "node", "component", least_id.alias("component_id"), F.coalesce(F.col("doc_id") == least_id, F.lit(True)).alias("kept"))


def _with_node(documents: DataFrame, width: int) -> DataFrame:
    """row and text of documents, and the digest of the set."""
    rows = rows_and_text(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for rb in pieces(batches, "text", 4 << 20):
            sets = (s.set_of(t) for t in rb.column("text").to_pylist())
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column("row"), rb.column("text"), nodes], names=["row", "text", "node"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("node", BinaryType())]))


def deduplicate(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of documents without those that are near copies of one with a smaller doc_id. Of rows that repeat
    a doc_id with equal or linked texts one stays, that of the least set and then the least text; rows that share
    a doc_id only are judged each. Rows without doc_id stay."""
    found = staged(_judged(documents, width, percent).where("doc_id is not null").select("doc_id", "node", "component", "kept"), "verdicts")
    gone = found.where("not kept").select("doc_id").distinct()
    left = documents.join(_small(gone, gone.count()), "doc_id", "left_anti").select(*documents.columns)
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = again.count()
    if n == 0:
        return left
    again = _small(staged(again, "repeated"), n)
    # An id says too little here: the verdict goes by id and set.
    stays = found.join(again, "doc_id", "left_semi").where("kept").groupBy("doc_id", "component").agg(F.min("node").alias("node"))
    stays = stays.select(F.col("doc_id").alias("id"), F.col("node").alias("set"))
    many = _with_node(documents.join(again, "doc_id", "left_semi").select(*documents.columns), width)
    many = many.join(stays, (F.col("row.doc_id") == F.col("id")) & F.col("node").eqNullSafe(F.col("set")))
    many = many.groupBy("id", "set").agg(F.min_by(F.struct("row", "text"), F.coalesce("text", F.lit(""))).alias("first")).select("first.row", "first.text")
    return left.join(again, "doc_id", "left_anti").select(*documents.columns).union(many.select(*unpacked(documents)))
