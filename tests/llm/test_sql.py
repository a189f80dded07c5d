"""Registered queries against their DuckDB SQL, and values against plain loops."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import langid, quality, queries, secrets, topk
from tallyfield.llm.common import id_crc

DIR = "/root/testdata/sf0.001"


def rows(names, values):
    return collections.Counter(tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(names, r, strict=True))) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_duckdb(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows([d[0] for d in want.description], want.fetchall())


def test_topk_of_huge_zero_and_negative_components():
    rng = np.random.default_rng(0)
    for scale in (50, 2**28, 2**40):
        for _ in range(12):
            n, d = int(rng.integers(1, 200)), int(rng.integers(1, 9))
            data, ids = rng.integers(-scale, scale, (n, d)), rng.integers(0, 150, n)
            q, own = rng.integers(-scale, scale, (5, d)), rng.integers(0, 150, 5)
            q[0] = 0
            found = [[] for _ in q]
            for a in range(0, n, 50):
                found = topk.CandidateBlock(ids[a : a + 50], data[a : a + 50]).search(q, own, 5, found)
            for j in range(5):
                score = sorted((-sum(int(x) * int(y) for x, y in zip(v, q[j], strict=True)), int(i)) for v, i in zip(data, ids, strict=True) if i != own[j])
                assert found[j] == score[:5]


def test_topk_stops_and_skips_on_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    x = centres[rng.integers(0, 8, 4000)] + 0.1 * rng.normal(size=(4000, 32))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    blocks = list(topk.near_together(x, 512))
    assert sorted(np.concatenate(blocks).tolist()) == list(range(4000))
    found, scored, skipped = [[] for _ in range(40)], 0, 0
    for b in blocks:
        block = topk.CandidateBlock(b, x[b])
        found = block.search(x[:40], np.arange(40), 5, found)
        scored, skipped = scored + block.scored, skipped + block.skipped
    assert scored < 0.5 * 40 * 4000 and skipped > 0.5 * 40 * len(blocks)
    s = x[:40] @ x.T
    assert all([i for _, i in found[j]] == [int(i) for i in np.lexsort((np.arange(4000), -s[j])) if i != j][:5] for j in range(40))


def test_huge_embeddings_do_not_crash(spark):
    v = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = topk.search(v, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"] > 0) for r in got] == [(1, True), (2, False)]


def test_secret_columns_equal_regular_expressions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "ab " + "f" * 40 + " é token='abcdefghijkl'"), (9003, "ab " + "f" * 40 + " é token='abcdefghijkl'")], "doc_id long, text string"))
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)

    def want(i, t):
        t = t or ""
        o = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        o = sorted(o + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])
        n = collections.Counter(x[2] for x in o)
        return i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in o).encode()).hexdigest()

    got = collections.Counter(tuple(r) for r in secrets.scan(odd.withColumn("row", F.lit(1)).withColumn("spans", F.lit(2))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect())
    assert got == collections.Counter(want(r["doc_id"], r["text"]) for r in odd.collect()) and max(got.values()) == 2


def test_grades_equal_plain_numpy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    graded = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("quality"))
    model = quality.train(docs, graded, F.lit(True), 100)
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    h = quality.Hasher()
    got = {r["doc_id"]: r for r in quality.grade(docs.withColumn("row", F.lit("x")), model, 2).collect()}
    for r in docs.collect():
        z = float(h.vector(r["text"]).astype(float) @ model.weights)
        below = 1 / (1 + np.exp(-(model.thresholds - z)))
        p = np.diff([0, *below, 1])
        assert got[r["doc_id"]]["expected_grade"] == pytest.approx(p @ np.arange(4), abs=1e-6) and got[r["doc_id"]]["tail"] == pytest.approx(p[2:].sum(), abs=1e-6)


def test_language_training_does_not_depend_on_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    a, b = (langid.train(d, id_crc() % 3 != 1, 60, 30) for d in (docs, docs.orderBy(F.rand(1)).repartition(5)))
    assert a.languages == b.languages and np.array_equal(a.out, b.out) and all(np.array_equal(x, y) for x, y in zip(a.filters, b.filters, strict=True))
    twice = docs.limit(3).union(docs.limit(3)).withColumn("row", F.lit(0))
    got = collections.Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(twice, a).collect())
    assert len(got) == 3 and set(got.values()) == {2}
