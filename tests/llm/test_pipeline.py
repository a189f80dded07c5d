"""The pipeline's rows against plain loops over a small folder of tables."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyfield.llm import decontaminate, queries, secrets, toxicity
from tallyfield.llm.common import id_crc


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of sf0.001 with planted copies, benchmark passages, secrets, insults, nulls and a repeated row."""
    d = tmp_path_factory.mktemp("tables")
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    docs = read("documents").orderBy("doc_id").limit(60).collect()
    item = read("benchmark").orderBy("item_id").first()["text"]
    extra = [(9001, docs[3]["text"] + " and a closing word"), (9002, "before it " + item + " after it"), (9003, item), (9004, "here token = abcdefghijklmnop9 is kept"), (9005, None), (9006, ""), (9006, ""), (9007, "you stupid worthless idiot and pathetic loser, you moron")]
    rows = [tuple(r) for r in docs] + [(i, t, None, "s", None if t is None else len(t)) for i, t in extra]
    spark.createDataFrame(rows, read("documents").schema).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(name).write.parquet(f"{d}/{name}.parquet")
    return f"{d}"


def brute(spark, folder):
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    lexicon = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), id_crc() % 4 != 2, queries.TOXIC_TRAIN_ROWS)
    m = toxicity.Matcher(lexicon)
    docs = [r for r in docs if toxicity.score_text(m, r["text"]) < 0.3]
    # Near copies: every pair is compared; the smallest id of a group stays.
    sets, parent = [shingles(r["text"]) for r in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[root(i) if sets[i] else ("empty", docs[i]["doc_id"])].append(i)
    docs = [docs[min(g, key=lambda i: docs[i]["doc_id"])] for g in groups.values()]
    # Benchmark windows of ten words are cut.
    wins = {}
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = decontaminate.words(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])] = True
    out = []
    for r in docs:
        w = decontaminate.words(r["text"])
        hit = {p for n in {len(x) for x in wins} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins for p in range(k, k + n)}
        if hit and len(hit) == len(w):
            continue
        spans, p = [], sorted(hit)
        for x in p:
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        text = r["text"]
        if spans:
            raw = text.encode()
            at = [x.span() for x in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
            for a, b in reversed(spans):
                raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
            text = raw.decode()
        out.append((r["doc_id"], text))
    # Secrets are replaced by their kind.
    s = secrets.scanner()
    return [(i, secrets.redact_text(t, secrets.find_all([t], s)[0])) for i, t in out]


def test_run_equals_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    got = corpus_pipeline.run(spark, folder).toPandas()
    want = brute(spark, folder)
    texts = dict(want)
    assert len(texts) == len(want) and 9001 not in texts and 9003 not in texts and 9007 not in texts
    assert "token" not in texts[9004] and texts[9002].startswith("before it") and len(texts) > 40
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in want}
    made = {i: b"".join(g.sort_values("start")["ids"].map(bytes)) for i, g in got.groupby("doc_id")}
    assert made == {i: a.tobytes() for i, a in ids.items()}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g["piece"].tolist() == list(range(len(g))) and (g["length"][1:] == 1024).all() and g["start"].tolist() == [0, *g["length"].cumsum()[:-1]]
    rows = got.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    used, least = rows["sequence_id"].nunique(), -(-int(rows["length"].sum()) // 1024)
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024 and used <= 1.02 * least + 1


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert docs.where(F.lit(False)).count() == corpus_pipeline.STAGES[2][1](spark, docs.where(F.lit(False)), folder).count()
