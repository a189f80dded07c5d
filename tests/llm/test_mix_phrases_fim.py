"""Mixing, collocations and fill-in-the-middle against plain loops, and odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import fim, mix, phrases

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, place int, row string, id string, size string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    long = "the long text goes on and on, " * 3000
    base = [(1, "a b c", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (None, "some words here", "de", None), (None, "some words here", "de", None), (5, long, "en", "s2"), (6, " \n\t", "", ""), (7, "x <P> y", "en", "s1")]
    base += [(8, "one two three", "en", "s1")] * 25 + [(100 + i, f"w{i} " * (1 + i % 40), "en", f"s{i % 5}") for i in range(300)]
    return [(i, t, lang, s, 1, "r", "i", "z") for i, t, lang, s in base]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def draw(*parts):
    text = ":".join("-" if p is None else str(p) for p in parts)
    return (xxhash.xxh64(text, seed=42).intdigest() >> 11) / 2**53


def water(sizes, weights, most):
    """Targets by source, by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - most * sum(sizes[s] for s in full)
        over = {s for s in rest if left * w[s] > most * sizes[s] * sum(w[r] for r in rest)}
        if not over:
            return {s: most * float(sizes[s]) if s in full else left * w[s] / sum(w[r] for r in rest) for s in names}
        full |= over


def fold(items, settle):
    """Sequential pivotal rounding of (u, key, a, q); settle(key, up) is told what is decided, the last fraction is returned."""
    rest = None
    for u, key, a, q in items:
        if q <= 0 or a == 0:
            settle(key, 0)
        elif rest is None:
            rest = [key, a, q]
        else:
            rk, ra, rq = rest
            up, down = min(ra * (1 - rq), a * q), min(ra * rq, a * (1 - q))
            if u * (up + down) < down:  # the fraction held so far gains
                if ra * (1 - rq) == a * q:
                    settle(rk, 1), settle(key, 0)
                    rest = None
                elif ra * (1 - rq) < a * q:
                    settle(rk, 1)
                    rest = [key, a, q - ra * (1 - rq) / a]
                else:
                    settle(key, 0)
                    rest = [rk, ra, rq + a * q / ra]
            elif ra * rq == a * (1 - q):
                settle(rk, 0), settle(key, 1)
                rest = None
            elif ra * rq < a * (1 - q):
                settle(rk, 0)
                rest = [key, a, q + ra * rq / a]
            else:
                settle(key, 1)
                rest = [rk, ra, rq - a * (1 - q) / ra]
    return rest


def brute_mix(rows, weights, most, block, block_of):
    """(source, id, size, copies) of each row, by plain loops; block_of gives the hash that deals entries to blocks."""
    entries = collections.Counter((s, i, len(WORDS.findall(t or ""))) for i, t, _, s, *_ in rows)
    sizes, docs = collections.Counter(), collections.Counter()
    for (s, _, z), m in entries.items():
        sizes[s] += z * m
        docs[s] += m
    target = water(sizes, weights, most)
    places = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    out = []
    for s, place in places.items():
        mean = sizes[s] / docs[s]
        turn = lambda z: 0 if z > 2 * mean else 1 if z > mean / 2 else 2
        aim = target[s]
        for k in range(3):
            mine = [(i, z, m) for (x, i, z), m in entries.items() if x == s and turn(z) == k]
            left = sum(z * m for (x, _, z), m in entries.items() if x == s and turn(z) >= k)
            c = min(max(aim / left, 0.0), float(most)) if left else 0.0
            blocks = collections.defaultdict(list)
            n = -(-len(mine) // block)
            for i, z, m in mine:
                whole = int(np.floor(m * c))
                blocks[block_of(i, z) % n].append((draw(f"turn {k}", place, i, z), (i, z, m, whole), z, m * c - whole))
            taken, told, level, rests = {}, (lambda key, up: taken.__setitem__(key, up)), 0, []
            for b in sorted(blocks):
                r = fold(sorted(blocks[b], key=lambda x: x[0]), told)
                if r:
                    rests.append((b, r))
            held = {b: r[0] for b, r in rests}
            deepest = max(blocks, default=0)  # of this source; levels beyond what the source needs draw once more
            rests = [(b, r[1], r[2]) for b, r in rests]
            while True:
                level, deepest = level + 1, deepest // block
                parents = collections.defaultdict(list)
                for b, a, q in rests:
                    parents[b // block**level].append((draw(f"turn {k} level {level}", place, b), b, a, q))
                rests = [tuple(r) for p in sorted(parents) if (r := fold(sorted(parents[p]), lambda b, up: told(held[b], up)))]
                if not deepest:
                    break
            for b, _, q in rests:
                told(held[b], int(draw(f"turn {k} last", place, b) < q))
            for i, z, m in mine:
                key = next(x for x in taken if x[:3] == (i, z, m))
                count = key[3] + taken[key]
                aim -= z * count
                out += [(s, i, z, count // m + (j < count % m)) for j in range(m)]
    return out, sizes, target


@pytest.mark.parametrize("block", [4, 256])
def test_mix_equals_plain_loops(spark, odd, block):
    hashed = {(r["id"], r["z"]): r["h"] for r in odd.select(F.col("doc_id").alias("id"), F.coalesce(F.regexp_count("text", F.lit(mix.WORDS)), F.lit(0)).cast("long").alias("z")).distinct().withColumn("h", F.xxhash64(F.lit("block"), "id", "z")).collect()}
    got = mix.plan(odd, (5, 2, 1), 3, block).collect()
    want, sizes, target = brute_mix(odd_rows(), (5, 2, 1), 3, block, lambda i, z: hashed[i, z])
    assert collections.Counter((r["source"], r["doc_id"], r["size"], r["copies"]) for r in got) == collections.Counter(want)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 3 for r in got)
    by = collections.Counter()
    for r in got:
        by[r["source"]] += r["size"] * r["copies"]
    assert all(abs(by[s] - target[s]) <= max(z for x, _, z, _ in want if x == s) for s in by)


def test_mix_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    a, q = rng.integers(1, 50, 30), rng.random(30)
    ups = np.zeros(30)
    for _ in range(4000):
        got: dict = {}
        rest = fold([(u, k, int(a[k]), q[k]) for k, u in enumerate(rng.random(30))], got.__setitem__)
        kept = sum(int(a[k]) * up for k, up in got.items()) + (rest[1] * rest[2] if rest else 0)
        assert kept == pytest.approx(a @ q) and len(got) + bool(rest) == 30
        if rest:
            got[rest[0]] = rest[2]
        ups += [got[k] for k in range(30)]
    assert np.abs(ups / 4000 - q).max() < 0.05


def test_mix_edges_and_reruns(spark, odd, none):
    assert mix.plan(none).count() == 0 and mix.mixed(none).count() == 0
    a, b = (collections.Counter(tuple(r) for r in mix.plan(d).collect()) for d in (odd, odd.repartition(7, "text")))
    assert a == b and sum(a.values()) == len(odd_rows())
    out = mix.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in mix.plan(odd).collect())


def brute_phrases(rows, least, longest, taken_in, most):
    grams, spoken = collections.Counter(), collections.Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            spoken[lang] += len(w)
            for k in range(1, longest + 1):
                grams.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {g: n for g, n in grams.items() if n >= least and len(g[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, g), a in frequent.items():
        inside = any(x == lang and len(h) > len(g) and 100 * n >= taken_in * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (x, h), n in frequent.items())
        if not inside:
            cuts = [(2_000_000 * a // (grams[lang, g[:k]] + grams[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(g).encode(), grams[lang, g[:k]], grams[lang, g[k:]]))
    return {(lang, r + 1, p.decode(), -a, left, right, spoken[lang], -s) for lang, v in out.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:most])}


@pytest.mark.parametrize(("least", "longest", "most", "chunk"), [(3, 4, 2000, phrases.CHUNK), (2, 3, 5, 2000), (5, 2, 2000, 500)])
def test_collocations_equal_plain_loops(spark, odd, monkeypatch, least, longest, most, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    more = [(i, "Big red dog\tran. big RED dog ran away: the big red dog é\x0bé é", lang, "s", 1, "r", "i", "z") for i in range(6) for lang in ("en", None, "a\tb", "")]
    docs = odd.where("doc_id is null or doc_id <> 5").union(spark.createDataFrame(more, SCHEMA))
    got = phrases.collocations(docs, least, longest, 80, most).collect()
    want = brute_phrases([r for r in odd_rows() if r[0] != 5] + more, least, longest, 80, most)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_collocations_of_long_text_and_none(spark, odd, none):
    assert phrases.collocations(none).count() == 0
    found = {(r["lang"], r["phrase"], r["a"]) for r in phrases.collocations(odd, 30).collect()}
    assert ("en", "the long text goes", 3000) in found and ("en", "long text", 3000) not in found


def plain_fim(doc_id, text, seed="1"):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle_equals_regular_expressions(spark, odd):
    extra = [(900 + i, t, "en", "s", 1, "r", "i", "z") for i, t in enumerate(["é𝄞x<", "<P", "<P>", "<<S>", "<S><S", "<Px>", "a<M>b", "\n\r\n", "𝄞" * 700, "x" * 5000, "<" * 600, "é" * 511 + "<M>", "ab<S" + "z" * 508 + "<P> "])]
    docs = odd.union(spark.createDataFrame(extra, SCHEMA)).union(spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "1", "'r'", "'i'", "'z'"))
    got = fim.rearrange(docs, "1").select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        p = plain_fim(r["doc_id"], r["text"])
        want.append((r["doc_id"], *p, sha(p[4]), sha(r["text"] or "")))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_scan_in_blocks_equals_one_block():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aP<>SM é𝄞1"), rng.integers(0, 400))).encode() for _ in range(200)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    one = fim.scan(data, begins, ends, 10_000)
    assert fim.memory() == 3 and all((fim.scan(data, begins, ends, b) == one).all() for b in (3, 7, 64))
    for t, a, b in zip(texts, begins, ends, strict=True):
        s = t.decode()
        assert ((one[a:b] & fim.POINT) > 0).sum() == len(s) and ((one[a:b] & fim.UNIT) > 0).sum() == len(re.findall("[A-Za-z]+|[^A-Za-z]", s))
        assert ((one[a:b] & fim.SENTINEL) > 0).sum() == len(re.findall("<[PSM]>", s))


def test_fill_in_middle_of_nothing(spark, none):
    assert fim.rearrange(none).count() == 0
    with pytest.raises(ValueError, match="doc_id"):
        fim.rearrange(none, columns=["lang"])
