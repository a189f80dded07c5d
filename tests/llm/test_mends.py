"""Cases that once took time without end or were cut short."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import langid, secrets, urlfilter


def test_urls_of_endless_paths(spark):
    deep = [f"http://trap.org/{'/'.join(f's{k}' for k in range(n))}" for n in (1, 2, 11, 12, 13, 60, 2000)]
    rows = [(i, u) for i, u in enumerate([*deep, *deep[-2:], "http://a.net/fr/x", "http://a.net/fr/" + "y/" * 300])]
    began = time.time()
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - began < 150 and len(got) == len(rows)
    assert got[3]["template"].count("/") == 12 and got[6]["template"] == "/" + deep[6].split("/", 3)[3] and got[10]["verdict"] == "block"


def test_levels_below_the_last_are_one_segment(spark):
    rows = [(i, f"http://x.net/fr/{c}/{d}") for i, (c, d) in enumerate([("a", "p/q"), ("a", "p/r"), ("b", "p/q"), ("b", "s")])]
    got = {r["page_id"]: r["template"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), levels=3).collect()}
    assert got == {0: "/fr/a/p/q", 1: "/fr/a/p/r", 2: "/fr/b/p/q", 3: "/fr/b/s"}


def test_many_secrets_in_text_that_is_not_ascii():
    text = "é𝄞 " + "0123456789abcdef é " * 100_000
    began = time.time()
    found = secrets.find_all([text], secrets.scanner(secrets.BASE))[0]
    assert time.time() - began < 60 and len(found) == 100_000
    for n in (0, 1, 50_000, 99_999):
        kind, i, j = found[n]
        assert (kind, text[i:j]) == ("hex", "0123456789abcdef")


def loss(net, windows, labels):
    """Mean cross-entropy by plain loops over windows, filters and places."""
    total = 0.0
    for w, y in zip(windows, labels, strict=True):
        x = net.embed[w].astype(float)
        h = []
        for width, filters, shift in zip(langid.WIDTHS, net.filters, net.shift, strict=True):
            for k in range(langid.FILTERS):
                best = max(float((x[i : i + width].reshape(-1) * filters[:, k]).sum()) for i in range(langid.WINDOW - width + 1))
                h.append(max(best + float(shift[k]), 0.0))
        z = [sum(a * float(net.out[i, c]) for i, a in enumerate(h)) + float(net.bias[c]) for c in range(net.out.shape[1])]
        top = max(z)
        total += top + math.log(sum(math.exp(v - top) for v in z)) - z[y]
    return total / len(windows)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(langid, "FILTERS", 3)
    monkeypatch.setattr(langid, "WINDOW", 20)
    rng = np.random.default_rng(0)
    p = langid.Network(["a", "b", "c"], rng.normal(0, 0.5, (256, langid.EMBED)), [rng.normal(0, 0.3, (w * langid.EMBED, 3)) for w in langid.WIDTHS], [rng.normal(0, 0.1, 3) for _ in langid.WIDTHS], rng.normal(0, 0.5, (9, 3)), rng.normal(0, 0.1, 3))
    return p, rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])


def test_forward_pass_equals_loops(small):
    net, windows, labels = small
    assert -net.log_probs(windows)[np.arange(5), labels].mean() == pytest.approx(loss(net, windows, labels))


def test_gradients_equal_differences(small):
    net, windows, labels = small
    parts = (net.embed, *net.filters, *net.shift, net.out, net.bias)
    rng = np.random.default_rng(1)
    for q, g in zip(parts, langid.gradients(net, windows, labels), strict=True):
        at = [np.unravel_index(np.abs(g).argmax(), g.shape), *(tuple(rng.integers(0, n) for n in g.shape) for _ in range(3))]
        for i in at:
            kept, sides = q[i], []
            for e in (1e-5, -1e-5):
                q[i] = kept + e
                sides.append(loss(net, windows, labels))
            q[i] = kept
            assert g[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_epochs_are_whole(monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "gradients", lambda net, b, y: seen.append(len(b)) or [np.zeros_like(q) for q in (net.embed, *net.filters, *net.shift, net.out, net.bias)])
    x = np.ones((130, langid.WINDOW), np.uint8)
    langid.fit(x, np.zeros(130, int), ["a", "b"], steps=2)
    assert seen == [64, 64, 2]
    langid.fit(x, np.zeros(130, int), ["a", "b"], steps=4)
    assert sum(seen[3:]) == 260


def test_training_takes_whole_texts_up_to_its_bytes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(langid, "fit", lambda x, y, languages, steps: held.append((x, y)))
    docs = spark.createDataFrame([(i, f"text {i} " * 100, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    size = {i: len(f"text {i} " * 100) for i in range(40)}
    order = [r[0] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    for most, rows in ((10_000_000, 40), (5_000, None), (1, 1)):
        langid.train(docs, F.lit(True), 4000, 10, most)
        if rows is None:
            rows = next(n for n in range(1, 41) if sum(size[i] for i in order[: n + 1]) > most)
        assert len(held[-1][0]) == sum(-(-size[i] // langid.WINDOW) for i in order[:rows])
