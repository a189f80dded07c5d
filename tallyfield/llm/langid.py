"""Language identification by a byte convolutional network, trained in numpy.

Text is lower-cased and cut into windows of `WINDOW` bytes, the last one padded; all windows of a text are
used. A window's bytes are embedded, filters of several widths slide over them, each filter keeps its
maximum, and a softmax layer gives the languages. A text's prediction is the mean of its windows' log
probabilities, weighted by their letters.

Training takes distinct labelled texts, lowest hash of the id first, up to `most_rows` of them and `most_bytes` of text
(one text at least), with all of their windows, and goes over all of these in whole epochs, in random order, until there
were `steps` batches. The two bounds hold what reaches the driver.

Defined results: null text, and text without a letter, is `und` with score 0. Null labels teach nothing. If
no labelled text holds a letter, every text is `und`. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pieces, rows_and_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8

def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def window_bytes(text: str) -> np.ndarray:
    """All windows of a text, one row each."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros((n, WINDOW), np.uint8)
    out.ravel()[: len(raw)] = raw
    return out


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads
    filters: list[np.ndarray]  # width*EMBED x FILTERS
    shift: list[np.ndarray]
    out: np.ndarray  # filters x languages
    bias: np.ndarray

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each window, after ReLU."""
        got = []
        x = self.embed[windows]  # windows, WINDOW, EMBED
        n = len(windows)
        for w, f, s in zip(WIDTHS, self.filters, self.shift, strict=True):
            m = WINDOW - w + 1
            view = np.lib.stride_tricks.as_strided(x, (n, m, w * EMBED), (x.strides[0], x.strides[1], x.strides[2]))
            y = (np.ascontiguousarray(view).reshape(n * m, w * EMBED) @ f).reshape(n, m, FILTERS)
            got.append(np.maximum(y.max(axis=1) + s, 0))
        return np.concatenate(got, axis=1)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(net: Network, b: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of windows b with labels y: embedding, filters, shifts, output and its bias."""
    n, nw = len(b), len(WIDTHS)
    x = net.embed[b]
    feats, tops, cols = [], [], []
    for w, f, s in zip(WIDTHS, net.filters, net.shift, strict=True):
        size = WINDOW - w + 1
        view = np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, size, w * EMBED), x.strides))
        z = (view.reshape(n * size, -1) @ f).reshape(n, size, FILTERS)
        top = z.argmax(axis=1)
        feats.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + s)
        tops.append(top)
        cols.append(view)
    raw = np.concatenate(feats, axis=1)
    h = np.maximum(raw, 0)
    z = h @ net.out + net.bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    d = e / e.sum(axis=1, keepdims=True)
    d[np.arange(n), y] -= 1
    d /= n
    grads = [np.zeros_like(q) for q in (net.embed, *net.filters, *net.shift, net.out, net.bias)]
    grads[-2], grads[-1] = h.T @ d, d.sum(axis=0)
    dh = (d @ net.out.T) * (raw > 0)
    for j, w in enumerate(WIDTHS):
        g = dh[:, j * FILTERS : (j + 1) * FILTERS]
        grads[1 + nw + j] = g.sum(axis=0)
        at = np.take_along_axis(cols[j], tops[j][:, :, None].reshape(n, -1, 1), 1)  # n, FILTERS, w*EMBED
        grads[1 + j] = np.einsum("nf,nfc->cf", g, at)
        back = g[:, :, None] * net.filters[j].T[None]  # n, FILTERS, w*EMBED
        for i in range(w):
            np.add.at(grads[0], b[np.arange(n)[:, None], tops[j] + i], back[:, :, i * EMBED : (i + 1) * EMBED])
    grads[0][0] = 0
    return grads


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 800, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network:
    """Adam on cross-entropy; gradients run through the place of each filter's maximum. Whole epochs, `steps` batches at least."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    f32 = np.float32
    p = [rng.normal(0, 0.5, (256, EMBED)).astype(f32), *(rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(f32) for w in WIDTHS), *(np.zeros(FILTERS, f32) for _ in WIDTHS), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(f32), np.zeros(k, f32)]
    p[0][0] = 0
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    nw = len(WIDTHS)
    while t < steps:
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            grads = gradients(Network(languages, p[0], p[1 : 1 + nw], p[1 + nw : 1 + 2 * nw], p[-2], p[-1]), windows[pick], labels[pick])
            t += 1
            for q, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= (rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)).astype(f32)
    return Network(languages, p[0], p[1 : 1 + nw], p[1 + nw : 1 + 2 * nw], p[-2], p[-1])


def train(documents: DataFrame, usable, most_rows: int = 4000, steps: int = 800, most_bytes: int = 64 << 20) -> Network | None:
    """A network from the labelled documents for which `usable` holds."""
    few = documents.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text", "lang").alias("content"))
    # Choose rows first, so that texts are not sorted; a text that repeats under one id counts once.
    keys = ["h", "doc_id", "content"]
    chosen = few.select(*keys, F.octet_length("text").cast("long").alias("size")).distinct().orderBy(*keys).limit(most_rows)
    before = F.sum("size").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))  # over most_rows rows
    chosen = chosen.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= most_bytes)).select(*keys)
    picked = few.join(F.broadcast(chosen), keys, "left_semi")  # most_rows bounds the broadcast
    picked = picked.dropDuplicates(keys).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text"):
            held = [(window_bytes(text).tobytes(), lang) for text, lang in zip(rb.column("text").to_pylist(), rb.column("lang").to_pylist(), strict=True) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.binary()), pa.array([lang for _, lang in held], pa.string())], names=["windows", "lang"])

    got = picked.mapInArrow(run, "windows binary, lang string").toArrow()
    if got.num_rows == 0:
        return None
    langs = got.column("lang").to_pylist()
    languages = sorted(set(langs))
    x = np.frombuffer(b"".join(got.column("windows").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([languages.index(lang) for lang in langs], [len(w) // WINDOW for w in got.column("windows").to_pylist()])
    # Rows come in any order; training must not depend on it.
    order = np.lexsort((y, np.ascontiguousarray(x).view(f"S{WINDOW}").ravel()))
    return fit(x[order], y[order], languages, steps)


def predict(texts: list[str | None], net: Network, batch: int = 256) -> list[tuple[str, float]]:
    """(language, probability) of each text; windows of many texts are run together."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    which, held = [], []
    for i, t in enumerate(texts):
        if has_letter(t):
            w = window_bytes(t)
            held.append(w)
            which.append(np.full(len(w), i))
    if not held:
        return out
    windows, owner = np.concatenate(held), np.concatenate(which)
    total = np.zeros((len(texts), len(net.languages)))
    weight = np.zeros(len(texts))
    for a in range(0, len(windows), batch):
        part = windows[a : a + batch]
        letters = ((part >= 97) & (part <= 122) | (part >= 128)).sum(axis=1) + 1e-3
        np.add.at(total, owner[a : a + batch], net.log_probs(part) * letters[:, None])
        np.add.at(weight, owner[a : a + batch], letters)
    for i in np.unique(owner).tolist():
        z = total[i] / weight[i]
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        out[i] = net.languages[k], float(p[k])
    return out


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every document, in its place: no shuffle."""
    source = rows_and_text(documents, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text", 4 << 20):
            texts = rb.column("text").to_pylist()
            got = predict(texts, net) if net else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([rb.column("row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["row", "lang_pred", "score"])

    schema = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).select("row.doc_id", "lang_pred", "score")
