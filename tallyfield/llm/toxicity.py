"""Toxicity: a lexicon trie learned from labels, matched through Levenshtein automata, scored in context.

1. Learn a lexicon trie. Prefixes (up to DEEPEST letters) and whole words are counted over labelled texts. The
   evidence of a node is its share of toxic texts, pulled towards the node above it by PULL pseudo texts, so
   rare endings lean on their stem and stems on the base rate. A word has the evidence of the deepest node on
   its path: its own, or that of a stem. A prefix is a stem if FAMILY words that labelled texts repeat begin
   with it. Where evidence reaches one half the node is a term. A few widely known insults are always terms.
2. Match. The Levenshtein automaton (one edit, a swap of neighbours counts as one) is intersected with the
   trie of terms and determinised as words are read, so a word costs a few table steps and dies early. One
   edit is matched for whole words of LEAST_WORD letters and stems of LEAST_STEM or more; closer to shorter
   ones (from SHORT_WORD, SHORT_STEM) only where labelled texts hold the variant and it proved toxic.
3. Score in context. Words around a hit tell quotation (quote marks, reporting verbs) from abuse (address,
   other hits) and scale its evidence. A logistic model over the strongest hit and the sums of evidence and of
   log odds gives the score. It is fitted on labelled texts, each judged without its own counts, and pulled
   towards default weights, which stand where labels are few.

Learning takes at most `most_rows` labelled rows (lowest hash of the id first); a text that repeats counts once.

Defined results: null or empty text, or text without words, gets the score of a document without hits.
A null doc_id is scored and counts as not held out. Repeated rows are scored each. Without labels only the
fixed terms are known. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, pieces, rows_and_text, staged, unpacked

# Terms that need no label, words that report speech, words that address a reader.
SEEDS = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "clown", "trash", "bastard", "scumbag", "dumbass", "retard", "vermin", "filth")
REPORTING = frozenset("said says say called calls calling wrote writes quote quoted quotes word words term terms insult slur phrase dit sagte nannte dijo".split())
ADDRESS = frozenset("you your youre u yourself du dich dein ihr euch tu toi ton vous votre tú ti usted eres".split())
QUOTES = frozenset("\"“”„«»")

DEEPEST = 24  # letters of a word that the trie branches on; longer words are nodes below that
PULL = 8.0  # pseudo texts with which a node is pulled towards the one above
HOT = 0.5  # evidence from which a node is a term
FAMILY = 3  # words that make their common prefix a stem
LEAST_WORD, LEAST_STEM = 5, 8
SHORT_WORD, SHORT_STEM = 4, 5
DEFAULT = (-4.0, 4.0, 1.0, 1.0)  # bias, strongest hit, sum of evidence, sum of log odds
END = "$"  # closes the key of a whole word
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    precision: float


def evidence(chain: Iterable[tuple[int, int]], rows: int, toxic: int, own: int | None = None) -> float:
    """Share of toxic texts at the end of a path of (texts, toxic texts); a node that all texts of the node above
    hold adds nothing. With `own` (0 or 1) a text with that label is left out of all counts."""
    less, bad = (0, 0) if own is None else (1, own)
    above = rows - less
    p = (toxic - bad) / above if above > 0 else 0.0
    for n, t in chain:
        n, t = n - less, t - bad
        if n <= 0:
            break
        if n != above:
            p, above = (t + PULL * p) / (n + PULL), n
    return p


@dataclass
class Lexicon:
    """rows, toxic: labelled texts; chains: counts from the root to each stem, and to each whole word with END;
    seeds: counts of the fixed terms; seen, spelt: counts of misspellings, by word and by the term they are near."""

    rows: int = 0
    toxic: int = 0
    chains: dict[str, tuple[tuple[int, int], ...]] = field(default_factory=dict)
    seeds: dict[str, tuple[int, int]] = field(default_factory=dict)
    seen: dict[str, tuple[int, int]] = field(default_factory=dict)
    spelt: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: tuple[float, ...] = DEFAULT

    def key(self, word: str) -> str | None:
        """Deepest node on the path of a word."""
        chains = self.chains
        if word + END in chains:
            return word + END
        return next((word[:k] for k in range(min(len(word), DEEPEST), 0, -1) if word[:k] in chains), None)

    def exact(self, word: str, own: int | None = None) -> float:
        if (c := self.seeds.get(word)) is not None:
            n, t = c
            return (t - (own or 0) + 1.6) / (n - (own is not None) + 2) if n else 0.8
        k = self.key(word)
        return 0.0 if k is None else evidence(self.chains[k], self.rows, self.toxic, own)

    def terms(self) -> list[Term]:
        hot = [(k, evidence(c, self.rows, self.toxic)) for k, c in self.chains.items()]
        out = {(k.removesuffix(END), not k.endswith(END)): p for k, p in hot if p >= HOT}
        out |= {(w, False): self.exact(w) for w in self.seeds}
        return [Term(w, stem, p) for (w, stem), p in sorted(out.items())]


class TermAutomaton:
    """Lexicon trie times Levenshtein automaton, determinised lazily. States are sets of (node, edits, awaited)."""

    DEAD = 0

    def __init__(self, terms: list[Term], least_word: int = LEAST_WORD, least_stem: int = LEAST_STEM, most_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.terms, self.least_word, self.least_stem, self.most_states = terms, least_word, least_stem, most_states
        for i, t in enumerate(terms):
            node = 0
            for ch in t.text:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.children[node][ch] = nxt
                node = nxt
            (self.stem if t.stem else self.word)[node] = i
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.delta: list[dict[str, int]] = [{}]
        self.at_end: list[tuple[int, int] | None] = [None]
        self.passing: list[tuple[int, int] | None] = [None]
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """Skipping a letter of the term costs an edit."""
        out = set(items)
        for node, e, wait in items:
            if e == 0 and not wait:
                out.update((c, 1, "") for c in self.children[node].values())
        return frozenset(out)

    def _best(self, items: frozenset, table: dict[int, int], least: int) -> tuple[int, int] | None:
        found = [(e, table[n]) for n, e, wait in items if not wait and n in table and (e == 0 or len(self.terms[table[n]].text) >= least)]
        return min(found, default=None)

    def _state(self, items: frozenset) -> int:
        if (k := self.ids.get(items)) is None:
            k = self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.delta.append({})
            self.at_end.append(self._best(items, self.word, self.least_word))
            self.passing.append(self._best(items, self.stem, self.least_stem))
        return k

    def _step(self, k: int, ch: str) -> int:
        out = set()
        for node, e, wait in self.sets[k]:
            if wait:
                if ch == wait:
                    out.add((node, e, ""))
                continue
            kids = self.children[node]
            if ch in kids:
                out.add((kids[ch], e, ""))
            if e == 0:
                out.add((node, 1, ""))  # an extra letter
                for other, c in kids.items():
                    out.add((c, 1, ""))  # another letter
                    if ch in self.children[c]:
                        out.add((self.children[c][ch], 1, other))  # two letters swapped
        out = self._state(self._closed(out))
        self.delta[k][ch] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        if len(self.sets) > self.most_states:
            self._reset()
        k, delta, passing, best = self.start, self.delta, self.passing, None
        for ch in word:
            nxt = delta[k].get(ch)
            k = self._step(k, ch) if nxt is None else nxt
            if k == 0:
                return best
            if (p := passing[k]) is not None and (best is None or p < best):
                best = p
        end = self.at_end[k]
        return end if best is None or (end is not None and end < best) else best


class Matcher:
    def __init__(self, lexicon: Lexicon, most_memo: int = 200_000):
        self.lexicon, self.most_memo = lexicon, most_memo
        self.terms = lexicon.terms()
        self.automaton = TermAutomaton(self.terms, SHORT_WORD, SHORT_STEM)
        self.memo: dict[str, tuple[str, int, float] | None] = {}

    def hit(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, precision) of a word that is a term, begins with one or is a misspelling of one."""
        try:
            return self.memo[word]
        except KeyError:
            pass
        if len(self.memo) > self.most_memo:
            self.memo.clear()
        found = self.automaton.match(word)
        if found is None:
            out = None
        elif found[0] == 0:
            p = self.lexicon.exact(word)
            out = (self.terms[found[1]].text, 0, p) if p >= HOT else None
        else:
            p = self.misspelt(word, self.terms[found[1]])
            out = (self.terms[found[1]].text, 1, p) if p >= HOT else None
        self.memo[word] = out
        return out

    def misspelt(self, word: str, term: Term, own: int | None = None) -> float:
        """Precision of a word one edit from a term: what labelled texts say of it, over what the term lets expect."""
        long = len(term.text) >= (LEAST_STEM if term.stem else LEAST_WORD)
        n, t = self.lexicon.seen.get(word, (0, 0))
        if own is not None and n:
            n, t = n - 1, t - own
        near, toxic = self.lexicon.spelt.get(term.text, (0, 0))
        return (t + 2 * (term.precision * (toxic + 4 * 0.85) / (near + 4) if long else 0.0)) / (n + 2)

    def hits(self, text: str | None, reach: int = 6) -> list[tuple[int, str, str, int, float, float]]:
        """(token number, word, term, edits, precision, factor of the context) of each hit."""
        if not text:
            return []
        tokens = TOKEN.findall(text.lower())
        hit = self.hit
        bad = {w for w in set(tokens) if hit(w) is not None}
        if not bad:
            return []
        at = [i for i, w in enumerate(tokens) if w in bad]
        out = []
        for n, i in enumerate(at):
            term, e, p = hit(tokens[i])
            before, after = tokens[max(0, i - reach) : i], tokens[i + 1 : i + 1 + reach]
            quoted = not QUOTES.isdisjoint(before) and not QUOTES.isdisjoint(after)
            report = not REPORTING.isdisjoint(before) or not REPORTING.isdisjoint(after)
            near = (n > 0 and i - at[n - 1] <= reach) + (n + 1 < len(at) and at[n + 1] - i <= reach)
            address = not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after)
            factor = (0.25 if report else 0.6) if quoted else (0.85 if report else 1.0)
            out.append((i, tokens[i], term, e, p, factor * (1 + 0.1 * near + 0.1 * address)))
        return out

    def features(self, text: str | None, own: int | None = None) -> tuple[float, float, float]:
        """Strongest hit, log of the sum of evidence, log of the sum of log odds, over distinct words. With `own`,
        the label of this text, the text itself is left out of what is known of its words."""
        best: dict[str, tuple[float, float]] = {}
        for _, w, term, e, p, factor in self.hits(text):
            if own is not None:
                p = self.lexicon.exact(w, own) if e == 0 else self.misspelt(w, next(x for x in self.terms if x.text == term), own)
            p = min(p, 0.995)
            if p >= HOT and factor > best.get(w, (0, 0))[1]:
                best[w] = p, factor
        if not best:
            return 0.0, 0.0, 0.0
        strong = [min(1.0, p * f) for p, f in best.values()]
        odds = sum(math.log(p / (1 - p)) * f for p, f in best.values())
        return max(strong), math.log1p(sum(strong)), math.log1p(odds)


def _counted_in(batches: Iterator[pa.RecordBatch], keys_of, flush: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Texts and toxic texts by key, summed in each task; keys_of(text) is a set."""
    n, t = Counter(), Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([t[k] for k in n], pa.int64())], names=["node", "n", "t"])

    for rb in pieces(batches, "text"):
        for text, toxic in zip(rb.column("text").to_pylist(), rb.column("toxic").to_pylist(), strict=True):
            keys = keys_of(text)
            n.update(keys)
            if toxic:
                t.update(keys)
            if len(n) > flush:
                yield out()
                n.clear()
                t.clear()
    yield out()


def trie_nodes(text: str | None) -> set[str]:
    """Prefixes of all words of a text, and the words closed by END."""
    out = set()
    for w in set(TOKEN.findall((text or "").lower())) - QUOTES:
        out.update(w[:k] for k in range(1, min(DEEPEST, len(w)) + 1))
        out.add(w + END)
    return out


def sample_labelled(documents: DataFrame, labels: DataFrame, usable, most_rows: int) -> DataFrame:
    """text and toxic of at most `most_rows` labelled documents, lowest hash of the id first. A document with
    several labels is toxic if one says so; null labels are left out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # most_rows bounds what is broadcast
    return documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")


def chains_of(nodes: dict[str, tuple[int, int]]) -> dict[str, tuple[tuple[int, int], ...]]:
    """Counts on the path from the root to each node."""
    out: dict[str, tuple[tuple[int, int], ...]] = {}
    for k in sorted(nodes, key=len):
        stem = k.removesuffix(END)
        upto = min(len(stem), DEEPEST) if k.endswith(END) else len(stem) - 1
        up = next((out[stem[:j]] for j in range(upto, 0, -1) if stem[:j] in out), ())
        out[k] = (*up, nodes[k])
    return out


def _collected(counts: DataFrame) -> dict[str, tuple[int, int]]:
    return {r["node"]: (r["n"], r["t"]) for r in counts.collect()}


def learn(sample: DataFrame, seeds: tuple[str, ...] = SEEDS) -> Lexicon:
    """A lexicon from rows of text and toxic (0 or 1)."""
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    sums = [F.sum("n").alias("n"), F.sum("t").alias("t")]

    def counted(keys_of) -> DataFrame:
        return sample.select("text", "toxic").mapInArrow(lambda it: _counted_in(it, keys_of), "node string, n long, t long").groupBy("node").agg(*sums)

    nodes = staged(counted(trie_nodes).where("n >= 2"), "trie-nodes")
    try:
        # Nodes that can hold terms: texts at least three, and a fifth of them, toxic; the rest stays at the base rate.
        kept = _collected(nodes.where("t >= 3 and 5 * t >= n"))
        hot = {k for k, c in chains_of(kept).items() if evidence(c, totals["n"], totals["t"]) >= HOT}

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                yield rb.filter(pa.array([any(k[:j] in hot for j in range(1, min(len(k), DEEPEST + 1))) for k in rb.column("node").to_pylist()], pa.bool_()))

        # And all nodes below a term, so that a clean ending of a toxic stem is known as such.
        kept |= _collected(nodes.mapInArrow(below, nodes.schema)) if hot else {}
        found = _collected(nodes.where(F.col("node").isin([w + END for w in seeds])))
    finally:
        drop_stage(nodes)
    chains = chains_of(kept)
    family = Counter(k[:j] for k in chains if k.endswith(END) for j in range(1, min(len(k), DEEPEST + 1)))
    chains = {k: c for k, c in chains.items() if (k.endswith(END) or family[k] >= FAMILY) and (k in hot or any(k[:j] in hot for j in range(1, len(k))))}
    lexicon = Lexicon(totals["n"], totals["t"], chains, {w: found.get(w + END, (0, 0)) for w in seeds})

    def variants(text: str | None) -> set[str]:
        """Words one edit from a term, and with END the terms, of texts that hold no term as it is written."""
        m = matcher()
        words = {w: x for w in set(TOKEN.findall((text or "").lower())) if (x := m.automaton.match(w)) is not None}
        if any(e == 0 and lexicon.exact(w) >= HOT for w, (e, _) in words.items()):
            return set()
        return {k for w, (e, term) in words.items() if e for k in (w, m.terms[term].text + END)}

    held: list[Matcher] = []

    def matcher() -> Matcher:
        if not held:
            held.append(Matcher(lexicon))
        return held[0]

    near = staged(counted(variants), "misspellings")
    lexicon.seen = _collected(near.where((F.col("n") >= 2) & ~F.col("node").endswith(END)))
    lexicon.spelt = {k.removesuffix(END): c for k, c in _collected(near.where(F.col("node").endswith(END))).items()}
    drop_stage(near)
    held.clear()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for rb in pieces(batches, "text"):
            y = rb.column("toxic").to_pylist()
            f = np.array([m.features(x, k) for x, k in zip(rb.column("text").to_pylist(), y, strict=True)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(3)), pa.array(y, pa.int64())], names=["a", "b", "c", "y"])

    # Rounded features repeat, so what reaches the driver is a histogram of a bounded sample.
    rounded = [F.round(c, d).alias(c) for c, d in (("a", 2), ("b", 1), ("c", 1))]
    grid = sample.select("text", "toxic").mapInArrow(featured, "a double, b double, c double, y long").groupBy(*rounded, "y").count().collect()
    if grid:
        lexicon.weights = _logistic(np.array([[r["a"], r["b"], r["c"]] for r in grid]), np.array([r["y"] for r in grid], float), np.array([r["count"] for r in grid], float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, pull: float = 0.5, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton steps, pulled towards the default weights; no weight of a feature falls below 0."""
    x = np.column_stack([np.ones(len(x)), x])
    keep, start, penalty = np.ones(x.shape[1], bool), np.array(DEFAULT), np.array([0.05] + [pull] * (x.shape[1] - 1))
    while True:
        b = np.where(keep, start, 0.0)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            g = x.T @ (w * (y - p)) - penalty * (b - start)
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.zeros_like(b)
            step[keep] = np.linalg.solve(h[np.ix_(keep, keep)], g[keep])
            b += np.clip(step, -3, 3)
            if abs(step).max() < 1e-8:
                break
        if (b[1:] >= 0).all():
            return tuple(float(v) for v in b)
        keep[1:] &= b[1:] >= 0


def score_text(matcher: Matcher, text: str | None) -> float:
    a, b, c = matcher.features(text)
    w = matcher.lexicon.weights
    z = w[0] + w[1] * a + w[2] * b + w[3] * c
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """`row` (a struct of the columns in keep; all but text by default, and then text beside it), score (0 to 1)
    and predicted (1 if score >= threshold) for every row. Rows stay where they are: there is no shuffle."""
    source = rows_and_text(documents, keep)
    carried = ["row"] if keep else ["row", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for rb in pieces(batches, "text"):
            s = pa.array([score_text(m, x) for x in rb.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in carried), s], names=[*carried, "score"])

    schema = T.StructType([*(source.schema[c] for c in carried), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """All columns of the documents whose score is under the threshold."""
    return score(documents, lexicon, threshold).where("predicted = 0").select(*unpacked(documents))


def spans(matcher: Matcher, text: str | None) -> list[dict]:
    """The hits of one text, for reports: word, term, edits, evidence."""
    return [{"token": i, "word": w, "term": term, "edits": e, "evidence": min(1.0, p * f)} for i, w, term, e, p, f in matcher.hits(text)]


def train(documents: DataFrame, labels: DataFrame, usable, most_rows: int) -> Lexicon:
    """A lexicon from the labelled documents for which `usable`, a condition on doc_id, holds."""
    once = sample_labelled(documents, labels, usable, most_rows).groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = staged(once.select("text", "toxic"), "toxic-sample")
    try:
        return learn(sample)
    finally:
        drop_stage(sample)
