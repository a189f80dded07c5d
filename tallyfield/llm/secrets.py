"""Secret scans by one combined deterministic automaton.

Rules are regular expressions over bytes. They are parsed into one NFA, made deterministic by subset
construction, minimised by partition refinement, and kept as a transition array (states x 256) with a bit
mask of rules for each state. It is built twice from the same NFA:

* `starts`, with all arrows turned round: one pass over the bytes of a batch of texts, from the end to the
  beginning, in which the mask of a state tells at which bytes a match of which rule begins. The batch is one
  buffer cut at bytes that lead every state back to the first one, and the pieces step together, one numpy
  gather for each byte column.
* `ends`, as it stands: from a beginning that was found it reads the bytes of the match, all rules at once, to
  its longest end. Bytes outside of matches are read once, those of matches twice, so time is linear in the
  text whatever it repeats.

Defined results: null or empty text has no spans. Spans are in code points, the end is exclusive. Rules
never cross a NUL or newline. Rows that repeat are scanned each; other columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_between_tasks, pieces, rows_and_text, unpacked


@dataclass(frozen=True)
class Rule:
    """kind; pattern (literals, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}); least length of the match or, for
    an assignment (keyword, : or =, value), of its value."""

    kind: str
    pattern: str
    least: int = 1
    assigns: bool = False


# The base rules, then those that this method adds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
BASE = (Rule("assign", ASSIGN, 12, True), Rule("access", r"AKIA[A-Z0-9]+", 18), Rule("hex", r"[0-9a-f]+", 16))
ADDED = (
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("forge", r"(ghp|gho|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]+", 27),
)


class _Parser:
    """Regular expression over bytes to an NFA fragment (start, end)."""

    def __init__(self, pattern: str, nfa: _Nfa):
        self.s, self.i, self.nfa = pattern.encode(), 0, nfa

    def peek(self) -> int:
        return self.s[self.i] if self.i < len(self.s) else -1

    def alternation(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == ord("|"):
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in parts:
            self.nfa.empty[a].append(x)
            self.nfa.empty[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self.peek() not in (-1, ord("|"), ord(")")):
            x, y = self.repeated()
            self.nfa.empty[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        x, y = self.atom()
        end = self.i
        least, most = 1, 1
        c = self.peek()
        if c != -1 and c in b"?*+":
            self.i += 1
            least, most = {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}[c]
        elif c == ord("{"):
            close = self.s.index(b"}", self.i)
            body = self.s[self.i + 1 : close].decode().split(",")
            least, most = int(body[0]), (int(body[0]) if len(body) == 1 else int(body[1]) if body[1] else None)
            self.i = close + 1
        after = self.i

        def again() -> tuple[int, int]:
            self.i = begin
            out = self.atom()
            assert self.i == end
            return out

        if (least, most) == (1, 1):
            return x, y
        nfa = self.nfa
        a = b = nfa.state()
        copies = max(least, 1) if most is None else most
        first = True
        last = (x, y)
        for k in range(copies):
            p, q = (x, y) if first else again()
            first = False
            nfa.empty[b].append(p)
            out = nfa.state()
            nfa.empty[q].append(out)
            if k >= least:
                nfa.empty[b].append(out)
            last, b = (p, q), out
        if most is None:
            nfa.empty[last[1]].append(last[0])
            if least == 0:
                nfa.empty[a].append(b)
        self.i = after
        return a, b

    def _escaped(self) -> int:
        self.i += 1
        c = self.s[self.i]
        if c == ord("x"):
            out = int(self.s[self.i + 1 : self.i + 3], 16)
            self.i += 3
            return out
        self.i += 1
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(c, c)

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == ord("("):
            self.i += 1
            out = self.alternation()
            self.i += 1
            return out
        if c == ord("["):
            self.i += 1
            allowed: set[int] = set()
            while self.peek() != ord("]"):
                lo = self._escaped() if self.peek() == ord("\\") else self._take()
                if self.peek() == ord("-") and self.s[self.i + 1] != ord("]"):
                    self.i += 1
                    hi = self._escaped() if self.peek() == ord("\\") else self._take()
                    allowed.update(range(lo, hi + 1))
                else:
                    allowed.add(lo)
            self.i += 1
        elif c == ord("\\"):
            allowed = {self._escaped()}
        else:
            allowed = {self._take()}
        a, b = self.nfa.state(), self.nfa.state()
        for x in allowed:
            self.nfa.step[a][x].append(b)
        return a, b

    def _take(self) -> int:
        self.i += 1
        return self.s[self.i - 1]


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[dict[int, list[int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(defaultdict(list))
        return len(self.empty) - 1

    def turned(self) -> _Nfa:
        """The same states with all arrows turned round."""
        out = _Nfa()
        for _ in self.empty:
            out.state()
        for s, (free, steps) in enumerate(zip(self.empty, self.step, strict=True)):
            for t in free:
                out.empty[t].append(s)
            for b, ts in steps.items():
                for t in ts:
                    out.step[t][b].append(s)
        return out

    def closed(self, states) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for t in self.empty[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """table[s, b]: next state; mask[s]: bits of accepted rules; state `start`; state `dead` (-1 if none)."""

    table: np.ndarray
    mask: np.ndarray
    start: int
    dead: int


def compile_rules(patterns: list[str], backward: bool) -> Dfa:
    """Subset construction over all patterns, then minimisation. Backward, matches are read from their end to their
    beginning and may end anywhere; forward, they begin where reading begins."""
    nfa = _Nfa()
    ends = [_Parser(p, nfa).alternation() for p in patterns]
    if backward:
        nfa, ends = nfa.turned(), [(b, a) for a, b in ends]
    root = nfa.state()
    nfa.empty[root] += [a for a, _ in ends]
    accept = {b: k for k, (_, b) in enumerate(ends)}
    first = nfa.closed([root])
    ids, rows, masks, todo = {first: 0}, [], [], [first]
    base = first if backward else frozenset()
    while len(rows) < len(todo):
        now = todo[len(rows)]
        moves: dict[int, set[int]] = defaultdict(set)
        for s in now:
            for b, ts in nfa.step[s].items():
                moves[b].update(ts)
        row = np.empty(256, np.int32)
        memo: dict[frozenset, int] = {}
        for b in range(256):
            raw = frozenset(moves.get(b, ()))
            if raw not in memo:
                target = nfa.closed(raw) | base
                if target not in ids:
                    ids[target] = len(todo)
                    todo.append(target)
                memo[raw] = ids[target]
            row[b] = memo[raw]
        rows.append(row)
        masks.append(sum({1 << accept[s] for s in now if s in accept}))
    return _minimised(np.array(rows), np.array(masks, np.int64))


def _minimised(table: np.ndarray, mask: np.ndarray) -> Dfa:
    """Refine the partition by accepted rules until classes of successors agree (Moore)."""
    _, cls = np.unique(mask, return_inverse=True)
    while True:
        key = np.column_stack([cls, cls[table]])
        _, new = np.unique(key, axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == cls.max():
            break
        cls = new
    n = cls.max() + 1
    one = np.zeros(n, int)
    one[cls] = np.arange(len(cls))
    small = cls[table[one]].astype(np.int32)
    m = mask[one]
    stuck = [s for s in range(n) if m[s] == 0 and (small[s] == s).all()]
    return Dfa(np.ascontiguousarray(small), m, int(cls[0]), stuck[0] if stuck else -1)


FEW = 24  # pieces that are read one by one


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    starts: Dfa
    sync: np.ndarray  # bytes that lead every state of `starts` to the first one
    back: list[list[int]]  # `starts` as plain lists: next states and masks
    back_masks: list[int]
    rows: list[list[int]]  # `ends` as plain lists: next states, masks, first and dead state
    masks: list[int]
    start: int
    dead: int


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = BASE + ADDED) -> Scanner:
    def witness(r: Rule) -> str:
        """A match of r+ begins where one of r does, so a closing + need not be tracked; a single class keeps its length."""
        if not r.pattern.endswith("+"):
            return r.pattern
        return r.pattern[:-1] + ("{%d}" % r.least if r.pattern[0] == "[" and r.pattern.count("[") == 1 else "")

    starts = compile_rules([witness(r) for r in rules], True)
    ends = compile_rules([r.pattern for r in rules], False)
    return Scanner(rules, starts, (starts.table == starts.start).all(axis=0), starts.table.tolist(), starts.mask.tolist(), ends.table.tolist(), ends.mask.tolist(), ends.start, ends.dead)


kept_between_tasks("scanner", scanner.cache_clear)


def beginnings(texts: list[bytes], s: Scanner, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, byte, mask of rules) of every place where matches begin, by text and byte: one pass over all bytes,
    from the end, many pieces at a time."""
    none = np.zeros(0, np.int64)
    if not any(texts):
        return none, none, none
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    cuts = np.flatnonzero(s.sync[buffer])  # a piece ends before a synchronising byte, or at the end
    want = np.linspace(0, len(buffer), min(lanes, max(1, len(buffer) // 256)) + 1)[1:-1]
    picked = np.unique(cuts[np.minimum(np.searchsorted(cuts, want), len(cuts) - 1)]) if len(want) else none
    edge = np.concatenate([[0], picked[picked > 0], [len(buffer)]])
    length = np.diff(edge)
    order = np.argsort(-length, kind="stable")
    end, length = edge[1:][order], length[order]
    flat, width, mask = s.starts.table.astype(np.int32).ravel() << 8, int(length[0]), s.starts.mask
    hot = mask != 0
    state = np.full(len(end), s.starts.start << 8, np.int32)
    alive = np.searchsorted(-length, -np.arange(width), side="left")  # pieces longer than the column number
    places, kinds = [none], [none]
    for k in range(width):
        n = alive[k]
        if n <= FEW:  # a few long pieces are left: one by one is faster
            for p, st in zip(range(n), state[:n].tolist(), strict=True):
                at, bits = _walked(buffer[end[p] - length[p] : end[p] - k].tobytes(), st >> 8, s)
                places.append(at + end[p] - length[p])
                kinds.append(bits)
            break
        pos = end[:n] - 1 - k
        state[:n] = flat[state[:n] | buffer[pos]]
        found = hot[state[:n] >> 8]
        if found.any():
            at = np.flatnonzero(found)
            places.append(pos[at])
            kinds.append(mask[state[at] >> 8])
    place, kind = np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(place, kind="stable")
    place, kind = place[order], kind[order]
    text = np.searchsorted(first, place, side="right") - 1
    return text, place - first[text], kind


def _walked(raw: bytes, state: int, s: Scanner) -> tuple[np.ndarray, np.ndarray]:
    """(byte, mask) of the beginnings in one piece, read from its end in the given state."""
    rows, masks = s.back, s.back_masks
    at, bits = [], []
    for i in range(len(raw) - 1, -1, -1):
        state = rows[state][raw[i]]
        if masks[state]:
            at.append(i)
            bits.append(masks[state])
    return np.array(at, np.int64), np.array(bits, np.int64)


def longest(raw: bytes, begin: int, rule: int, s: Scanner) -> int:
    """End of the longest match of a rule that begins at a byte, or -1."""
    rows, masks, dead, st, end, bit = s.rows, s.masks, s.dead, s.start, -1, 1 << rule
    for j in range(begin, len(raw)):
        st = rows[st][raw[j]]
        if st == dead:
            break
        if masks[st] & bit:
            end = j + 1
    return end


def _value_start(raw: bytes, i: int, end: int) -> int:
    """Where the value of an assignment begins: after keyword, quote, blanks, sign, blanks, quote."""
    j = i
    while raw[j] not in b":=":
        j += 1
    j += 1
    while j < end and raw[j] == 0x20:
        j += 1
    if raw[j] in b"\"'":
        j += 1
    return j


def find_all(texts: list[str | None], s: Scanner) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points for each text, by start and then by order of the rules: leftmost-longest,
    non-overlapping for each rule; matches that are too short are dropped after matching."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    found: dict[int, list[tuple[int, int, str, int]]] = defaultdict(list)
    past: dict[tuple[int, int], int] = {}  # where the last match of a rule ended in a text
    for d, i, mask in zip(*(x.tolist() for x in beginnings(raw, s)), strict=True):
        while mask:
            k = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            if i >= past.get((d, k), 0):
                rule, j = s.rules[k], longest(raw[d], i, k, s)
                past[d, k] = j
                if j - (_value_start(raw[d], i, j) if rule.assigns else i) >= rule.least:
                    found[d].append((i, k, rule.kind, j))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for d, spans in found.items():
        if len(raw[d]) == len(texts[d]):
            out[d] = [(kind, i, j) for i, _, kind, j in sorted(spans)]
        else:  # code points before each byte, counted once
            begun = np.concatenate([[0], np.cumsum((np.frombuffer(raw[d], np.uint8) & 0xC0) != 0x80)])
            out[d] = [(kind, int(begun[i]), int(begun[j])) for i, _, kind, j in sorted(spans)]
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in found)


def scan(documents: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """doc_id, spans (joined kind:start:end), base_sha256 and a count for each base kind, for every row."""
    base = [r.kind for r in BASE]

    source = rows_and_text(documents, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for rb in pieces(batches, "text", 4 << 20, "scanner"):
            found = find_all(rb.column("text").to_pylist(), s)
            counts = [pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in base]
            digest = pa.array([hashlib.sha256(joined([x for x in f if x[0] in base]).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([rb.column("row"), *counts, digest, pa.array([joined(f) for f in found], pa.string())], names=["row", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    schema = T.StructType([source.schema["row"], *(T.StructField(f"n_{k}", T.LongType()) for k in base), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return source.mapInArrow(run, schema).select("row.doc_id", *(f.name for f in schema.fields[1:]))


def redact_text(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, overlaps merged, replaced by [kind]."""
    if not found or text is None:
        return text
    merged: list[list] = []
    for kind, i, j in found:
        if merged and i < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], j)
        else:
            merged.append([kind, i, j])
    out, last = [], 0
    for kind, i, j in merged:
        out += [text[last:i], f"[{kind}]"]
        last = j
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """All rows and columns of documents; secrets in text are replaced by [kind] and n_chars follows where
    the table has it. No row goes."""
    source, schema = rows_and_text(documents), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for rb in pieces(batches, "text", 4 << 20, "scanner"):
            texts = rb.column("text").to_pylist()
            clean = [redact_text(t, f) for t, f in zip(texts, find_all(texts, s), strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column("row"), pa.array(clean, pa.string())], names=["row", "text"])

    done = source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("text", T.StringType())]))
    out = done.select(*unpacked(documents))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(schema["n_chars"].dataType))
    return out
