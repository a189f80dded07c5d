"""Fill-in-the-middle: a byte automaton scans whole texts, a second pass places the cuts.

A table over (state, byte) holds the next state and what the byte begins: a unit (a run of letters A-Z and a-z, or one other
code point), a code point, the last byte of a sentinel. States stand for a run of letters, a possible sentinel, and the
bytes that a UTF-8 character still needs. All texts of a batch are scanned in blocks that step together; a block within
a text begins in the state to which the few bytes before it lead from anywhere.

Null text is the empty text, an empty text is plain, a null id counts as no digits; repeated rows get the same cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, rows_and_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
OTHER, RUN, OPEN, NAMED, ONE_MORE, TWO_MORE, THREE_MORE = range(7)
STATES = 7
UNIT, POINT, SENTINEL = 1, 2, 4
BLOCK = 512


@lru_cache(1)
def transitions() -> np.ndarray:
    """Next state and, three bits higher, what begins, for state * 256 + byte."""
    table = np.zeros((STATES, 256), np.uint8)
    for state in range(STATES):
        for byte in range(256):
            c = chr(byte)
            if 0x80 <= byte < 0xC0:
                to, says = (state - 1 if state > ONE_MORE else OTHER), 0
            elif byte >= 0xC0:
                to, says = (THREE_MORE if byte >= 0xF0 else TWO_MORE if byte >= 0xE0 else ONE_MORE), UNIT | POINT
            elif c.isalpha():
                to, says = (NAMED if state == OPEN and c in "PSM" else RUN), POINT | (0 if state in (RUN, NAMED) else UNIT)
            else:
                to, says = (OPEN if c == "<" else OTHER), UNIT | POINT | (SENTINEL if c == ">" and state == NAMED else 0)
            table[state, byte] = to | says << 3
    return table.reshape(-1)


@lru_cache(1)
def memory() -> int:
    """The least number of bytes after which the state no longer depends on where the automaton began."""
    table = {tuple(column) for column in (transitions().reshape(STATES, 256) & 7).T.tolist()}
    maps, steps = {tuple(range(STATES))}, 0
    while any(len(set(m)) > 1 for m in maps):
        maps, steps = {tuple(t[s] for s in m) for m in maps for t in table}, steps + 1
    return steps


def scan(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """What begins at each byte of the texts data[begins[i]:ends[i]]."""
    table, warm = transitions(), memory()
    assert block >= warm
    says = np.zeros(len(data), np.uint8)
    parts = -(-(ends - begins) // block)
    text = np.repeat(np.arange(len(begins)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = begins[text] + number * block
    size = np.minimum(ends[text] - at, block)
    order = np.argsort(-size, kind="stable")
    at, size, number = at[order], size[order], number[order]
    state = np.zeros(len(at), np.int32)
    inner = np.flatnonzero(number > 0)
    for back in range(warm, 0, -1):
        state[inner] = table[state[inner] << 8 | data[at[inner] - back]] & 7
    for k in range(int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -k, "left"))
        place = at[:active] + k
        to = table[state[:active] << 8 | data[place]]
        says[place] = to >> 3
        state[:active] = to & 7
    return says


def restored(output: bytes, form: str) -> bytes:
    """The text that `output` was made from."""
    if form == "plain":
        return output
    first, then = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, m = output.index(then), output.index(MIDDLE)
    one, two, middle = output[len(first) : a], output[a + len(then) : m], output[m + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def rearranged(seed: bytes, ids: list[str | None], data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """n, form, prefix_chars, middle_chars, output of each text."""
    says = scan(data, begins, ends)
    units = np.concatenate([[0], np.cumsum(says & UNIT, dtype=np.int64)])
    points = np.concatenate([[0], np.cumsum((says & POINT) >> 1, dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum((says & SENTINEL) >> 2, dtype=np.int64)])
    where = np.flatnonzero(says & UNIT)
    whole = data.tobytes()
    counts, marked = units[ends] - units[begins], marks[ends] - marks[begins]
    for i, (a, z, n, bad) in enumerate(zip(begins.tolist(), ends.tolist(), counts.tolist(), marked.tolist(), strict=True)):
        digest = hashlib.sha256(seed + b":" + (ids[i] or "").encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        if a == z or bad or h3 % 100 >= 90:
            yield n, "plain", None, None, whole[a:z]
            continue
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        b, c = (z if u == n else int(where[units[a] + u]) for u in cuts)
        form = "spm" if h4 % 100 < 20 else "psm"
        prefix, middle, suffix = whole[a:b], whole[b:c], whole[c:z]
        output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        yield n, form, int(points[b] - points[a]), int(points[c] - points[b]), output


def rearrange(documents: DataFrame, seed: str = "1", with_output: bool = True, columns: list[str] | None = None) -> DataFrame:
    """row (the given columns, all but text by default), n, form, prefix_chars, middle_chars, sha256 of the output and of the
    text rebuilt from it, and the output itself where asked for. `doc_id` decides the cuts."""
    key = str(seed).encode()
    columns = columns or [c for c in documents.columns if c != "text"]
    if "doc_id" not in columns:
        raise ValueError("the columns to carry must hold doc_id")
    source = rows_and_text(documents, columns).select("row", F.col("row.doc_id").cast("string").alias("id"), "text")
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output
    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text"):
            texts = rb.column("text").fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            buffer = texts.buffers()[2]
            data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            out: list[list] = [[] for _ in range(6 + with_output)]
            for n, form, prefix, middle, output in rearranged(key, rb.column("id").to_pylist(), data, offsets[:-1], offsets[1:]):
                values = [n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest()]
                for to, v in zip(out, values + [output.decode()] * with_output, strict=True):
                    to.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([rb.column("row"), *arrays], schema.names)

    return source.mapInArrow(run, schema)
