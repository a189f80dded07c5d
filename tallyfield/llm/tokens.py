"""Exact token ids from a public tokenizer file, with a cache of words.

A text is cut before each blank that a non-blank follows. The pre-tokenizers of the supported files always
begin a new piece there, so ids of the parts, joined, are the ids of the text. Parts repeat; their ids are
kept as little-endian 32-bit bytes, and a text's ids are one join of cached bytes.

Defined results: null text is the empty text; an empty text has no ids but the closing one.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import kept_between_tasks

RUNS = re.compile(r"\s\s")
CUT = re.compile(r" (?=\S)")
# Words of letters that keep their form in every normal form and case, ASCII signs but ' and <, and line ends:
# between them every supported pre-tokenizer cuts too.
SUB = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+| ?[!-&(-/:;=-@\[-`{-~]+|\n")


UNSAFE = re.compile(r"[^A-Za-zÀ-ÖØ-öø-įı-ɏ!-&(-/:;=-@\[-`{-~ \n]")


class Encoder:
    """The cache has two generations, so that a full one drops what was not read lately."""

    def __init__(self, path: str, end_id: int, most_memo: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.end, self.most_memo = np.array([end_id], "<u4").tobytes(), most_memo
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.by_end = any(t.endswith("</w>") for t in vocab)  # words end with a mark, or begin with that of a blank
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.by_end else t[0] == "\u0120")]] = True
        self.seen = bytearray(1 << 22)  # hashes of words met once; a word is kept when it comes back
        self.n_seen = 0
        self.vocab = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)

    def ids(self, text: str | None) -> bytes:
        """All ids of a text and the closing id, as little-endian 32-bit bytes."""
        if not text:
            return self.end
        parts = self._parts(text)
        got = list(map(self.new.get, parts))
        if None in got:
            at, i = [], -1
            try:
                while True:
                    i = got.index(None, i + 1)
                    at.append(i)
            except ValueError:
                pass
            found = self._found([parts[i] for i in at])
            for i in at:
                got[i] = found[parts[i]]
            if len(self.new) > self.most_memo:
                self.old, self.new = self.new, {}
        got.append(self.end)
        return b"".join(got)

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Pieces between which every supported pre-tokenizer cuts; joined they are the text."""
        if RUNS.search(text):
            cut = CUT.split(text)
        elif UNSAFE.search(text) or text[-1] == " ":
            cut = text.split(" ")
        else:  # single blanks and safe signs only: words, signs and line ends
            parts = SUB.findall(text)
            if sum(map(len, parts)) == len(text):
                return parts
            cut = text.split(" ")
        return [cut[0], *[" " + p for p in cut[1:]]]

    def _found(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of parts that the younger generation lacks."""
        new, old, seen = self.new, self.old, self.seen
        out: dict[str, bytes] = {}
        plain: dict[str, None] = {}  # a blank and letters: encoded together, told apart by the marks
        other: dict[str, None] = {}
        made: list[tuple[str, list[str]]] = []
        for p in dict.fromkeys(missing):
            if (b := old.get(p)) is not None:
                new[p] = out[p] = b
            elif p[1:].isalpha() and p[0] not in "\n\t":
                (plain if p[0] == " " or self.by_end else other)[p] = None
            elif "\n\n" not in p and len(sub := SUB.findall(p)) > 1 and "".join(sub) == p:
                made.append((p, sub))
                for w in sub:
                    if w not in out:
                        if (b := new.get(w) or old.get(w)) is not None:
                            out[w] = b
                        elif w[1:].isalpha() and (w[0] == " " or self.by_end):
                            plain[w] = None
                        else:
                            other[w] = None
            else:
                other[p] = None
        if plain:
            ids = np.array(self.tokenizer.encode((" " if self.by_end else "").join(plain), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(plain):
                cut = [0, *(at + 1).tolist()] if self.by_end else [*at.tolist(), len(ids)]
                raw = ids.tobytes()
                for k, w in enumerate(plain):
                    out[w] = raw[4 * cut[k] : 4 * cut[k + 1]]
            else:
                other |= plain
        if other:
            for w, e in zip(other, self.batch(list(other), add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, "<u4").tobytes()
        for p, sub in made:
            out[p] = b"".join([out[w] for w in sub])
        for w in (plain, other, [p for p, _ in made]):
            for p in w:
                h = hash(p) & 0x1FFFFFF
                if seen[h >> 3] >> (h & 7) & 1:
                    new[p] = out[p]
                else:
                    seen[h >> 3] |= 1 << (h & 7)
                    self.n_seen += 1
        if self.n_seen > 8_000_000:
            self.seen, self.n_seen = bytearray(1 << 22), 0
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, end_id)


kept_between_tasks("tokens", encoder.cache_clear)
