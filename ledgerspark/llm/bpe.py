"""Byte-level BPE by longest matches over an Aho-Corasick automaton, with backtracking."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are written as little-endian 32-bit integers")

#: Entries of a worker's memory of encoded words, about 200 bytes each; it is emptied when full.
REMEMBERED = 700_000
#: Matches of a text that are held at a time.
LONG = 1 << 20
#: Bytes of one match for which the tokens at each place are held at a time: memory besides this is 20 bytes for each of the match.
WINDOW = 1 << 16
#: Characters of a word or match that is remembered at most.
WORD = 64
#: A space before white space or at the end: only then may a match of the pattern go on over a space.
_RUN = re.compile(r" (?:\s|$)")


class Codec:
    """Encoder and decoder for a rank file (base64 token, blank, rank on each line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.spaced = " ?" in pattern  # words take one space before them
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.longest = self.most = max(map(len, self.rank))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.words: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def merge(self, data: bytes, under: int = 1 << 60) -> list[int]:
        """The defining procedure: the pair of lowest rank (of those under a rank) is merged, leftmost first, until none is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low[0] >= under or low[0] == 1 << 60:
                break
            parts[low[1]:low[1] + 2] = [parts[low[1]] + parts[low[1] + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token; a byte is twice itself. Remembered for each token."""
        if (known := self.made_of.get(token)) is None:
            data = self.token[token]
            known = (token, token)
            if len(data) > 1:
                known = self.made_of[token] = tuple(self.merge(data, token))
            self.made_of[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes give these two tokens; remembered by pair.

        Merges are taken back from the newest one. What then stands at the border must not be a pair that would
        have been merged before the merge taken back last.
        """
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        if len(self.compatible) > REMEMBERED:
            self.compatible.clear()
        token, rank, limit, ok = self.token, self.rank, 1 << 60, None
        a, b = left, right
        while ok is None:
            if rank.get(token[a] + token[b], 1 << 60) < limit:
                ok = False
            elif len(token[a]) == 1 and len(token[b]) == 1:
                ok = True
            elif len(token[b]) == 1 or (len(token[a]) > 1 and a > b):
                limit, a = a, self.halves(a)[1]
            else:
                limit, b = b + 1, self.halves(b)[0]  # of equal merges the left one comes first
        self.compatible[key] = ok
        return ok

    def encode_match(self, data: bytes) -> list[int]:
        """Tokens of one match of the pattern.

        A sequence of tokens is what the merges give exactly if each two neighbours are what the merges give
        for their bytes. So the longest token at each place is tried, then shorter ones; a place from which
        no way on was found is not entered again, so each place is left for good once at most.
        """
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        size, base, at = len(data), 0, self._starts(data, 0)
        out, places, nexts = array("I"), array("q"), array("h")  # tokens; where each begins; number of its next candidate
        dead = bytearray(size + 1)
        place, k = 0, len(at[0]) - 1
        while place < size:
            if not base <= place < base + WINDOW:
                base = place - place % WINDOW
                at = self._starts(data, base)
            here = at[place - base]
            k = min(k, len(here) - 1)
            while k >= 0:
                length, r = here[k]
                if not dead[place + length] and (not out or self.fits(out[-1], r)):
                    break
                k -= 1
            if k >= 0:
                places.append(place)
                nexts.append(k - 1)
                out.append(r)
                place += length
                k = self.most
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[place] = 1
                place, k = places.pop(), nexts.pop()
                out.pop()
        return out.tolist()

    def _starts(self, data: bytes, base: int) -> list[list[tuple[int, int]]]:
        """(length, token) of the tokens that begin at each place of a window, by length."""
        n = min(WINDOW, len(data) - base)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, r) in self.automaton.iter(data[base:base + n + self.longest].decode("latin-1")):
            if end + 1 - length < n:
                at[end + 1 - length].append((length, r))  # ends ascend, so lengths do
        return at

    def _match(self, m: str) -> bytes:
        if len(m) > WORD:
            return array("I", self.encode_match(m.encode("utf-8"))).tobytes()
        got = self.matches.get(m)
        if got is None:
            if len(self.matches) >= REMEMBERED:
                self.matches.clear()
            got = self.matches[m] = array("I", self.encode_match(m.encode("utf-8"))).tobytes()
        return got

    def _word(self, w: str) -> bytes:
        if len(w) > WORD:
            return b"".join([self._match(m) for m in self.pattern.findall(" " + w)])
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        got = self.words[w] = b"".join([self._match(m) for m in self.pattern.findall(" " + w)])
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        A match always starts at a space that isn't followed by white space. Texts where every space is
        such a one are cut at the spaces, others by the pattern itself; words met before are looked up.
        """
        if self.spaced and not _RUN.search(text):
            head, *rest = text.split(" ")
            words = self.words
            out = [self._match(m) for m in self.pattern.findall(head)]
            for w in rest:
                out.append(words.get(w) or self._word(w))
            return b"".join(out)
        out, matches = [], (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(matches, LONG)):
            out.append(b"".join([self._match(m) for m in part]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every row's whole text, as an array. Null counts as empty."""
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = pa.array([np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), ids], ["id", "ids"])

    ship(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, encoded and decoded again.

    Null and empty texts have no tokens. Repeated rows and rows without id are returned each. An empty
    table gives an empty result. One pass without a shuffle; a lost task is just run again.
    """
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, i, d = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
