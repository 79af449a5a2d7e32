"""License scans by template markup: optional and replaceable regions compiled into token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: A phrase's words and its label.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Templates by label. [[ ... ]] may be absent; {{n}} stands for at most n words; a bar between
#: alternatives in (( ... )) chooses one. All other words are mandatory.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[,]] version 2.0",
    "mit": "(( released | licensed | distributed | available )) under [[ the terms of ]] the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                "[[ the software ]] to deal in the software without restriction including without limitation the rights to use copy modify merge "
                "publish distribute sublicense and or sell copies of the software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-notice": "this (( work | program | software | file | {{4}} )) is [[ free software ]] [[ you can redistribute it and or modify it ]] "
                  "(( licensed | released | distributed )) under [[ the terms of ]] the gnu general public license [[ , ]] [[ as published by the free software foundation ]] "
                  "[[ either ]] version {{1}}",
    "cc-by-nc": "licensed under [[ a ]] [[ creative commons ]] cc by nc [[ 4 0 ]]",
    "copyright-notice": "copyright [[ c ]] {{1}} [[ by ]] {{6}} all rights reserved",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z: runs of digits, a-z and everything beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Automaton:
    """States with transitions on words. `steps[s]` maps a word to states, `jumps[s]` are free moves and
    `wild[s]` are states reached by any word."""

    steps: list[dict[bytes, set[int]]] = field(default_factory=list)
    wild: list[set[int]] = field(default_factory=list)
    jumps: list[set[int]] = field(default_factory=list)
    start: int = 0
    end: int = 0

    def state(self) -> int:
        self.steps.append({})
        self.wild.append(set())
        self.jumps.append(set())
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, got = list(states), set(states)
        while todo:
            for t in self.jumps[todo.pop()] - got:
                got.add(t)
                todo.append(t)
        return frozenset(got)

    def move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        return self.closure({t for s in states for t in (*self.steps[s].get(word, ()), *self.wild[s])})

    def match(self, text: list[bytes], at: int) -> int | None:
        """End of the longest match that starts at word `at`, or None."""
        now, best = self.closure({self.start}), None
        while now:
            if self.end in now:
                best = at
            if at >= len(text):
                break
            now, at = self.move(now, text[at]), at + 1
        return best

    def first_words(self) -> set[bytes]:
        """Words that a match can start with; templates don't start with a replaceable region."""
        return {w for s in self.closure({self.start}) for w in self.steps[s]}


_MARK = re.compile(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\}\}|[^\s\[\]()|{}]+")


def compile_template(template: str) -> Automaton:
    """Automaton of a template; regions can be nested."""
    a = Automaton()
    tokens = _MARK.findall(template.lower())
    pos = 0

    def sequence(state: int, stop: tuple[str, ...]) -> int:
        nonlocal pos
        while pos < len(tokens) and tokens[pos] not in stop:
            t = tokens[pos]
            pos += 1
            if t == "[[":
                inner = sequence(state, ("]]",))
                pos += 1
                a.jumps[state].add(end := a.state())
                a.jumps[inner].add(end)
                state = end
            elif t == "((":
                end = a.state()
                while True:
                    a.jumps[state].add(begin := a.state())
                    a.jumps[sequence(begin, ("|", "))"))].add(end)
                    pos += 1
                    if tokens[pos - 1] == "))":
                        break
                state = end
            elif t.startswith("{{"):
                end = a.state()
                a.jumps[state].add(end)
                for _ in range(int(t[2:-2])):
                    a.wild[state].add(nxt := a.state())
                    a.jumps[nxt].add(end)
                    state = nxt
                state = end
            else:
                for w in words(t):
                    a.steps[state].setdefault(w, set()).add(nxt := a.state())
                    state = nxt
        return state

    a.start = a.state()
    a.end = sequence(a.start, ())
    return a


class Scanner:
    """Finds phrases (as templates without regions) and templates in the words of a text."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(compile_template(p), label) for p, label in phrases.items()]
        self.templates = [(compile_template(t), label) for label, t in templates.items()]
        self.starts: dict[bytes, list[tuple[Automaton, str, bool]]] = {}
        for known, base in ((self.phrases, True), (self.templates, False)):
            for a, label in known:
                for w in a.first_words():
                    self.starts.setdefault(w, []).append((a, label, base))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, bool]]]:
        """Number of words, and (first word, end, label, base) of every match."""
        w = words(text)
        found = []
        starts = self.starts
        for i in [i for i, x in enumerate(w) if x in starts]:
            for a, label, base in starts[w[i]]:
                if (end := a.match(w, i)) is not None:
                    found.append((i, end, label, base))
        return len(w), found


_scanner: list[Scanner] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row's whole text.

    n_base counts the places of all phrases; first_word and last_word are their smallest and largest start,
    null without any. score is 1 if a template matches, 0.5 if only phrases do, else 0. spans lists the
    matches as (first, end, label). Null and empty texts have no words. Repeated rows and rows without id are
    returned each. An empty table gives an empty result. One pass without a shuffle.
    """
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                n, found = _scanner[0].scan(t)
                base = [f[0] for f in found if f[3]]
                out.append((n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted({f[2] for f in found if f[3]})), ",".join(sorted({f[2] for f in found})),
                            1.0 if len(found) > len(base) else 0.5 if base else 0.0, [{"first": i, "end": e, "label": s} for i, e, s, _ in found]))
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                                "spans array<struct<first:long,end:long,label:string>>")
