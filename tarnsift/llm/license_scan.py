"""Licence scans by a generalised suffix automaton of licence notices.

The automaton holds every run of words of every template. A text is streamed through it word by
word, which gives its matching statistics: at each word the longest run ending there that some
template has, and through the automaton's state all places where templates have it. Runs that
can't be extended are anchors; anchors in the same order in text and template, no more than GAP
words apart, are chained, and a chain is a span of the text that covers so much of the template.
Phrases are templates too: their places are read off the states that end them.

Everything is one map stage over the scan. Templates are a parameter of fixed size and go with the
task; only word pairs that some template has are walked, as elsewhere no run is longer than one.

Defined cases: a null or empty text has no words, no places and the score zero; a very long text is
streamed in pieces, the statistics carried on; ties between chains go to the earlier one; repeated
rows, and rows that share a doc_id or have none, are scanned one by one; an empty table gives an
empty result; further columns are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsift.llm.common import slices, small_batches, trim

#: Words of a run that counts, words between chained runs, covered share of a template that labels.
RUN, GAP, SHARE = 3, 6, 0.6
#: Bytes of text cut into words at a time, and words scanned at a time.
PIECE, SPAN = 1_000_000, 500_000

# Phrases of the base labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as their licences print them, with SPDX-like labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights CC0 1.0 Universal public domain dedication"),
)

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: A-Z to lower case, all that no word has to blanks.
_CUT = bytes(b if b in _WORD else 0x20 for b in bytes(range(256)).lower())
_EDGE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def words(text: str | bytes) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_CUT).split()


def pieces(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``text``, about ``most`` bytes at a time."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + most) if len(text) - at > most else None
        end = edge.start() if edge else len(text)
        yield words(text[at:end])
        at = end


class Anchor(NamedTuple):
    """A run of ``length`` words at ``text`` (first word) that template ``of`` has at ``at``."""

    text: int
    length: int
    of: int
    at: int


class Span(NamedTuple):
    """A chain: words ``first`` to ``last`` of the text cover ``covered`` of template ``of``."""

    of: int
    first: int
    last: int
    covered: int


class Automaton:
    """Suffix automaton of several word sequences. ``marks`` tells, by state, which of the first
    ``phrases`` sequences end there, as (words, sequence)."""

    def __init__(self, sequences: Sequence[Sequence[bytes]], phrases: int = 0):
        self.sizes = [len(s) for s in sequences]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        marks: list[list[tuple[int, int]]] = [[]]
        pairs = set()
        for k, sequence in enumerate(sequences):
            coded = [self.ids.setdefault(w, len(self.ids)) for w in sequence]
            pairs.update(zip(coded, coded[1:]))
            state = 0
            for at, w in enumerate(coded):
                state = self._extend(state, w)
                while len(ends) < len(self.next):
                    ends.append([])
                    marks.append([])
                ends[state].append((k, at))
            if k < phrases and coded:
                marks[state].append((len(coded), k))
        # What ends at a state ends at its suffix links too; marks go the other way.
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            ends[self.link[s]].extend(ends[s])
        for s in order:
            marks[s].extend(marks[self.link[s]])
        self.ends, self.marks = ends, marks
        self.pairs = np.zeros((len(self.ids), len(self.ids)), bool)
        for a, b in pairs:
            self.pairs[a, b] = True

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the strings of ``q`` that are no longer than those of ``p`` and ``w``."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # a sequence before has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def code(self, text: bytes | None) -> Iterator[np.ndarray]:
        """Ids of the words of a text, -1 where no sequence has the word."""
        get = self.ids.get
        for part in pieces(text or b""):
            yield np.fromiter(map(get, part, repeat(-1)), np.int32, len(part))

    def walk(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(word, length, state) wherever the longest run ending there has two words or more."""
        a, b = ids[:-1], ids[1:]
        there = np.flatnonzero((a >= 0) & (b >= 0))
        there = there[self.pairs[a[there], b[there]]]
        before = -2
        state = length = 0
        nxt, link, longest = self.next, self.link, self.length
        for k, w0, w in zip(there.tolist(), a[there].tolist(), b[there].tolist(), strict=True):
            if k != before + 1:
                state, length = nxt[0][w0], 1
            while w not in nxt[state]:
                state = link[state]
                length = longest[state]
            state, length, before = nxt[state][w], length + 1, k
            if length > 1:
                yield k + 1, length, state


def statistics(found: Iterable[tuple[int, int, int]], auto: Automaton, run: int) -> tuple[list[tuple[int, int]], list[Anchor]]:
    """Places (phrase, first word) and anchors of ``run`` words or more, from a text's walk."""
    places: list[tuple[int, int]] = []
    anchors: list[Anchor] = []

    def close(at: int, length: int, state: int) -> None:
        if length >= run:
            anchors.extend(Anchor(at - length + 1, length, k, e - length + 1) for k, e in auto.ends[state])

    last = None
    for at, length, state in found:
        places.extend((k, at - m + 1) for m, k in auto.marks[state] if m <= length)
        if last and (at, length) != (last[0] + 1, last[1] + 1):
            close(*last)
        last = (at, length, state)
    if last:
        close(*last)
    return places, anchors


def chains(anchors: Iterable[Anchor], gap: int = GAP) -> list[Span]:
    """Chains of anchors of one template, none inside a better one's words; the best first.

    An anchor goes on from the chain that covers most of those that end before it, or overlap it
    in part, no more than ``gap`` words away in text and template; what overlaps counts once.
    """
    live: list[list[int]] = []  # end in text, end in template, first word, covered, extended
    done: list[list[int]] = []
    for x in sorted(anchors, key=lambda x: (x.text + x.length, x.text, x.at)):
        keep = []
        for c in live:
            (keep if c[0] >= x.text - gap - 1 else done).append(c)
        live = keep
        best, first, from_ = x.length, x.text, None
        for c in live:
            t, m = x.text - c[0], x.at - c[1]  # 1 where next to each other
            lost = max(0, 1 - t, 1 - m)
            if m <= gap + 1 and lost < x.length and c[3] + x.length - lost > best:
                best, first, from_ = c[3] + x.length - lost, c[2], c
        if from_:
            from_[4] = 1
        live.append([x.text + x.length - 1, x.at + x.length - 1, first, best, 0])
    spans, taken = [], []
    for end, _, first, covered, extended in sorted(done + live, key=lambda c: (-c[3], c[2], c[0])):
        k = bisect(taken, (first, end))
        free = (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > end)
        if free and not extended:
            taken.insert(k, (first, end))
            spans.append((first, end, covered))
    return [Span(-1, *s) for s in spans]


class Scanner:
    """Phrases and notices in one automaton; ``names`` and ``labels`` by sequence."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, run: int = RUN, gap: int = GAP, share: float = SHARE):
        rows = [(label, text) for text, label in phrases] + list(notices)
        self.auto = Automaton([words(text) for _, text in rows], len(phrases))
        self.labels = [label for label, _ in rows]
        self.names = [f"{label}:{k}" for k, (label, _) in enumerate(rows)]
        self.phrases, self.run, self.gap, self.share = len(phrases), run, gap, share

    def judge(self, found: Iterable[tuple[int, int, int]]) -> tuple[list[dict], list[dict], float]:
        """Places, spans and score of a text's walk."""
        places, anchors = statistics(found, self.auto, self.run)
        by: dict[int, list[Anchor]] = {}
        for x in anchors:
            if x.of >= self.phrases:
                by.setdefault(x.of, []).append(x)
        score, spans = 1.0 if places else 0.0, []
        for k in sorted(by):
            for s in chains(by[k], self.gap):
                share = min(1.0, s.covered / self.auto.sizes[k])
                score = max(score, share)
                if share >= self.share:
                    spans.append({"template": self.names[k], "label": self.labels[k], "first": s.first, "last": s.last, "share": share})
        return [{"label": self.labels[k], "word": at} for k, at in sorted(places, key=lambda p: (p[1], p[0]))], spans, score

    def scan(self, texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[dict], list[dict], float]]:
        """n_words, places, spans and score of each text, as they are streamed through."""
        held: list[np.ndarray] = []
        sizes: list[int] = []
        nothing = np.array([-1], np.int32)

        def flush() -> Iterator[tuple[int, list[dict], list[dict], float]]:
            if not sizes:
                return
            starts = np.cumsum([0, *[n + 1 for n in sizes]]).tolist()
            walked: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
            for at, length, state in self.auto.walk(np.concatenate(held)):
                k = bisect(starts, at) - 1
                walked[k].append((at - starts[k], length, state))
            for n, found in zip(sizes, walked, strict=True):
                yield (n, *(self.judge(found) if found else ([], [], 0.0)))
            held.clear()
            sizes.clear()

        for text in texts:
            n = 0
            for part in self.auto.code(text):
                held.append(part)
                n += len(part)
            held.append(nothing)  # no run goes on into the next text
            sizes.append(n)
            if sum(sizes) >= SPAN:
                yield from flush()
        yield from flush()


@lru_cache(maxsize=4)
def scanner(phrases=PHRASES, notices=NOTICES, run: int = RUN, gap: int = GAP, share: float = SHARE) -> Scanner:
    """One automaton per worker process."""
    return Scanner(phrases, notices, run, gap, share)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, run: int = RUN, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, places (label, word) of phrases, spans (template, label, first, last,
    share) of notices covered by ``share`` or more, and score: the largest share of a template
    that a chain covers, 1 where a phrase stands."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = scanner(phrases, notices, run, gap, share)
        for batch in slices(batches):
            text = batch.column("text").cast(pa.large_binary())
            rows = list(made.scan(x.as_py() for x in text))
            cols = [[r[k] for r in rows] for k in range(4)]
            kinds = (pa.int64(), place, span, pa.float64())
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "places", "spans", "score"])
        trim()

    schema = (
        f"doc_id {kind}, n_words long, places array<struct<label:string,word:long>>, "
        "spans array<struct<template:string,label:string,first:long,last:long,share:double>>, score double"
    )
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run_, schema)


def op11(docs: DataFrame) -> DataFrame:
    base, own = F.col("places.label"), F.col("spans.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), "score",
    )
