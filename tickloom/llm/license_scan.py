"""Licence scans with a generalised suffix automaton.

The automaton accepts every run of words of every licence template.  A file's
words are streamed through it; the length of the longest run that ends at each
word, its matching statistics, shows where the file quotes a template.  Long
matches are chained in the order they have in a template into one span, and a
template is reported where its chain covers enough of it.

A vectorised test comes first and is exact: a match of m words needs m - 1
consecutive word pairs that occur in some template, so only runs of such pairs
are streamed.  Memory is that of the automaton (the templates' words) and one
batch.  There is no shuffle.

Base phrases are found apart from that, by comparing word hashes.  Null and
empty texts have no words, no labels and score 0.  Repeated rows give repeated
results.  Of chains of one template that overlap the one of most cover stays,
then the first.  Columns other than key and text are not read, whatever their
names, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern as K
from .common import map_texts, table

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Least words of a match, most words between two matches of a chain, least share of a template that must be covered.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.7
#: Notices as they are usually quoted; a label may have several.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions"""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met"""),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("warranty", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"""),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """Generalised suffix automaton of token sequences; each state knows where in which template its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for i, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].add((t, i + 1))
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            self.ends[self.link[v]] |= self.ends[v]

    def _new(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for the runs through p and token, apart from longer ones that q also holds."""
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._new(self.size[p] + 1)
        self.next[twin], self.link[twin], self.link[q] = dict(self.next[q]), self.link[q], twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new, p = self._new(self.size[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest run of some template that ends here), for each token."""
        out, v, n = [], 0, 0
        for t in tokens:
            while v and t not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if t in self.next[v]:
                v, n = self.next[v][t], n + 1
            out.append((v, n))
        return out


class Scanner:
    """Labels, chained spans and score of word sequences."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        self.lengths = [len(x) for x in texts]
        self.min_match, self.min_cover = min_match, min_cover
        c = next(K.chunks(pa.array([" ".join(x) for x in texts], pa.large_string()), 1 << 40))
        w = c.words(K.ALNUM, lower=True)
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        self.automaton = Automaton([ids[w.bounds[i] : w.bounds[i + 1]].tolist() for i in range(len(texts))])
        _, self.pairs = w.windows(2)
        self.pairs = np.unique(self.pairs)
        base = next(K.chunks(pa.array(list(BASE.values()), pa.large_string()), 1 << 40)).words(K.ALNUM, lower=True)
        self.base = [(label, base.hash[base.bounds[i] : base.bounds[i + 1]]) for i, label in enumerate(BASE)]

    def base_starts(self, w: K.Words) -> list[tuple[str, np.ndarray]]:
        out = []
        for label, h in self.base:
            m = len(w.hash) - len(h) + 1
            at = np.flatnonzero(w.hash[: max(m, 0)] == h[0])
            for j in range(1, len(h)):
                at = at[w.hash[at + j] == h[j]]
            out.append((label, at[w.doc[at] == w.doc[at + len(h) - 1]]))
        return out

    def runs(self, w: K.Words) -> list[tuple[int, int]]:
        """Spans of words in which every neighbouring pair occurs in a template, long enough for a match."""
        at, h = w.windows(2)
        good = at[self.pairs[np.minimum(np.searchsorted(self.pairs, h), len(self.pairs) - 1)] == h]
        if not len(good):
            return []
        cut = np.flatnonzero(np.diff(good) != 1) + 1
        first, last = good[np.concatenate([[0], cut])], good[np.concatenate([cut - 1, [len(good) - 1]])]
        # Two rows' runs never join: no pair spans the edge of two rows.
        return [(int(a), int(b) + 2) for a, b in zip(first, last, strict=True) if b - a + 2 >= self.min_match]

    def matches(self, w: K.Words, start: int, end: int) -> list[tuple[int, int, int]]:
        """(first word, end, state) of maximal matches inside a run."""
        tokens = np.searchsorted(self.vocabulary, w.hash[start:end]).tolist()
        stats = self.automaton.statistics(tokens)
        out = []
        for i, (v, n) in enumerate(stats):
            if n >= self.min_match and (i + 1 == len(stats) or stats[i + 1][1] != n + 1):
                out.append((start + i + 1 - n, start + i + 1, v))
        return out

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, cover) of chains of matches that keep a template's order and cover enough of it."""
        placed: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, z, v in found:
            for t, end in self.automaton.ends[v]:
                placed.setdefault(t, []).append((a, z, end - (z - a), end))
        out = []
        for t, own in placed.items():
            own.sort()
            every: list[list[int]] = []  # first word, end, end in the template, words covered
            live: list[list[int]] = []  # those that a later match can go on with
            for a, z, p, q in own:
                live = [c for c in live if a <= c[1] + MAX_GAP]
                best = max((c for c in live if c[1] <= a and c[2] <= p), key=lambda c: c[3], default=None)
                every.append([best[0], z, q, best[3] + z - a] if best else [a, z, q, z - a])
                live.append(every[-1])
            # Of chains that overlap the one of most cover stays, and of those the first.
            starts, ends = [], []
            for c in sorted((c for c in every if c[3] >= self.min_cover * self.lengths[t]), key=lambda c: (-c[3], c[0], c[1])):
                i = bisect_left(starts, c[0])
                if (i == 0 or ends[i - 1] <= c[0]) and (i == len(starts) or c[1] <= starts[i]):
                    starts.insert(i, c[0])
                    ends.insert(i, c[1])
                    out.append((t, c[0], c[1], min(1.0, c[3] / self.lengths[t])))
        # A notice inside a longer one of another label ("CC BY-NC 4.0" where "CC BY-NC-ND 4.0" stands) is that other one.
        kept, reach = [], {}
        for x in sorted(out, key=lambda x: (x[1], -x[2], x[0])):
            if not any(end >= x[2] and (start, end) != x[1:3] and label != self.labels[x[0]] for label, (start, end) in reach.items()):
                kept.append(x)
            if x[2] > reach.get(self.labels[x[0]], (0, -1))[1]:
                reach[self.labels[x[0]]] = x[1:3]
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


_SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())]))
_SPANS_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Key, n_words, base places, labels, template spans (in words) and score.

    The score is the best template's cover, or 0.5 where only base phrases stand.
    """
    long = T.LongType()
    fields = [T.StructField("n_words", long), T.StructField("n_base", long), T.StructField("first_word", long), T.StructField("last_word", long), T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS), T.StructField("score", T.DoubleType())]

    def make():
        scanner = Scanner(templates)

        def run(texts: pa.Array) -> list[pa.Array]:
            cols: list[list] = [[] for _ in fields]
            for c in K.chunks(texts):
                w = c.words(K.ALNUM, lower=True)
                starts: dict[int, list[int]] = {}
                base: dict[int, set[str]] = {}
                for label, at in scanner.base_starts(w):
                    for doc, i in zip(w.doc[at].tolist(), at.tolist(), strict=True):
                        starts.setdefault(doc, []).append(i)
                        base.setdefault(doc, set()).add(label)
                found: dict[int, list[tuple[int, int, int]]] = {}
                for a, z in scanner.runs(w):
                    for m in scanner.matches(w, a, z):
                        found.setdefault(int(w.doc[m[0]]), []).append(m)
                for r in range(c.n):
                    first = int(w.bounds[r])
                    own = starts.get(r, [])
                    chains = scanner.chains(found[r]) if r in found else []
                    spans = [{"label": scanner.labels[t], "start": a - first, "end": z - first, "cover": cover} for t, a, z, cover in chains]
                    labels = base.get(r, set())
                    score = max([x["cover"] for x in spans] + [0.5 if labels else 0.0])
                    row = (int(w.bounds[r + 1]) - first, len(own), min(own) - first if own else None, max(own) - first if own else None, sorted(labels), sorted(labels | {x["label"] for x in spans}), spans, score)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [_SPANS_ARROW, pa.float64()]
            return [pa.array(col, kind) for col, kind in zip(cols, kinds, strict=True)]

        return run

    return map_texts(docs, key, text, fields, make)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}
