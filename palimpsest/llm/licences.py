"""License scans by matching statistics against a generalised suffix automaton of licence tokens.

All templates, token by token, form one automaton. A text's tokens stream through it; at each token the
automaton holds the longest run that ends there and occurs in some template (the matching statistic). Runs
that can't grow and are long enough are laid on their templates, in every place that they have there, and the
best chains of runs that follow each other in text and template with small gaps are found by dynamic
programming; a chain that covers enough of its template gives the label and span. Phrases are templates that
only count where they stand whole.

A token is a run of ASCII letters, digits and other than ASCII characters, A-Z lower-cased. A null text
has no tokens. Texts are read whole; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Openings and notices of public licences.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """States of all substrings of all templates. `where` gives (template, end) of each place where a state's strings
    stand, for states that have strings of at least `least` tokens; `one` gives one place for every state."""

    def __init__(self, rows: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        places: list[tuple[int, int, int]] = []
        for t, row in enumerate(rows):
            last = 0
            for at, token in enumerate(row):
                last = self._extend(last, token)
                places.append((last, t, at + 1))
        self.one: list[tuple[int, int]] = [(0, 0)] * len(self.size)
        self.where: list[set[tuple[int, int]]] = [set() for _ in self.size]
        for s, t, end in places:
            self.where[s].add((t, end))
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.where[s]:
                self.one[s] = min(self.where[s])
            if self.size[self.link[s]] >= least:
                self.where[self.link[s]] |= self.where[s]
            else:
                self.where[self.link[s]].add(self.one[s])

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves), self.size.append(size), self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, token: int) -> int:
        """The state that p reaches by token, cut so that its longest string is p's plus the token."""
        q = self.next[p][token]
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token)
        return new

    def stream(self, row: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match that ends here) for each token."""
        s = n = 0
        for token in row:
            while s and token not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            s, n = (self.next[s][token], n + 1) if token in self.next[s] else (0, 0)
            yield s, n


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, seed: int = 4, gap: int = 8, cover: float = 0.6):
        self.seed, self.gap, self.cover = seed, gap, cover
        self.labels = [label for label, _ in templates]
        texts = [tokens(x.encode()) for _, x in templates] + [tokens(x.encode()) for x, _ in phrases]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in texts for w in x))}
        rows = [[vocabulary[w] for w in x] for x in texts]
        self.vocabulary, self.sizes = vocabulary, [len(x) for x in rows]
        self.automaton = SuffixAutomaton(rows, seed)
        #: no shorter run of known words holds a phrase or a seed
        self.least = min([seed, *(len(x) for x in rows[len(templates) :])])
        whole = {tuple(rows[len(templates) + i]): phrases[i][1] for i in range(len(phrases))}
        #: by state, the phrases (length, label) that its longest string ends with
        self.ends: list[list[tuple[int, str]]] = [[] for _ in self.automaton.size]
        for s in range(1, len(self.ends)):
            t, at = self.automaton.one[s]
            longest = tuple(rows[t][at - self.automaton.size[s] : at])
            self.ends[s] = [(len(p), label) for p, label in whole.items() if longest[-len(p) :] == p]

    def scan(self, text: bytes | None) -> dict:
        words = tokens(text or b"")
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        places: list[tuple[int, str]] = []
        runs: dict[int, list[tuple[int, int, int]]] = {}
        ends, where = self.ends, self.automaton.where
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
            if stop - start < self.least:
                continue
            prior = (0, 0)
            for at, (s, n) in enumerate([*self.automaton.stream(ids[start:stop].tolist()), (0, 0)], start):
                for size, label in ends[s]:
                    if n >= size:
                        places.append((at + 1 - size, label))
                if prior[1] >= self.seed and n <= prior[1]:
                    for t, end in where[prior[0]]:
                        if t < len(self.labels):
                            runs.setdefault(t, []).append((at - prior[1], at, end))
                prior = (s, n)
        spans = [x for t, found in runs.items() for x in self._chain(t, found)]
        first = [p for p, _ in places]
        base = sorted({label for _, label in places})
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(first, default=None), "last_word": max(first, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(x[2] for x in spans)})),
            "score": 1.0 if places else max((x[3] for x in spans), default=0.0), "spans": ",".join(f"{label}:{a}:{b}" for a, b, label, _ in sorted(spans)),
        }

    def _chain(self, t: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """The best chains of runs (start, stop, end in template t), each run in one of them, that cover enough of t.

        A run follows another if it begins later in text and template and leaves gaps of up to `gap` on both
        sides; what the two share counts once."""
        found = sorted(found)
        longest = max(stop - start for start, stop, _ in found)
        total, back, first = [], [], 0
        for i, (start, stop, end) in enumerate(found):
            best, prior = stop - start, -1
            while found[first][0] + longest + self.gap < start:
                first += 1
            for j in range(first, i):
                _, stop_j, end_j = found[j]
                here = end - (stop - start)
                shared = max(0, stop_j - start, end_j - here)
                if shared < stop - start and start + shared - stop_j <= self.gap and here + shared - end_j <= self.gap and found[j][0] < start and end_j < end:
                    if total[j] + stop - start - shared > best:
                        best, prior = total[j] + stop - start - shared, j
            total.append(best)
            back.append(prior)
        out, used = [], set()
        for i in sorted(range(len(found)), key=lambda i: (-total[i], i)):
            if total[i] < max(self.seed, self.cover * self.sizes[t]):
                break
            run = [i]
            while back[run[-1]] >= 0 and not used & {run[-1]}:
                run.append(back[run[-1]])
            if not used & {*run}:
                out.append((found[run[-1]][0], found[i][1], self.labels[t], min(1.0, total[i] / self.sizes[t])))
            used |= {*run}
        return out


def scan_documents(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    scanner = Scanner(templates, phrases)
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scanner.scan(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [b.column(0).cast(pa.int64())] + [pa.array([r[n] for r in rows], pa.float64() if n == "score" else pa.string() if "label" in n or n == "spans" else pa.int64()) for n in names[1:]]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
