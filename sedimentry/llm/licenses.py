"""License scans with a generalised suffix automaton of license tokens.

All templates and base phrases are put into one automaton over word ids. A file is streamed through it once: after each
word the automaton's state and length are the matching statistic, the longest run ending here that occurs in any
template. Base phrases are read off the state, because a phrase that ends here is a suffix of the matching statistic.
Right-maximal matches of ``least`` words or more are chained per template (in order in both, gaps of ``gap`` words at
most); a chain that covers ``cover`` of its template gives a span and the template's label.

Edge cases: null or empty text has no words, no labels and score 0; very long texts are streamed whole; repeated rows are
scanned alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage

#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Excerpts of public license texts and of the notices by which works refer to them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
LEAST, GAP, COVER = 4, 20, 0.6

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_of(text: str) -> list[bytes]:
    """A-Z lowered; words are runs of ASCII letters, digits and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the templates and phrases of each state."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, words_of(text)) for label, text in templates]
        self.phrases = [(label, words_of(text)) for text, label in phrases]
        texts = [w for _, w in self.templates] + [w for _, w in self.phrases]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(x for t in texts for x in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for t, text in enumerate(texts):
            last = 0
            for i, w in enumerate(text):
                last = self._extend(last, self.ids[w])
                ends.append((last, t, i + 1))
        n, whole = len(self.templates), len(self.next)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(whole)]  # template -> all end positions of the state's words
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(whole)]  # phrases that end here: (length, phrase)
        for state, t, end in ends:
            while state > 0:
                if t < n:
                    self.at[state].setdefault(t, []).append(end)
                state = self.link[state]
        for p, (_, text) in enumerate(self.phrases):
            state = 0
            for w in text:
                state = self.next[state][self.ids[w]]
            for s in range(1, whole):
                up = s
                while up > 0 and up != state:
                    up = self.link[up]
                if up == state:
                    self.found[s].append((len(text), p))

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the words of p followed by c, cloned out of a longer one where needed."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def stream(self, words: list[bytes], least: int):
        """(phrase hits as (phrase, start), right-maximal matches as (end, length, state))."""
        nxt, link, length, found = self.next, self.link, self.length, self.found
        hits, matches = [], []
        state = run = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                if run >= least:
                    matches.append((i, run, state))
                state = run = 0
                continue
            before, was = state, run
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = run = 0
            else:
                state, run = to, run + 1
            if was >= least and run <= was:
                matches.append((i, was, before))
            if run >= 3 and found[state]:
                hits.extend((p, i + 1 - n) for n, p in found[state] if n <= run)
        if run >= least:
            matches.append((len(words), run, state))
        return hits, matches


@lru_cache(maxsize=4)
def automaton(templates=TEMPLATES, phrases=PHRASES) -> Automaton:
    return Automaton(templates, phrases)


def chain(matches, auto: Automaton, gap: int = GAP) -> list[tuple[float, int, int, int]]:
    """Chains per template: (coverage, template, first word, word after the last)."""
    per: dict[int, list[tuple[int, int, int, int]]] = {}
    for end, n, state in matches:
        for t, ends in auto.at[state].items():
            per.setdefault(t, []).extend((end - n, end, at - n, at) for at in ends)
    chains = []
    for t, spans in per.items():
        size = len(auto.templates[t][1])
        open_: list[list[int]] = []  # text start, text end, template end, words covered
        for a, z, b, y in sorted(spans):
            open_, done = [c for c in open_ if a - c[1] <= gap], [c for c in open_ if a - c[1] > gap]
            chains.extend((c[3] / size, t, c[0], c[1]) for c in done)
            before = max((c for c in open_ if b >= c[2] and a >= c[1]), key=lambda c: c[3], default=None)
            open_.append([before[0], z, y, before[3] + z - a] if before else [a, z, y, z - a])
        chains.extend((c[3] / size, t, c[0], c[1]) for c in open_)
    return _apart(chains)


def _apart(chains: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of the chains of one template that overlap, the one that covers most."""
    kept: dict[int, list[tuple[float, int, int, int]]] = {}
    for c in sorted(chains, key=lambda c: (-c[0], c[2], c[3])):
        own = kept.setdefault(c[1], [])
        if all(c[3] <= x[2] or x[3] <= c[2] for x in own):
            own.append(c)
    return sorted((c for own in kept.values() for c in own), key=lambda c: (c[1], c[2]))


def scan(text: str, auto: Automaton | None = None, least: int = LEAST, gap: int = GAP, cover: float = COVER) -> dict:
    """Words, base hits and template spans of one text."""
    auto = auto or automaton()
    words = words_of(text)
    hits, matches = auto.stream(words, least)
    chains = chain(matches, auto, gap) if matches else []
    spans = [(auto.templates[t][0], a, z, score) for score, t, a, z in chains if score >= cover]
    base = sorted({auto.phrases[p][0] for p, _ in hits})
    return {
        "n_words": len(words),
        "n_base": len(hits),
        "first_word": min((s for _, s in hits), default=None),
        "last_word": max((s for _, s in hits), default=None),
        "base_labels": ",".join(base),
        "labels": ",".join(sorted({*base, *(s[0] for s in spans)})),
        "score": 1.0 if hits else min(1.0, max((c[0] for c in chains), default=0.0)),
        "spans": spans,
    }


FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "spans array<struct<label: string, first_word: long, end_word: long, coverage: double>>"
_SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row per document: word counts, base hits, labels, score and the covered template spans."""

    def run(batches):
        auto = automaton()
        for batch in batches:
            got = [scan(x, auto, least, gap, cover) for x in storage.texts_of(batch, 1)]
            cols = [pa.array([g[c] for g in got], kind) for c, kind in (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))]
            spans = pa.array([[dict(zip(("label", "first_word", "end_word", "coverage"), s)) for s in g["spans"]] for g in got], _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, spans], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return storage.map_batches(storage.text_column(docs, key, text), run, f"{FIELDS}, {SPANS}")


#: The base columns; labels and score of the method can't be expressed in SQL.
_STARTS = "list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + {n}) = [{words}])"
_PLACES = [(label, _STARTS.format(n=len(p.split()), words=", ".join(f"'{x}'" for x in p.split()))) for p, label in PHRASES]
BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
BASE_ORACLE = rf"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), found as (
  select doc_id, len(w)::bigint as n_words, {", ".join(f"{places} as p{k}" for k, (_, places) in enumerate(_PLACES))} from lowered
), joined as (
  select *, {" || ".join(f"p{k}" for k in range(len(_PLACES)))} as places from found
)
select doc_id, n_words, len(places)::bigint as n_base, coalesce(list_min(places), -1)::bigint as first_word, coalesce(list_max(places), -1)::bigint as last_word,
  array_to_string(list_sort([x for x in [{", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, (label, _) in enumerate(_PLACES))}] if x is not null]), ',') as base_labels
from joined
"""
