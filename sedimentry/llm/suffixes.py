"""Suffix-array dedup over bytes by a common-prefix-aware distributed merge sort.

Every group of documents sorts its anchored suffixes (see ``repeats``) and sends them as front-coded runs: each suffix
without the bytes that it shares with the one before. The runs of one bucket are merged by a loser tree whose entries
know how many bytes they share with the last winner. An entry that shares more is smaller without a look at any byte;
only at a tie are bytes compared, from that length on. The merge so yields the suffix array and its common prefixes.

A byte is removed where a 200-byte string covers it that also starts anywhere else, in the same document too; strings
never cross documents and are judged on the input.

Edge cases: null or empty text has no bytes and keeps the empty string; texts under 200 bytes are kept; repeated rows
remove each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import repeats

LENGTH, PREFIX = 200, 40
PLAN = repeats.Plan(repeats.Bytes, LENGTH, PREFIX, earlier_only=False)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class LoserTree:
    """Merges sorted runs of byte strings. runs: (strings, bytes that each shares with the one before)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        size = 1
        while size < max(1, len(runs)):
            size *= 2
        self.size = size
        self.at = [0] * size
        self.now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
        self.known = [0] * size  # bytes shared with the last winner
        self.lost = [-1] * size
        winners = list(range(size))
        node = size
        while len(winners) > 1:
            node //= 2
            ahead = []
            for k in range(0, len(winners), 2):
                win, lose = self._play(winners[k], winners[k + 1])
                self.lost[node + k // 2] = lose
                ahead.append(win)
            winners = ahead
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.now[a], self.now[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        known = self.known
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        done = known[a]
        x, y = (x[done:], y[done:]) if done else (x, y)
        both = done + repeats.common_prefix(x, y)
        if x <= y:
            known[b] = both
            return a, b
        known[a] = both
        return b, a

    def __iter__(self):
        """(run, index, bytes shared with the last one)."""
        while self.now[self.winner] is not None:
            w = self.winner
            strings, shared = self.runs[w]
            i = self.at[w]
            yield w, i, self.known[w]
            i += 1
            self.at[w] = i
            if i < len(strings):
                self.now[w], self.known[w] = strings[i], shared[i]
            else:
                self.now[w] = None
            node = (w + self.size) // 2
            while node:
                w, self.lost[node] = self._play(w, self.lost[node])
                node //= 2
            self.winner = w


def merge_runs(runs, kind):
    """Suffix array of a bucket: heads and left parts in order, and the common prefixes."""
    tree = LoserTree([(r[1], r[0]["common"].tolist()) for r in runs])
    starts = np.cumsum([0, *(len(r[1]) for r in runs)])
    order, common = [], []
    for run, i, shared in tree:
        order.append(int(starts[run]) + i)
        common.append(shared)
    head = np.concatenate([r[0] for r in runs])
    lefts = [x for r in runs for x in r[2]]
    common = np.array(common, np.int64)
    common[:1] = -1
    return head[order], [lefts[i] for i in order], common


def _kept(seq: repeats.Bytes, spans) -> bytes:
    at, parts = 0, []
    for a, z in spans:
        parts.append(seq.raw[at:a])
        at = z
    return b"".join([*parts, seq.raw[at:]])


def _digest(key, seq, spans):
    return key, seq.n, sum(z - a for a, z in spans), len(spans), hashlib.sha256(_kept(seq, spans)).hexdigest()


def _text(key, seq, spans):
    return key, seq.n, sum(z - a for a, z in spans), len(spans), _kept(seq, spans).decode("utf-8", "replace")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of what is kept."""
    return repeats.remove_repeats(docs, PLAN, merge_runs, _digest, SCHEMA, key, text)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: repeats.Plan = PLAN) -> DataFrame:
    """One row per document with the kept text; characters that a cut has split become U+FFFD."""
    return repeats.remove_repeats(docs, plan, merge_runs, _text, "doc_id long, n_bytes long, n_removed long, n_spans long, kept string", key, text)
