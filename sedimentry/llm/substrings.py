"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes are anchored (see ``repeats``) and partitioned by prefixes of two lengths: the anchor's ten words where these
split the suffixes finely enough, and the window's fifty words where more than ``hot`` suffixes share the ten. The
suffixes of one partition fit in memory; sorted, with the common prefixes of neighbours, they form the subtree: an
interval of neighbours that share d words is an internal node of depth d. Nodes of a window's depth with leaves in two
documents are repeats, extended to the left by the tree of left parts.

A word is removed where a window of 50 words covers it whose word sequence also starts in a document with a smaller
doc_id; all windows are judged on the input.

Edge cases: null or empty text has no words and keeps the empty string; a null doc_id counts as larger than any other and
never as smaller; repeated rows with one doc_id don't remove each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import repeats

WINDOW, PREFIX = 50, 10
PLAN = repeats.Plan(repeats.Words, WINDOW, PREFIX, earlier_only=True)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def subtree(runs, kind):
    """All suffixes of a partition in order, with the depth of the node that each shares with the one before."""
    head = np.concatenate([r[0] for r in runs])
    rights = [x for r in runs for x in r[1]]
    lefts = [x for r in runs for x in r[2]]
    order = sorted(range(len(rights)), key=rights.__getitem__)
    return head[order], [lefts[i] for i in order], repeats.neighbours([rights[i] for i in order], kind)


def kept_words(seq: repeats.Words, spans) -> tuple[list[bytes], int]:
    out, at = [], 0
    for a, z in spans:
        out.extend(seq.words[at:a])
        at = z
    out.extend(seq.words[at:])
    return out, seq.n - len(out)


def _digest(key, seq, spans):
    words, removed = kept_words(seq, spans)
    return key, seq.n, removed, hashlib.sha256(b" ".join(words)).hexdigest()


def _text(key, seq, spans):
    words, removed = kept_words(seq, spans)
    return key, seq.n, removed, b" ".join(words).decode("utf-8", "surrogatepass")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, removed words, digest of the kept words."""
    return repeats.remove_repeats(docs, PLAN, subtree, _digest, SCHEMA, key, text)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: repeats.Plan = PLAN) -> DataFrame:
    """One row per document with the kept text."""
    return repeats.remove_repeats(docs, plan, subtree, _text, "doc_id long, n_words long, n_removed long, kept string", key, text)
