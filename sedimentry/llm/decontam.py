"""Benchmark decontamination by template canonicalisation.

Words are lowered and stripped of punctuation; numbers, units and names (capitalised words inside a sentence) become
typed placeholders, so a question asked again with other numbers or names keeps its template. Windows of eight template
words are hashed and joined between documents and benchmark items; windows with fewer than four literal words don't
count. A candidate pair is then laid out along its best alignment, matched windows chained in order over neighbouring
offsets, so that words put in, left out or replaced by more words don't break it: the item is found if the chain covers
60 % of it and its slots are consistent, i.e. at least 80 % of the placeholders follow one mapping, the same in both
directions, from the item's values to the document's. ``exact`` means that all values are equal, ``reparameterised`` that
some differ.

Verbatim copies are found besides, whatever their length, case or share of placeholders: texts are also read as plain,
case-folded words, numbers and signs of arithmetic (other punctuation is left out), and an item that stands in a document
as a whole, word by word, is ``exact`` with coverage 1. One run of at most eight of its words, the one with the smallest
hash, is looked up; the whole item is then compared.

The windows of the benchmark are counted first. Up to ``BROADCAST_WINDOWS`` (16 MB) they are sent to every task and
documents are matched where they are read; beyond that, windows of both sides are joined by a shuffle, under digests of the texts: the verdict on a
document depends on its text alone, so rows with null or repeated ids are joined like others.

Edge cases: null or empty texts and items, and items without letters and digits, match nothing; items of fewer than eight template words are found only verbatim,
however short they are; repeated documents are reported each, repeated items by their own ids; rows with a null doc_id
are matched like others; empty tables give empty results; other columns are ignored (``clean`` passes them through).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .repeats import mixed

WINDOW, LITERALS, COVER, CONSISTENT = 8, 4, 0.6, 0.8
BROADCAST_WINDOWS = 1 << 20

#: Words that stand for numbers, and units of measure.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees mph kmh watt watts volt volts joule joules".split())

_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_GLUED = re.compile(r"(\d)([A-Za-z]+)\b")
_EDGE = re.compile(r"^[^\w+-]+|[^\w]+$")
_STOPS = (".", "!", "?", ":")
_PLAIN = re.compile(r"\d+(?:[.,:/]\d+)*|\w+|[+\-*/=<>^%×÷]")
_SIGNS = frozenset("+-*/=<>^%×÷")
_JOINED = re.compile(r"\d[A-Za-z]")
_KIND_CODES = {"number": 11, "unit": 12, "name": 13}
_CAPITAL, _ENDS, _FULL, _COUNT = 1, 2, 4, 3
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_MULTIPLIER, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def _digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


class _Numbers(dict):
    """Numbers of words; a word that is met for the first time is handed to ``add``."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: str) -> int:
        got = self[word] = self.add(word)
        return got


class Canon:
    """Template words and plain words of texts. Each distinct word is analysed once; the cache is bounded."""

    def __init__(self, cached: int = 300_000):
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.known, self.kind, self.low, self.new = _Numbers(self._analyse), [], [], ([], [], [])
        self.code, self.facts, self.plain_at, self.plain = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.counts = [0, 0]  # words and plain words in the tables

    def _analyse(self, word: str) -> int:
        """The number of a new word, under which it is described."""
        k, bare = len(self.kind), word if word.isalpha() else _EDGE.sub("", word)
        low, letters = bare.lower(), bare.isalpha()
        kind = "number" if low in NUMBERS or not letters and _NUMBER.fullmatch(bare) else "unit" if low in UNITS else ""
        code = _digest(low.encode("utf-8", "surrogatepass"))
        if letters and low.isascii() and (bare is word or _SIGNS.isdisjoint(word)):
            plain = [code]
        else:
            plain = [_digest(x.encode("utf-8", "surrogatepass")) for x in _PLAIN.findall(word.casefold())]
        self.kind.append(kind)
        self.low.append(low)
        codes, facts, plains = self.new
        codes.append(_KIND_CODES[kind] if kind else code | 16)
        facts.append(_CAPITAL * (not kind and bare[:1].isupper()) | _ENDS * word.endswith(_STOPS) | _FULL * bool(low) | len(plain) << _COUNT)
        plains.extend(plain)
        return k

    def _settle(self) -> None:
        """Bring new words into the tables."""
        codes, facts, plains = (np.array(x, kind) for x, kind in zip(self.new, (np.uint64, np.int64, np.uint64), strict=True))
        n, used = self.counts
        behind = used + np.cumsum(facts >> _COUNT)
        for name, at, fresh in (("code", n, codes), ("facts", n, facts), ("plain_at", n, behind - (facts >> _COUNT)), ("plain", used, plains)):
            table = getattr(self, name)
            if at + len(fresh) > len(table):
                table = np.concatenate([table, np.zeros(len(table) + len(fresh) + 1024, table.dtype)])
                setattr(self, name, table)
            table[at : at + len(fresh)] = fresh
        self.counts, self.new = [n + len(codes), used + len(plains)], ([], [], [])

    def read(self, text: str) -> Reading:
        if len(self.kind) >= self.cached:
            self._forget()
        if _JOINED.search(text):
            text = _GLUED.sub(r"\1 \2", text)
        parts = text.split()
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        if self.new[0]:
            self._settle()
        return Reading(self, at)


class Reading:
    """A text's words by their numbers; to be used before the next text is read."""

    def __init__(self, canon: Canon, at: np.ndarray):
        self.canon, self.all, self.facts = canon, at, canon.facts[at]
        self.full, self.name = self.facts & _FULL != 0, self.facts & _CAPITAL != 0
        self.name[:1] = False
        self.name[1:] &= self.facts[:-1] & _ENDS == 0

    def codes(self) -> np.ndarray:
        """Hashes of the template words."""
        return np.where(self.name, np.uint64(_KIND_CODES["name"]), self.canon.code[self.all])[self.full]

    def words(self) -> list[tuple[int, str, str]]:
        """(hash, kind, value) of every template word."""
        kind, low = self.canon.kind, self.canon.low
        names = self.name[self.full].tolist()
        return [(c, "name" if name else kind[k], low[k]) for c, k, name in zip(self.codes().tolist(), self.all[self.full].tolist(), names, strict=True)]

    def plain(self) -> np.ndarray:
        """Hashes of the plain words."""
        n = self.facts >> _COUNT
        behind = np.cumsum(n)
        return self.canon.plain[np.repeat(self.canon.plain_at[self.all] - behind + n, n) + np.arange(behind[-1] if len(n) else 0)]

    def word_of(self, k: int) -> int:
        """The template word in or behind which the k-th plain word is."""
        at = int(np.searchsorted(np.cumsum(self.facts >> _COUNT), k, "right"))
        return int(self.full[:at].sum())


def _sums(token: np.ndarray, n: int) -> np.ndarray:
    """Every run of n tokens as a polynomial of its tokens."""
    if n == 1 or len(token) < n:
        return token[: len(token) - n + 1] if n == 1 else token[:0]
    if n % 2:
        return token[: 1 - n] + _sums(token, n - 1)[1:] * _POWERS[1]
    half = _sums(token, n // 2)
    return half[: len(half) - n // 2] + half[n // 2 :] * _POWERS[n // 2]


def _found(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which h are among the sorted hashes, and where their equals begin and end."""
    if not len(hashes):
        return (np.zeros(0, np.int64),) * 3
    lo = np.searchsorted(hashes, h)
    some = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
    return some, lo[some], np.searchsorted(hashes, h[some], "right")


def window_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the windows with enough literal words."""
    n = len(codes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = _sums(mixed(codes), WINDOW)
    literal = np.cumsum(np.r_[0, codes > 15])
    good = np.flatnonzero(literal[WINDOW:] - literal[:-WINDOW] >= LITERALS)
    return mixed(total)[good], good


def plain_hashes(plain: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n plain words, n up to WINDOW; other than those of template windows and of other lengths."""
    return mixed(~(_sums(mixed(plain), n) + np.uint64(n)))


def anchor(plain: np.ndarray) -> tuple[int, int, int]:
    """(length, hash, position) of the run of plain words by which an item is looked up."""
    n = min(WINDOW, len(plain))
    h = plain_hashes(plain, n)
    k = int(h.argmin())
    return n, int(h[k]), k


def pieces_of(spots: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, first item word, item word behind the last, offset) of every unbroken stretch of matched windows."""
    by: dict[int, list[int]] = {}
    for d, i in spots:
        by.setdefault(d - i, []).append(i)
    out = []
    for shift, at in by.items():
        at.sort()
        first, behind = at[0], at[0] + WINDOW
        for i in at[1:]:
            if i > behind:
                out.append((first + shift, first, behind, shift))
                first = i
            behind = i + WINDOW
        out.append((first + shift, first, behind, shift))
    return sorted(out)


def alignments(pieces: list[tuple[int, int, int, int]], n: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(words covered, first word, parts) of alignments of an item of n words, those that cover most first.

    For every piece the best chain that ends with it, where each piece stands behind the one before in item and document and
    its offset differs by no more than the part of an item that needn't be covered; and all pieces of one offset. A part is
    (first item word, item word behind the last, offset).
    """
    slack = max(WINDOW, int(n * (1 - COVER)))
    best: list[tuple[int, int, int]] = []  # (words covered, first item word of its own, piece before)
    for k, (d, i, z, shift) in enumerate(pieces):
        cover, own, before, turn = z - i, i, -1, 0
        for j in range(k - 1, -1, -1):
            dj, _, zj, sj = pieces[j]
            if d - dj > n + slack:
                break
            begin = max(i, zj, zj + sj - shift)
            if abs(shift - sj) > slack or begin >= z:
                continue
            got = best[j][0] + z - begin
            if got > cover or got == cover and before >= 0 and abs(shift - sj) < turn:
                cover, own, before, turn = got, begin, j, abs(shift - sj)
        best.append((cover, own, before))
    out, straight = [], {}
    for k, (cover, _, _) in enumerate(best):
        straight.setdefault(pieces[k][3], []).append((pieces[k][1], pieces[k][2], pieces[k][3]))
        if cover >= COVER * n:
            parts, at = [], k
            while at >= 0:
                parts.append((best[at][1], pieces[at][2], pieces[at][3]))
                at = best[at][2]
            out.append((cover, parts[-1][0] + parts[-1][2], parts[::-1]))
    for parts in straight.values():
        if (cover := sum(z - i for i, z, _ in parts)) >= COVER * n:
            out.append((cover, parts[0][0] + parts[0][2], parts))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _slot(words: list[tuple], at: int, behind: int, ahead: int) -> str:
    """The value of the slot at a word, with the words of its kind around it that lie between the next aligned words."""
    first, end = at, at + 1
    while first > behind + 1 and words[first - 1][1] == words[at][1]:
        first -= 1
    while end < ahead and words[end][1] == words[at][1]:
        end += 1
    return " ".join(w[2] for w in words[first:end])


def _slots(item: list[tuple], words: list[tuple], pairs: list[tuple[int, int]], inner: bool, outer: bool) -> tuple[int, list[tuple]]:
    """How many slots agree, and all of them. Values of several words are joined between aligned words, or at the ends too."""
    slots = []
    for k, (i, d) in enumerate(pairs):
        if kind := item[i][1]:
            i0, d0 = pairs[k - 1] if k and inner else (-1, -1) if outer and i and not k else (i - 1, d - 1)
            i1, d1 = pairs[k + 1] if inner and k + 1 < len(pairs) else (len(item), len(words)) if outer and i + 1 < len(item) and k + 1 == len(pairs) else (i + 1, d + 1)
            slots.append((kind, _slot(item, i, i0, i1), _slot(words, d, d0, d1)))
    ahead, back = Counter(slots), Counter((kind, b, a) for kind, a, b in slots)
    top, pot = {}, {}
    for (kind, a, b), _ in sorted(ahead.items(), key=lambda x: (-x[1], x[0])):
        top.setdefault((kind, a), b)
    for (kind, b, a), _ in sorted(back.items(), key=lambda x: (-x[1], x[0])):
        pot.setdefault((kind, b), a)
    return sum(top[kind, a] == b and pot[kind, b] == a for kind, a, b in slots), slots


def compare(item: list[tuple], words: list[tuple], spots: list[tuple[int, int]]) -> dict | None:
    """The alignment of an item in a document that covers most of it, of those that pass. spots: (word, item word)."""
    for cover, first, parts in alignments(pieces_of(spots), len(item)):
        pairs = [(i, i + shift) for a, z, shift in parts for i in range(a, z)]
        agree, slots = max((_slots(item, words, pairs, *way) for way in ((True, False), (True, True), (False, False))), key=lambda x: x[0])
        if agree >= CONSISTENT * len(slots):
            same = all(a == b for _, a, b in slots)
            return {"coverage": cover / len(item), "n_slots": len(slots), "n_consistent": agree, "kind": "exact" if same else "reparameterised", "first_word": first}
    return None


class Index:
    """Items, their windows and anchors, for matching where documents are read."""

    def __init__(self, items: list[tuple[int, str]]):
        canon = Canon()
        self.items, self.plain, parts, anchors = [], [], [], {}
        for k, (key, text) in enumerate(items):
            reading = canon.read(text)
            self.items.append((key, reading.words()))
            self.plain.append(plain := reading.plain())
            parts.append(window_hashes(reading.codes()))
            if reading.full.any():
                n, h, i = anchor(plain)
                anchors.setdefault(n, []).append((h, i, k))
        self.hash = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        self.at = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        self.of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.at, self.of = self.hash[order], self.at[order], self.of[order]
        self.anchors = {n: (np.array([x[0] for x in sorted(found)], np.uint64), [x[1:] for x in sorted(found)]) for n, found in anchors.items()}

    def verbatim(self, plain: np.ndarray) -> dict[int, int]:
        """The first plain word of every item that stands in a text as a whole."""
        out: dict[int, int] = {}
        for n, (hashes, places) in self.anchors.items():
            h = plain_hashes(plain, n)
            for d, lo, hi in zip(*(x.tolist() for x in _found(hashes, h)), strict=True):
                for i, k in places[lo:hi]:
                    if k not in out and d >= i and np.array_equal(plain[d - i : d - i + len(self.plain[k])], self.plain[k]):
                        out[k] = d - i
        return out

    def matches(self, text: str, canon: Canon) -> list[dict]:
        if not text:
            return []
        reading = canon.read(text)
        found: dict[int, dict] = {}
        for of, at in self.verbatim(reading.plain()).items():
            slots = sum(bool(w[1]) for w in self.items[of][1])
            found[of] = {"coverage": 1.0, "n_slots": slots, "n_consistent": slots, "kind": "exact", "first_word": reading.word_of(at)}
        h, pos = window_hashes(reading.codes())
        spots: dict[int, list[tuple[int, int]]] = {}
        for k, lo, hi in zip(*(x.tolist() for x in _found(self.hash, h)), strict=True):
            for j in range(lo, hi):
                if (of := int(self.of[j])) not in found:
                    spots.setdefault(of, []).append((int(pos[k]), int(self.at[j])))
        words = reading.words() if spots else []
        for of, pairs in spots.items():
            if (got := compare(self.items[of][1], words, pairs)) is not None:
                found[of] = got
        return [{"item_id": self.items[of][0], **got} for of, got in sorted(found.items())]


LEAKS = "doc_id long, item_id long, coverage double, n_slots long, n_consistent long, kind string, first_word long"
_LEAK_TYPE = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_slots", pa.int64()), ("n_consistent", pa.int64()), ("kind", pa.string()), ("first_word", pa.int64())])


def _digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _windows(df: DataFrame, name: str, lengths: list[int] | None = None) -> DataFrame:
    """(name, hash) of every template window of df's (name, text), and of all runs of so many plain words; None: its anchor."""

    def run(batches):
        canon = Canon()
        for batch in batches:
            keys, hashes = [], []
            for key, text in zip(batch.column(0).to_pylist(), storage.texts_of(batch, 1), strict=True):
                reading = canon.read(text)
                plain = reading.plain()
                if lengths is None:
                    own = [np.array([anchor(plain)[1]], np.uint64)] if reading.full.any() else []
                else:
                    own = [plain_hashes(plain, n) for n in lengths]
                h = np.unique(np.concatenate([window_hashes(reading.codes())[0], *own]))
                hashes.append(h)
                keys.extend([key] * len(h))
            flat = np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(flat)], [name, "hash"])

    return storage.map_batches(df, run, f"{name} string, hash long")


def _anchor_lengths(items: DataFrame) -> list[int]:
    """The lengths of the items' anchors, WINDOW of them at most."""

    def run(batches):
        canon, seen = Canon(), set()
        for batch in batches:
            seen |= {min(WINDOW, len(canon.read(x).plain())) for x in storage.texts_of(batch, 1)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen - {0}), pa.int64())], ["n"])

    return sorted(r.n for r in storage.map_batches(items, run, "n long").distinct().collect())


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _index_if_small(items: DataFrame):
    """The index, to be broadcast, where the benchmark's words bound its windows; else None."""
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    return Index([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()]) if words <= BROADCAST_WINDOWS else None


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it."""
    spark, rows, items = docs.sparkSession, storage.text_column(docs, key, text), _items(benchmark, item, item_text)
    index = _index_if_small(items)
    if index is not None:
        return _leaks_by_map(rows, spark.sparkContext.broadcast(index))
    return _leaks_by_shuffle(rows, items).drop("doc_key")


def _leaks_by_map(rows: DataFrame, shared) -> DataFrame:
    def run(batches):
        index, canon = shared.value, Canon()
        for batch in batches:
            got = [{"doc_id": key, **m} for key, x in zip(batch.column(0).to_pylist(), storage.texts_of(batch, 1), strict=True) for m in index.matches(x, canon)]
            yield pa.RecordBatch.from_pylist(got, schema=_LEAK_TYPE)

    return storage.map_batches(rows, run, LEAKS)


def _leaks_by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows joined by hash; the texts of candidate pairs are then compared as above. doc_key: digest of the document."""
    rows, items = rows.withColumn("doc_key", _digest_of(F.col("text"))), items.withColumn("item_key", _digest_of(F.col("text")))
    pairs = _windows(rows.select("doc_key", "text"), "doc_key", _anchor_lengths(items.select("item_id", "text"))).join(_windows(items.select("item_key", "text"), "item_key"), "hash")
    both = pairs.select("doc_key", "item_key").distinct().join(items.withColumnRenamed("text", "item_text"), "item_key").join(rows, "doc_key")

    def run(batches):
        canon = Canon()
        for batch in batches:
            got = []
            for doc_key, key, x, item_id, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.extend({"doc_key": doc_key, "doc_id": key, **m} for m in Index([(item_id, item_text)]).matches(x or "", canon))
            yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("doc_key", pa.string()), *_LEAK_TYPE]))

    return storage.map_batches(both.select("doc_key", "doc_id", "text", "item_id", "item_text"), run, f"doc_key string, {LEAKS}")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents in which a benchmark item is found."""
    items = _items(benchmark, item, item_text)
    index = _index_if_small(items)
    if index is None:
        gone = _leaks_by_shuffle(storage.text_column(docs, key, text), items).select("doc_key").distinct()
        return docs.join(gone, _digest_of(docs[text]) == gone["doc_key"], "left_anti")
    shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text)

    def run(batches):
        index, canon = shared.value, Canon()
        for batch in batches:
            yield batch.filter(pa.array([not index.matches(x, canon) for x in storage.texts_of(batch, at)], pa.bool_()))

    return storage.map_batches(docs, run, docs.schema)
