"""Repeated windows of fixed length, found through sparse anchored suffixes.

Anchors. In every window of ``length`` symbols the gram of ``gram`` symbols with the smallest hash is the window's anchor
(ties: leftmost). Equal windows have equal anchors at equal offsets, so windows can be compared anchor by anchor, and
only about two in ``length - gram`` positions are anchors. The windows of one anchor are consecutive; its context is the
text that they span, split at the anchor into a right part, the anchored suffix, and a left part, read backwards.

Passes, all over one table dealt into small groups of documents (bucketed, so no later pass moves texts again):

1. every group sends each of its anchor hashes once; hashes that are unique over all groups drop out, and each group
   gets back those that repeat (the duplicate detection of prefix-doubling string sorters);
2. every group sends the distinct contexts of repeated anchors as sorted, front-coded runs, dealt by anchor hash.
   Contexts that are equal within a group are combined first. An anchor with more than ``hot`` occurrences is split: each
   of its windows becomes a context of its own, dealt by the hash of the whole window, so no anchor fills one task;
3. each bucket orders its anchored suffixes and left parts, takes the common prefixes of neighbours, and so knows for
   every offset which windows are equal; ranges of repeated windows go back to the groups, which apply them.

Hashes only choose what is compared; equality is decided on the symbols themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
NO_ID = np.iinfo(np.int64).max
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(name: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64."""
    have = _powers[name]
    if len(have) < n:
        step = np.full(1 << (n - 1).bit_length(), _BASE if name == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Bytes:
    """A text as UTF-8 bytes."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.n = len(self.raw)

    def units(self) -> np.ndarray:
        return mixed(np.frombuffer(self.raw, np.uint8).astype(np.uint64) + np.uint64(0x1234567))

    def right(self, a: int, z: int) -> bytes:
        return self.raw[a:z]

    def left(self, a: int, z: int) -> bytes:
        return self.raw[a:z][::-1]

    @staticmethod
    def symbols(common: int, text: bytes) -> int:
        return common


class Words:
    """A text as words, runs of anything but [\\x20\\x09-\\x0D]; each word is closed by a space."""

    def __init__(self, text: str):
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)

    def units(self) -> np.ndarray:
        return mixed(np.fromiter(map(zlib.crc32, self.words), np.uint64, self.n) + np.uint64(1))

    def right(self, a: int, z: int) -> bytes:
        return b" ".join(self.words[a:z]) + b" "

    def left(self, a: int, z: int) -> bytes:
        return b" ".join(self.words[a:z][::-1]) + b" " if z > a else b""

    @staticmethod
    def symbols(common: int, text: bytes) -> int:
        return text.count(b" ", 0, common)


@dataclass(frozen=True)
class Plan:
    kind: type
    length: int
    gram: int
    earlier_only: bool  # a window counts only if it also stands in a document with a smaller id
    hot: int = 20_000
    group_bytes: int = 2 << 20

    @property
    def spread(self) -> int:
        return self.length - self.gram + 1

    @property
    def least_bytes(self) -> int:
        """No text of fewer bytes holds a window."""
        return 2 * self.length - 1 if self.kind is Words else self.length


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(seq, plan: Plan):
    """(hash, position, first and last window start) of each anchor, and a function for hashes of whole windows."""
    n, k = seq.n, plan.gram
    if n < plan.length:
        return None
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(seq.units() * powers("up", n), out=sums[1:])
    down = powers("down", n)

    def gram_hash(starts, size):
        return mixed((sums[starts + size] - sums[starts]) * down[starts])

    every = mixed((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
    keyed = (every & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(every), dtype=np.uint64)
    at = (sliding_min(keyed, plan.spread) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    pos = at[first]
    return every[pos], pos, first, np.r_[first[1:], len(at)] - 1, lambda starts: gram_hash(starts, plan.length)


# --- groups of documents ---------------------------------------------------------------------------------------------


def group_count(n_bytes: int, group_bytes: int) -> tuple[int, int]:
    """Groups of documents and tasks for so many bytes: groups grow with the input from 8 GB on, to sixteen times their size."""
    groups = max(8, -(-n_bytes // min(16 * group_bytes, max(group_bytes, n_bytes // 4096))))
    return groups, max(2, -(-groups // 4))


def grouped_table(docs: DataFrame, plan: Plan, key: str, text: str, n_bytes: int | None = None) -> tuple[DataFrame, int]:
    """doc_id, text, grp in a bucketed table of the shared folder; the number of groups grows with the input."""
    groups, tasks = group_count(n_bytes or storage.input_bytes(docs, text), plan.group_bytes)
    rows = storage.text_column(docs, key, text)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    return storage.bucketed(rows, "groups", tasks, "grp"), tasks


def documents_of(table: pa.Table):
    """A group's documents in an order that depends on their content only: (doc_id or None, text)."""
    pairs = zip(table.column("doc_id").to_pylist(), (x or "" for x in table.column("text").to_pylist()), strict=True)
    return sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))


# --- pass 1: which anchors repeat ------------------------------------------------------------------------------------

_SEEN = np.dtype([("h", "<u8"), ("grp", "<i4"), ("n", "<u4"), ("lo", "<i8"), ("hi", "<i8")])
_BACK = np.dtype([("h", "<u8"), ("hot", "u1")])


def _collapse(h, n, lo, hi):
    """Sum and extremes per hash: (hashes, starts of groups in the order, order)."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, n, lo, hi, first, order
    return h[first], np.add.reduceat(n[order], first), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first), first, order


def _packed_table(batches) -> pa.Table:
    kind = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
    return pa.Table.from_batches(list(batches), kind)


def repeated_anchors(groups: DataFrame, plan: Plan, tasks: int) -> DataFrame:
    """Packed per group: the anchor hashes that repeat."""
    buckets = tasks * 4

    def send(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packed_table([])
        grp = table.column("grp")[0].as_py()
        hs, ids = [], []
        for key, text in documents_of(table):
            got = anchors(plan.kind(text), plan)
            if got is not None:
                hs.append(got[0])
                ids.append(np.full(len(got[0]), NO_ID if key is None else key, np.int64))
        if not hs:
            return _packed_table([])
        h, ids = np.concatenate(hs), np.concatenate(ids)
        h, n, lo, hi, _, _ = _collapse(h, np.ones(len(h), np.uint32), ids, ids)
        out = np.empty(len(h), _SEEN)
        out["h"], out["grp"], out["n"], out["lo"], out["hi"] = h, grp, n, lo, hi
        return _packed_table(storage.packed_batches(out, (h % np.uint64(buckets)).astype(np.int32)))

    def decide(rows: np.ndarray):
        h, n, lo, hi, first, order = _collapse(rows["h"], rows["n"].astype(np.int64), rows["lo"], rows["hi"])
        keep = lo < hi if plan.earlier_only else n > 1
        size = np.diff(np.r_[first, len(rows)])
        kept = np.repeat(keep, size)
        out = np.empty(int(kept.sum()), _BACK)
        out["h"] = np.repeat(h, size)[kept]
        out["hot"] = np.repeat(n > plan.hot, size)[kept]
        yield from storage.packed_batches(out, rows["grp"][order][kept])

    sent = groups.groupBy("grp").applyInArrow(send, storage.PACKED)
    return storage.by_bucket(sent, tasks, decide, _SEEN, storage.PACKED)


# --- pass 2: contexts as sorted, front-coded runs --------------------------------------------------------------------

_ITEM = np.dtype([("common", "<u4"), ("tail", "<u4"), ("left", "<u4"), ("i", "<u4"), ("at", "<u4"), ("o_lo", "<u4"), ("o_hi", "<u4"), ("grp", "<i4"), ("doc", "<i8")])
_RANGE = np.dtype([("i", "<u4"), ("lo", "<u4"), ("hi", "<u4")])
MIXED = "bucket int, is_run boolean, grp int, payload binary"
_MIXED_TYPE = pa.schema([("bucket", pa.int32()), ("is_run", pa.bool_()), ("grp", pa.int32()), ("payload", pa.binary())])
RANGES = "grp int, payload binary"


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    both = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (both.bit_length() + 7) // 8


def pack_run(items: list[tuple]) -> bytes:
    """items: (right, left, i, at, o_lo, o_hi, grp, doc), sorted. Each right part drops what it shares with the last."""
    head = np.empty(len(items), _ITEM)
    tails, lefts, last = [], [], b""
    for k, (right, left, *rest) in enumerate(items):
        common = common_prefix(last, right)
        tails.append(right[common:])
        lefts.append(left)
        head[k] = (common, len(right) - common, len(left), *rest)
        last = right
    return len(items).to_bytes(4, "little") + head.tobytes() + b"".join(tails) + b"".join(lefts)


def unpack_run(load: bytes):
    """(head, right parts, left parts)."""
    n = int.from_bytes(load[:4], "little")
    head = np.frombuffer(load, _ITEM, n, 4)
    at, last, rights, lefts = 4 + n * _ITEM.itemsize, b"", [], []
    for common, size in zip(head["common"].tolist(), head["tail"].tolist(), strict=True):
        last = last[:common] + load[at : at + size]
        rights.append(last)
        at += size
    for size in head["left"].tolist():
        lefts.append(load[at : at + size])
        at += size
    return head, rights, lefts


def contexts(groups: DataFrame, repeated: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Runs of contexts, and ranges that are settled within a group."""

    def send(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return pa.Table.from_batches([], _MIXED_TYPE)
        grp = table.column("grp")[0].as_py()
        known = np.concatenate([np.frombuffer(x.as_buffer(), _BACK) for x in back.column("payload")])
        known = known[np.argsort(known["h"])]
        found: dict[tuple[bytes, bytes], list[tuple]] = {}
        deal: dict[tuple[bytes, bytes], int] = {}
        for i, (key, text) in enumerate(documents_of(table)):
            seq = plan.kind(text)
            got = anchors(seq, plan)
            if got is None:
                continue
            h, pos, first, last, window_hash = got
            where = np.minimum(np.searchsorted(known["h"], h), len(known) - 1)
            some = np.flatnonzero(known["h"][where] == h)
            doc = NO_ID if key is None else key
            for j in some.tolist():
                a, s1, s2 = int(pos[j]), int(first[j]), int(last[j])
                if known["hot"][where[j]]:
                    starts = np.arange(s1, s2 + 1)
                    spans = zip(starts.tolist(), starts.tolist(), (window_hash(starts) % np.uint64(buckets)).tolist(), strict=True)
                else:
                    spans = [(s1, s2, int(h[j] % np.uint64(buckets)))]
                for u, v, bucket in spans:
                    context = (seq.right(a, v + plan.length), seq.left(u, a))
                    found.setdefault(context, []).append((i, a, a - v, a - u, grp, doc))
                    deal[context] = bucket
        runs: dict[int, list[tuple]] = {}
        settled = []
        for context, items in found.items():
            if len(items) > 1:
                least = min(x[5] for x in items)
                if plan.earlier_only:
                    done, items = [x for x in items if x[5] > least], [x for x in items if x[5] == least]
                else:
                    done, items = items, items[:1]
                settled.extend((x[0], x[1] - x[3], x[1] - x[2]) for x in done)
            runs.setdefault(deal[context], []).extend((*context, *x) for x in items)
        cols = [[], [], [], []]
        for bucket, items in runs.items():
            items.sort()
            for col, x in zip(cols, (bucket, True, grp, pack_run(items)), strict=True):
                col.append(x)
        if settled:
            for col, x in zip(cols, (grp % buckets, False, grp, np.array(settled, _RANGE).tobytes()), strict=True):
                col.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MIXED_TYPE, strict=True)], schema=_MIXED_TYPE)

    return groups.groupBy("grp").cogroup(repeated.withColumnRenamed("bucket", "grp").groupBy("grp")).applyInArrow(send, MIXED)


# --- pass 3: equal windows -------------------------------------------------------------------------------------------


def neighbours(texts: list[bytes], kind) -> np.ndarray:
    """Symbols that each sorted text shares with the one before; -1 for the first."""
    out = np.full(len(texts), -1, np.int64)
    for k in range(1, len(texts)):
        out[k] = kind.symbols(common_prefix(texts[k - 1], texts[k]), texts[k])
    return out


def equal_windows(right_common: np.ndarray, lefts: list[bytes], head: np.ndarray, plan: Plan):
    """Items stand in the order of their right parts. Yields (item, first start, last start) of repeated windows.

    Cutting the ordered right parts wherever neighbours share fewer than length - o symbols gives the tree nodes at that
    depth; the left parts are cut at depth o. Two windows at offset o are equal if they are below the same two nodes.
    """
    n = len(head)
    order = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    left_common = neighbours([lefts[i] for i in order.tolist()], plan.kind)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    o_lo, o_hi, doc = head["o_lo"].astype(np.int64), head["o_hi"].astype(np.int64), head["doc"]
    hit = np.zeros((plan.spread + 2, n), bool)
    for o in range(plan.spread):
        some = np.flatnonzero((o_lo <= o) & (o <= o_hi))
        if len(some) < 2:
            continue
        node = np.cumsum(right_common < plan.length - o)[some]
        shared = np.r_[False, node[1:] == node[:-1]]
        shared[:-1] |= shared[1:]
        some, node = some[shared], node[shared]
        if not len(some):
            continue
        both = node * (n + 1) + np.cumsum(left_common < o)[place[some]]
        by = np.argsort(both, kind="stable")
        both, some = both[by], some[by]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        size = np.diff(np.r_[first, len(both)])
        if plan.earlier_only:
            good = doc[some] > np.repeat(np.minimum.reduceat(doc[some], first), size)
        else:
            good = np.repeat(size, size) > 1
        hit[o + 1, some[good]] = True
    edge = np.diff(hit.astype(np.int8), axis=0)
    begin_o, begin_i = np.nonzero(edge.T > 0)[::-1]
    end_o, _ = np.nonzero(edge.T < 0)[::-1]
    at = head["at"].astype(np.int64)[begin_i]
    return begin_i, at - (end_o - 1), at - begin_o


Merge = Callable[[list[tuple[np.ndarray, list[bytes], list[bytes]]], type], tuple[np.ndarray, list[bytes], np.ndarray]]


def settle(mixed_rows: DataFrame, plan: Plan, tasks: int, merge: Merge) -> DataFrame:
    """Ranges of repeated windows, packed per group. merge orders the runs of one bucket by their right parts."""

    def finish(runs):
        head, lefts, common = merge([unpack_run(x) for x in runs], plan.kind)
        item, lo, hi = equal_windows(common, lefts, head, plan)
        out = np.empty(len(item), _RANGE)
        out["i"], out["lo"], out["hi"] = head["i"][item], lo, hi
        for batch in storage.packed_batches(out, head["grp"][item]):
            yield pa.RecordBatch.from_arrays(batch.columns, ["grp", "payload"])

    def run(batches):
        now, runs = None, []
        for batch in batches:
            for bucket, is_run, grp, load in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_run:
                    yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([load], pa.binary())], ["grp", "payload"])
                    continue
                if bucket != now and runs:
                    yield from finish(runs)
                    runs = []
                now = bucket
                runs.append(load)
        if runs:
            yield from finish(runs)

    storage.small_batches(mixed_rows.sparkSession)
    return mixed_rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RANGES)


def union(ranges: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Disjoint, separated symbol spans covered by the windows that start in the ranges."""
    if not len(ranges):
        return []
    ranges = ranges[np.argsort(ranges["lo"], kind="stable")]
    lo, end = ranges["lo"].astype(np.int64), ranges["hi"].astype(np.int64) + length
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return list(zip(lo[first].tolist(), reach[np.r_[first[1:], len(lo)] - 1].tolist(), strict=True))


def apply_spans(groups: DataFrame, ranges: DataFrame, plan: Plan, make, schema: str) -> DataFrame:
    """make: (doc_id or None, sequence, spans to remove) -> tuple of schema's columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        loads = [np.frombuffer(x.as_buffer(), _RANGE) for x in back.column("payload")]
        found = np.concatenate(loads) if loads else np.zeros(0, _RANGE)
        found = found[np.argsort(found["i"], kind="stable")]
        docs = documents_of(table)
        cuts = np.searchsorted(found["i"], np.arange(len(docs) + 1))
        rows = [make(key, plan.kind(text), union(found[cuts[i] : cuts[i + 1]], plan.length)) for i, (key, text) in enumerate(docs)]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    return groups.groupBy("grp").cogroup(ranges.groupBy("grp")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, plan: Plan, merge: Merge, make, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts too short for a window, null ones among them, have nothing to share and are answered where they are read; so however
    many rows are alike in that, they make no group."""
    rows = storage.text_column(docs, key, text)
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < plan.least_bytes
    names = [x.split()[0] for x in schema.split(", ")]

    def answer(batches):
        for batch in batches:
            made = [make(k, plan.kind(x), []) for k, x in zip(batch.column(0).to_pylist(), storage.texts_of(batch, 1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], _KINDS[x.split()[1]]) for c, x in enumerate(schema.split(", "))], names)

    groups, tasks = grouped_table(rows.where(~short), plan, "doc_id", "text", storage.input_bytes(docs, text))
    repeated = repeated_anchors(groups, plan, tasks)
    runs = contexts(groups, repeated, plan, tasks * 4)
    found = apply_spans(groups, settle(runs, plan, tasks, merge), plan, make, schema)
    return found.unionByName(storage.map_batches(rows.where(short), answer, schema))


_KINDS = {"long": pa.int64(), "string": pa.string()}
