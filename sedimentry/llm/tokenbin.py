"""Token ids as binary files: canonical length-limited Huffman codes from global counts, with random access.

Writing. Texts are encoded once and their ids kept as a compressed table together with one row of id counts per task.
The counts' sum, bounded by the vocabulary, gives one canonical code with words of 16 bits at most (package-merge).
Each document's ids are coded on their own, starting at a byte, with a checkpoint of its bit offset every 256 ids; coded
documents are then exchanged by ranges of doc_id and a checksum of their ids, so that neither rows without a doc_id nor the rows
of one doc_id make a part of their own, sorted, and packed into blocks; a part is a range.

File format: a Parquet table of blocks. part and block order the blocks; first is the number of ids before the block in
its part; doc_ids and doc_lens (int64) list its documents; checkpoints (int64) hold the bit offset of every 256th id of
each document; payload holds the code words. Beside it lies a one-row table with the code lengths, from which the
canonical code follows.

Reading. Blocks are independent. All checkpoints of a block are decoded side by side: one table lookup of 16 bits gives
an id and its length for every lane at once.

Edge cases: null and empty texts have only the end id; a null doc_id sorts first; repeated rows are written each and tie
by their checksum; an empty table gives an empty file and result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage, tokens

STEP = 256
BLOCK_IDS = 1 << 19
PART_BYTES = 64 << 20
END_ID = 2
_COUNT = np.dtype([("id", "<u4"), ("n", "<u8")])


# --- code ------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal lengths of limit bits at most (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    rows, is_leaf = leaves, []
    for _ in range(limit - 1):
        is_leaf.append(None if rows is leaves else mark)
        pairs = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[leaves, pairs]
        at = np.argsort(both, kind="stable")
        rows, mark = both[at], at < n
    is_leaf.append(None if rows is leaves else mark)
    take = 2 * n - 2
    for m in reversed(is_leaf):
        k = take if m is None else int(m[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        own = lengths[order].astype(np.int64)
        top = int(own[-1])
        ends = np.cumsum(np.left_shift(np.int64(1), top - own))
        codes[order] = ((ends - np.left_shift(np.int64(1), top - own)) >> (top - own)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """id << 8 | length for every window of as many bits as the longest code word has."""
    codes, top = canonical(lengths), int(lengths.max(initial=1))
    table = np.zeros(1 << top, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    fill = np.repeat((order.astype(np.uint32) << 8) | own.astype(np.uint32), np.left_shift(np.int64(1), top - own))
    table[: len(fill)] = fill
    assert not len(order) or codes[order[0]] == 0
    return table, top


def encode_documents(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """Code documents laid end to end, each starting at a byte: (bytes, bit offset of each id, byte start of each)."""
    own = lengths[ids].astype(np.int64)
    ends = np.cumsum(own)
    doc_ends = np.cumsum(lens)
    bits = np.diff(np.r_[0, ends[doc_ends - 1]])
    starts = np.r_[0, np.cumsum((bits + 7) >> 3)]
    shift = (starts[:-1] << 3) - np.r_[0, np.cumsum(bits)[:-1]]
    at = ends - own + np.repeat(shift, lens)
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - own).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(starts[-1]) >> 2) + 3, np.uint32)
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    return out.astype(">u4").tobytes(), at, starts


def decode_block(payload: bytes, checkpoints: np.ndarray, doc_lens: np.ndarray, table: np.ndarray, top: int) -> np.ndarray:
    """All ids of a block, decoding from every checkpoint side by side."""
    lanes = (doc_lens + STEP - 1) // STEP
    left = np.full(int(lanes.sum()), STEP, np.int64)
    left[np.cumsum(lanes) - 1] = doc_lens - (lanes - 1) * STEP
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
    window = raw[:-4] << np.uint64(32)
    for k in range(1, 5):
        window |= raw[k : len(raw) - 4 + k] << np.uint64(32 - 8 * k)
    # Longest lanes first, so that the lanes still running are always a prefix.
    order = np.argsort(-left, kind="stable")
    pos, need = checkpoints[order].astype(np.int64), left[order]
    out = np.empty((STEP, len(pos)), np.uint32)
    mask, keep = (1 << top) - 1, len(pos)
    running = np.searchsorted(-need, -np.arange(STEP), side="left")
    for k in range(STEP):
        keep = int(running[k])
        if not keep:
            break
        p = pos[:keep]
        x = (window[p >> 3] >> (40 - top - (p & 7)).astype(np.uint64)).astype(np.int64) & mask
        e = table[x]
        out[k, :keep] = e >> 8
        pos[:keep] = p + (e & 255)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    grid = out.T[back]
    return grid[np.arange(STEP) < left[:, None]]


# --- tables ----------------------------------------------------------------------------------------------------------

IDS = "doc_id long, n_tokens long, check long, ids binary, counts binary"
CODED = "doc_id long, check long, n_tokens long, marks binary, payload binary"
BLOCKS = "part int, block int, first long, n_tokens long, doc_ids binary, known binary, doc_lens binary, checkpoints binary, payload binary"
_IDS_TYPE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("check", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def encode_ids(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> DataFrame:
    """Rows of ids per document, and one row of id counts per task."""

    def run(batches):
        enc = tokens.encoder(path, 2) if tokens.encoder(path, 2).size <= 1 << 16 else tokens.encoder(path, 4)
        end = np.array([end_id], enc.dtype).tobytes()
        counts = np.zeros(max(enc.size, end_id + 1), np.uint64)
        for batch in batches:
            ids = [x + end for x in enc.encode(batch.column(1))]
            counts += np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=len(counts)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), storage.longs([len(x) // enc.dtype.itemsize for x in ids]), storage.longs([zlib.crc32(x) for x in ids]), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], schema=_IDS_TYPE)
        some = np.flatnonzero(counts)
        rows = np.empty(len(some), _COUNT)
        rows["id"], rows["n"] = some, counts[some]
        yield pa.RecordBatch.from_pylist([{"counts": rows.tobytes()}], schema=_IDS_TYPE)

    return storage.map_batches(storage.text_column(docs, key, text), run, IDS)


def global_counts(ids: DataFrame) -> np.ndarray:
    """Counts per id over all documents; what reaches the driver is bounded by the vocabulary."""

    def spread(batches):
        for batch in batches:
            for load in batch.column(0):
                rows = np.frombuffer(load.as_buffer(), _COUNT)
                yield from storage.packed_batches(rows, (rows["id"] % 16).astype(np.int32))

    def add(rows):
        total = np.bincount(rows["id"], rows["n"].astype(np.float64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([storage.longs(some), storage.longs(total[some].astype(np.int64))], ["id", "n"])

    packed = ids.where("counts is not null").select("counts").mapInArrow(spread, storage.PACKED)
    got = storage.by_bucket(packed, 16, add, _COUNT, "id long, n long").toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def part_count(spark: SparkSession, n_bytes: int) -> int:
    """Parts of PART_BYTES of ids; small inputs get a part a task, up to 16."""
    return max(1, -(-n_bytes // PART_BYTES), min(16, storage.tasks_for(spark)))


def write_ids(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs and write folder/blocks and folder/code in ascending doc_id order."""
    spark, path = docs.sparkSession, path or tokens.default_path()
    ids = storage.store(encode_ids(docs, path, key, text, end_id), "ids")
    lengths = code_lengths(global_counts(ids))
    codes = canonical(lengths)
    width = 2 if int(len(lengths)) <= 1 << 16 else 4
    code = spark.sparkContext.broadcast((codes, lengths))  # bounded by the vocabulary

    def encode(batches):
        codes, lengths = code.value
        for batch in batches:
            lens = batch.column(1).to_numpy()
            if not len(lens):
                continue
            joined = b"".join(batch.column(3).to_pylist())
            kind = np.dtype(f"<u{len(joined) // int(lens.sum())}")
            flat = np.frombuffer(joined, kind)
            data, at, starts = encode_documents(flat, lens, codes, lengths)
            firsts = np.r_[0, np.cumsum(lens)]
            marks = [(at[firsts[i] : firsts[i + 1] : STEP] - (starts[i] << 3)).astype("<i8").tobytes() for i in range(len(lens))]
            loads = [data[starts[i] : starts[i + 1]] for i in range(len(lens))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(marks, pa.binary()), pa.array(loads, pa.binary())], ["doc_id", "check", "n_tokens", "marks", "payload"])

    def pack(batches):
        now, block, first, held = None, 0, 0, []

        def flush():
            nonlocal block, first, held
            lens = np.array([x[1] for x in held], "<i8")
            sizes = np.r_[0, np.cumsum([len(x[3]) for x in held])[:-1]]
            marks = np.concatenate([np.frombuffer(x[2], "<i8") + (s << 3) for x, s in zip(held, sizes.tolist(), strict=True)])
            total = int(lens.sum())
            row = {"part": now, "block": block, "first": first, "n_tokens": total, "doc_ids": np.array([x[0] or 0 for x in held], "<i8").tobytes(), "known": bytes(x[0] is not None for x in held), "doc_lens": lens.tobytes(), "checkpoints": marks.astype("<i8").tobytes(), "payload": b"".join(x[3] for x in held)}
            block, first, held = block + 1, first + total, []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_TYPE)

        count = 0
        for batch in batches:
            for part, key, n, marks, load in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if held and (part != now or count + n > BLOCK_IDS):
                    yield flush()
                    count = 0
                if part != now:
                    now, block, first = part, 0, 0
                held.append((key, n, marks, load))
                count += n
        if held:
            yield flush()

    rows = ids.where("ids is not null").drop("counts").mapInArrow(encode, CODED)
    order = (F.col("doc_id").asc_nulls_first(), F.col("check"))
    rows = rows.repartitionByRange(part_count(spark, storage.input_bytes(ids)), *order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "check", "n_tokens", "marks", "payload")
    rows.mapInArrow(pack, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), width)], "lengths binary, width int").coalesce(1).write.parquet(f"{folder}/code")
    storage.discard(spark, ids.stored_at)


_BLOCK_TYPE = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "known", "doc_lens", "checkpoints", "payload"))])
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decoded(spark: SparkSession, folder: str, make, schema: str, columns: tuple[str, ...]) -> DataFrame:
    """Blocks with the number of ids before their part, decoded; make: (start, doc_ids, doc_lens, ids) -> arrays."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first()["lengths"]), np.uint8)
    shared = spark.sparkContext.broadcast(lengths)  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    joined = blocks.join(F.broadcast(sizes), F.col("part") == F.col("__part"))  # a row per part of 64 MB
    joined = joined.select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "known", "doc_lens", "checkpoints", "payload")

    def run(batches):
        table, top = decode_table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column(0)[i].as_py()
                keys, known, lens, marks, load = (batch.column(k)[i].as_py() for k in range(1, 6))
                lens = np.frombuffer(lens, "<i8")
                ids = decode_block(load, np.frombuffer(marks, "<i8"), lens, table, top)
                doc_ids = pa.array(np.frombuffer(keys, "<i8"), mask=np.frombuffer(known, np.uint8) == 0)
                yield pa.RecordBatch.from_arrays(make(start, doc_ids, lens, ids), list(columns))

    return storage.map_batches(joined, run, schema)


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def make(start, doc_ids, lens, ids):
        ends = np.cumsum(lens)
        flat = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
        return [doc_ids, storage.longs(start + ends - lens), storage.longs(lens), storage.longs(crc)]

    return _decoded(spark, folder, make, READ, ("doc_id", "start", "n_tokens", "ids_crc32"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids array<int> of every document in the files."""

    def make(start, doc_ids, lens, ids):
        ends = np.cumsum(lens)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
        return [doc_ids, storage.longs(start + ends - lens), lists]

    return _decoded(spark, folder, make, "doc_id long, start long, ids array<int>", ("doc_id", "start", "ids"))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs' ids to the shared folder and report on the files as read back."""
    spark = docs.sparkSession
    folder = storage.new_path(spark, "tokens")
    write_ids(docs, folder, key, text, path, end_id)
    return read_report(spark, folder)
