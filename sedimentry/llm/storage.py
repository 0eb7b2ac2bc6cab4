"""Tables in the shared folder, Arrow batch mapping, and a bucketed exchange of packed numpy records.

Every intermediate that is used twice is written as Parquet to the folder named by ``spark.checkpoint.dir``: it cuts
lineage, all executors and the driver can read it, and it survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a driver that is its own executor gets one of its own; a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="sedimentry-")
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/sedimentry-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, label: str, buckets: int, by: str, dealt: bool = False) -> DataFrame:
    """df, dealt by a column (already so if ``dealt``), as a bucketed table in the shared folder: later groupings by it don't
    move rows again."""
    spark, name = df.sparkSession, f"sedimentry_{uuid.uuid4().hex}"
    path = new_path(spark, label)
    _tables.append((spark, name))
    writer = (df if dealt else df.repartition(buckets, by)).write.bucketBy(buckets, by).option("compression", "zstd").option("path", path)
    writer.format("parquet").saveAsTable(name)
    back = spark.table(name)
    back.stored_as, back.stored_at = name, path
    return back


def drop_bucketed(df: DataFrame) -> None:
    """Delete a table that ``bucketed`` wrote, once what reads it is written itself."""
    df.sparkSession.sql(f"drop table if exists {df.stored_as}")
    discard(df.sparkSession, df.stored_at)


def _sweep() -> None:
    for drop, made in ((lambda spark, name: spark.sql(f"drop table if exists {name}"), _tables), (discard, _made)):
        for spark, what in made:
            try:
                drop(spark, what)
            except Exception:  # noqa: BLE001, S112  the session is gone: nothing is left to delete with
                continue


atexit.register(_sweep)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table that ``store`` wrote, once what reads it is written itself."""
    discard(df.sparkSession, df.stored_at)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of long texts small, unless the session asks for another size than the default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with bounded batches. fn: iterator of RecordBatch -> iterator of RecordBatch."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, at: int) -> list[str]:
    """A text column as Python strings; null becomes the empty text."""
    return [x or "" for x in batch.column(at).to_pylist()]


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


# --- exchange of packed records -------------------------------------------------------------------------------------
# One row carries many fixed-width records of one bucket: (bucket int, payload binary). Spark then moves a few thousand
# large rows instead of hundreds of millions of tiny ones, and numpy works on whole buckets.

PACKED = "bucket int, payload binary"


def packed_batches(records: np.ndarray, buckets: np.ndarray, most: int = 1 << 20):
    """Deal records (structured array) to buckets; yields RecordBatches of PACKED with payloads of most bytes at most."""
    if not len(records):
        return
    order = np.argsort(buckets, kind="stable")
    records, buckets = records[order], buckets[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(records)]
    step = max(1, most // records.dtype.itemsize)
    keys, loads, held = [], [], 0
    for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
        for i in range(a, z, step):
            keys.append(int(buckets[i]))
            loads.append(records[i : min(i + step, z)].tobytes())
            held += len(loads[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(loads, pa.binary())], ["bucket", "payload"])
                keys, loads, held = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(loads, pa.binary())], ["bucket", "payload"])


def by_bucket(packed: DataFrame, tasks: int, fn, dtype: np.dtype, schema: str) -> DataFrame:
    """Bring each bucket's records together. fn: structured array of one bucket -> iterable of RecordBatch."""

    def gather(batches):
        now, parts = None, []
        for batch in batches:
            keys, loads = batch.column(0).to_pylist(), batch.column(1)
            for key, load in zip(keys, loads, strict=True):
                if key != now and parts:
                    yield from fn(np.concatenate(parts))
                    parts = []
                now = key
                parts.append(np.frombuffer(load.as_buffer(), dtype).copy())
        if parts:
            yield from fn(np.concatenate(parts))

    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, schema)


#: An estimate beyond this is Spark's stand-in for an unknown size, or a product of sizes under a join.
UNKNOWN_BYTES = 1 << 50


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """What bucket counts grow with: Spark's estimate of a plan's size from its files; measured where it has none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found > UNKNOWN_BYTES:
        found = df.agg(F.sum(F.octet_length(text)).cast("long")).first()[0] or 0
    return max(1, found)


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under fixed names, so that other columns never clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
