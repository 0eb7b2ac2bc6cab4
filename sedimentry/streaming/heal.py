"""Streams of packets whose keys drift: heal known keys without state, and learn unknown ones with state per source."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The names that a clean packet uses.
EXPECTED = ("gx", "gy", "gz")


def rename_keys(measures: Column, mapping: dict[str, str]) -> Column:
    """Map keys by mapping, others unchanged. Where two keys meet, the last one wins, as entries are merged in order."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else None
    renamed = F.transform(F.map_entries(measures), lambda e: F.struct((F.coalesce(F.try_element_at(table, e["key"]), e["key"]) if table is not None else e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(renamed, lambda e, i: ~F.exists(F.slice(renamed, i + 2, F.size(renamed)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per hour and type; timestamps without a zone are read as UTC, for watermarks need one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    per = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    per = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("began"), "n")


class KeyHealer(StatefulProcessor):
    """Per source: known keys are renamed, an unknown key is resolved once and remembered, also where nothing fits."""

    def __init__(self, resolve: Callable[[str], tuple[str | None, float]], expected: tuple[str, ...] = EXPECTED):
        self.resolve, self.expected = resolve, expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "raw string", "target string, confidence double")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            out = []
            for sample, raw, value in zip(frame["sample_id"], frame["raw_key"], frame["value"], strict=True):
                target, event = raw, False
                if raw not in self.expected:
                    if not self.known.containsKey((raw,)):
                        found, confidence = self.resolve(raw)
                        self.known.updateValue((raw,), (found or "", float(round(confidence, 3))))
                        event = found is not None
                    target = self.known.getValue((raw,))[0] or raw
                out.append((key[0], int(sample), raw, target, float(value), event))
            yield pd.DataFrame(out, columns=["driver_id", "sample_id", "raw_key", "healed_key", "value", "drift_event"])

    def close(self) -> None:
        pass


def heal(packets: DataFrame, resolve: Callable[[str], tuple[str | None, float]]) -> DataFrame:
    """packets: driver_id, sample_id, raw_key, value, one row per measure. Needs the RocksDB state store."""
    return packets.groupBy("driver_id").transformWithStateInPandas(
        KeyHealer(resolve), "driver_id string, sample_id bigint, raw_key string, healed_key string, value double, drift_event boolean", "Append", "None"
    )


def with_events(healed: DataFrame, healed_path: str, events_path: str, checkpoint: str):
    """Starts a query that writes healed rows and, beside them, one row for every key that was learned. Batches that run again
    replace what they wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        events = batch.where("drift_event").select("driver_id", "sample_id", "raw_key", "healed_key")
        for rows, path in ((batch.drop("drift_event"), healed_path), (events, events_path)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return healed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_view(rows: DataFrame, order: str, keep: int, path: str, checkpoint: str):
    """Starts a query that holds the last ``keep`` rows of a stream as a small table, numbered by batch; the newest number counts."""
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{path}/batch={number - 1}") if number else None
        both = batch.unionByName(before) if before is not None else batch
        both.orderBy(F.col(order).desc()).limit(keep).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
