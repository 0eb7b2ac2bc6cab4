"""Deterministic row generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def anomaly_table(spark: SparkSession, rows: int = 100, every: int = 10) -> DataFrame:
    """rows sensor rows; every tenth reading is, in turn, missing, text, far too high, far too low."""
    n = F.col("row_number")
    turn = F.pmod(n / every - 1, F.lit(4))
    odd = F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, "ERR").when(turn == 2, "999").otherwise("-273")
    fine = (85 + F.pmod(n * 7, F.lit(30))).cast("string")
    base = spark.range(1, rows + 1).select(F.col("id").cast("int").alias("row_number"))
    return base.select("row_number", F.format_string("unit_%02d", n % 20).alias("device_id"), F.when(n % every == 0, odd).otherwise(fine).alias("eng_temp_sensor"))


def vitals(spark: SparkSession, records: int, switch_percent: int = 10) -> DataFrame:
    """Vital signs under three vendors' names; which vendor writes a record changes in about switch_percent of them."""
    styles = {0: ("HR", "SpO2", "SBP"), 1: ("pulse_rate", "oxygen_sat", "systolic_bp"), 2: ("heartRate", "o2Saturation", "bpSystolic")}
    n = F.col("id")
    block = F.floor(n * switch_percent / 100)
    rows = spark.range(records).withColumn("vendor", F.pmod(block * 7 + 1, F.lit(3)).cast("int"))
    measures = F.array((60 + F.pmod(n * 13, F.lit(45))).cast("double"), (92 + F.pmod(n * 5, F.lit(8))).cast("double"), (100 + F.pmod(n * 11, F.lit(50))).cast("double"))
    names = F.element_at(F.array(*[F.array(*[F.lit(x) for x in styles[k]]) for k in sorted(styles)]), F.col("vendor") + 1)
    return rows.select(n.alias("record_id"), F.concat(F.lit("vendor_"), "vendor").alias("vendor"), F.map_from_arrays(names, measures).alias("measures"))


def packet_stream(spark: SparkSession, rows_per_second: int = 50) -> DataFrame:
    """An endless stream of numbered samples; telemetry.packets turns them into packets."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.lit("unit_01").alias("driver_id"), F.col("value").alias("sample_id"), "timestamp")
