"""Session defaults shared by the queries, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "sedimentry", cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session; on a cluster pass spark-submit settings instead and call getOrCreate."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **extra}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("SEDIMENTRY_DRIVER_MEMORY", "8g"))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
