"""JSON, JSON lines, CSV and HTML readers, and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Where whole and decimal numbers meet, a variant's schema is a decimal.
_WHOLE = re.compile(r"DECIMAL\(\d+,\s*[1-9]\d*\)")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def messy_records(spark: SparkSession, lines: DataFrame, column: str = "value") -> DataFrame:
    """Records whose keys vary: late keys become nullable columns, whole and decimal numbers widen. The schema is one aggregation
    over all lines, and lines are parsed by it where they are."""
    shape = lines.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()[0]
    found = spark.sql(f"select from_json('{{}}', '{_WHOLE.sub('DOUBLE', shape.replace('OBJECT<', 'STRUCT<'))}') as r").schema["r"].dataType if shape and shape.startswith("OBJECT<") else None
    if found is None:
        return spark.createDataFrame([], "value string")
    return lines.select(F.from_json(F.col(column), found).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("page_text", text.html_text(F.col(html)))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows are added to a table of CSV files, which is made if it isn't there; every file has a header."""
    df.write.mode("append").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as a JSON document with the SHA-256 of its text beside it."""
    body = F.to_json(F.struct(*df.columns))
    df.select(body.alias("body"), F.sha2(body, 256).alias("signature")).coalesce(1).write.mode("overwrite").json(path)


def replay(spark: SparkSession, path: str, schema: str, files: int = 1, rename: dict[str, str] | None = None) -> DataFrame:
    """A recorded table of JSON files as a stream, so many files a batch, oldest first; column names are lowered and may be
    replaced."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    stream = stream.toDF(*[c.lower() for c in stream.columns])
    return stream.withColumnsRenamed(rename or {})


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
