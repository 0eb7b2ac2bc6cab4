"""Validation that never drops rows: rules are Columns, violations travel beside the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """broken is true where a row violates the rule; null counts as kept."""

    name: str
    broken: Column


def required(*columns: str) -> list[Rule]:
    return [Rule(f"{c}:required", F.col(c).isNull()) for c in columns]


def required_truthy(*columns: str) -> list[Rule]:
    """Null, the empty string and zero are all missing."""
    return [Rule(f"{c}:required", F.coalesce(F.col(c).cast("string").isin("", "0", "0.0"), F.lit(True))) for c in columns]


def in_range(column: str, low: float, high: float) -> Rule:
    """Bounds are inclusive and null passes."""
    return Rule(f"{column}:range", F.coalesce(~F.col(column).between(low, high), F.lit(False)))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with an array of the names of broken rules, in rule order; no row is dropped."""
    marks = F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules])
    return df.withColumn("violations", F.filter(marks, lambda m: m.isNotNull()))


def violation_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def first_errors(validated: DataFrame, order: str, keep: int = 10) -> DataFrame:
    """The first rows of each rule by order, with the rule's total; ranked within the rule, so memory stays bounded."""
    flat = validated.select(order, F.explode("violations").alias("rule"))
    totals = flat.groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(order))
    return flat.withColumn("rank", rank).where(F.col("rank") <= keep).join(totals, "rule")


def safe_long(column: Column) -> Column:
    """Whole part of a number, null where there is none."""
    return column.try_cast("bigint")


def safe_double(column: Column) -> Column:
    """Null for text, and for NaN, which isn't a missing value in Spark."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def truthy(column: Column, is_number: Column) -> Column:
    """Numbers other than zero; everything else, null and text included, is false."""
    return F.coalesce(is_number & (column.try_cast("double") != 0), F.lit(False))


def anomaly_class(column: Column, low: float = -50.0, high: float = 150.0) -> Column:
    """missing, non_numeric, impossible or valid; the bounds are valid."""
    value = column.try_cast("double")
    return (
        F.when(column.isNull(), "missing").when(value.isNull(), "non_numeric").when(value.between(low, high), "valid").otherwise("impossible")
    )


def null_anomalies(column: Column, low: float = -50.0, high: float = 150.0) -> Column:
    value = column.try_cast("double")
    return F.when(value.between(low, high), value)
