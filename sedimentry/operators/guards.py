"""Checks and shapes at the door: batches, preconditions, documents of several shapes, names, snapshots, timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmptyBatch(ValueError):
    """A batch without rows."""


def non_empty(df: DataFrame) -> DataFrame:
    """df, or an error if it has no rows; reads one row at most."""
    if df.isEmpty():
        raise EmptyBatch("the batch has no rows")
    return df


def require(text: Column, part: str) -> Column:
    """text; a row without part fails the query when it runs."""
    return F.when(F.contains(text, F.lit(part)), text).otherwise(F.raise_error(F.concat(F.lit(f"no {part!r} in: "), F.coalesce(text, F.lit("null")))).cast("string"))


def split_on(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and those that don't or where it is unknown."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def records_of(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per record of a column that holds a record, a list of records, or records by key; the key becomes a column.
    Lists and single records have no key. The shape is read off the schema, so no row is looked at."""
    kind, rest = df.schema[column].dataType, [c for c in df.columns if c != column]
    if isinstance(kind, T.MapType):
        return df.select(*rest, F.explode(column).alias(key, "__r")).select(*rest, key, "__r.*")
    if isinstance(kind, T.ArrayType):
        df, column = df.select(*rest, F.explode(column).alias("__r")), "__r"
    elif not isinstance(kind, T.StructType):
        raise TypeError(f"{column} holds no records")
    return df.select(*rest, F.lit(None).cast("string").alias(key), f"{column}.*")


def visible(size: Column, width: Column, top: Column, fold: float = 900.0) -> Column:
    """Whether an element of a page can be seen: it has letters, a width, and begins above the fold."""
    return F.coalesce((size > 0) & (width > 0) & (top < fold), F.lit(False))


def tidied(text: Column) -> Column:
    """Trimmed and in capitals; null if nothing is left."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that names lists, under their new names, in its order; those that df lacks are left out."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items() if old in df.columns])


def display(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df under display names; columns without one keep theirs."""
    return df.withColumnsRenamed(names)


def snapshot(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """One row: column names, number of rows, and the hash of the first rows in a stated order. It identifies a sample, not the
    content."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns])
    first = df.orderBy(order).limit(rows).select(F.col(order).alias("__o"), text.alias("__t"))
    sample = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__t"))), lambda x: x["__t"]), "\n").alias("s"))
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.crossJoin(sample).select(F.lit(",".join(df.columns)).alias("columns"), "n_rows", F.sha2("s", 256).alias("sample_hash"))  # one row each


def first_rows(df: DataFrame, order: str, rows: int) -> DataFrame:
    return df.orderBy(order).limit(rows)


def timing(runs: DataFrame, took: Column, ok: Column, confidence: Column, *keys: str) -> DataFrame:
    """Mean, least, most and spread of times, share of successes, mean confidence, and runs per unit of time."""
    return runs.groupBy(*keys).agg(
        F.round(F.avg(took), 6).alias("mean"), F.min(took).alias("least"), F.max(took).alias("most"), F.round(F.stddev_samp(took), 6).alias("spread"),
        F.round(F.avg(ok.cast("double")) * 100, 4).alias("success_pct"), F.round(F.avg(confidence), 6).alias("confidence"), F.round(F.try_divide(F.count(F.lit(1)), F.sum(took)), 6).alias("per_unit"),
    )


def auditability(valid: Column) -> Column:
    return F.when(valid, 1.0).otherwise(0.0)


def count_by_kind(df: DataFrame, kind: Column, kinds: tuple[str, ...]) -> DataFrame:
    """Rows per kind, with a zero for every listed kind that doesn't occur."""
    flags = [F.count_if(kind == k).alias(k) for k in kinds]
    return df.agg(*flags).unpivot([], list(kinds), "kind", "n")


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample spread, least, quartiles and most of a column, exact."""
    c = F.col(column)
    q = lambda p: F.percentile(c, p)
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("spread"), F.min(c).alias("least"), *[F.round(q(p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.max(c).alias("most"))


def override(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows that changes gives for the same keys in place of its own, and its new keys added."""
    return base.join(changes.select(key).distinct(), key, "left_anti").select(*changes.columns).unionByName(changes)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def register_functions(spark: SparkSession) -> tuple[str, ...]:
    """Scoring and cleaning functions for SQL, as SQL functions that the optimizer sees through; returns their names."""
    made = {
        "safe_number(x string) returns double": "try_cast(trim(x) as double)",
        "review_level(c double) returns string": "case when c < 0.45 then 'critical' when c <= 0.7 then 'warning' else 'safe' end",
        "edit_share(a string, b string) returns double": "1.0 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b), 1)",
    }
    for head, body in made.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return tuple(head.split("(")[0] for head in made)
