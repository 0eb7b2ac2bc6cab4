"""Hash-chained provenance. Hashing is row-local; only the link to the predecessor needs an order, within a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "genesis"


def canonical(*columns: str) -> Column:
    """Fields in a fixed order, separated, nulls visible: no two different rows share a string."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def row_hash(*columns: str) -> Column:
    return F.sha2(canonical(*columns), 256)


def build(rows: DataFrame, chain: str, order: str, *columns: str, bind: bool = False) -> DataFrame:
    """Adds transaction_hash and previous_hash, 'genesis' at the start of each chain.

    bind=True also covers the predecessor's content hash, so a record can't be moved to another place unnoticed.
    """
    by = Window.partitionBy(chain).orderBy(order)
    out = rows.withColumn("transaction_hash", row_hash(*columns))
    out = out.withColumn("previous_hash", F.coalesce(F.lag("transaction_hash").over(by), F.lit(GENESIS)))
    if bind:
        out = out.withColumn("link_hash", F.sha2(F.concat_ws("|", "previous_hash", "transaction_hash"), 256))
    return out


def check(log: DataFrame, chain: str, order: str, *columns: str) -> DataFrame:
    """Each record with content_ok and link_ok."""
    by = Window.partitionBy(chain).orderBy(order)
    expected = F.coalesce(F.lag("transaction_hash").over(by), F.lit(GENESIS))
    return log.withColumn("link_ok", F.col("previous_hash") == expected).withColumn("content_ok", F.col("transaction_hash") == row_hash(*columns))


def verdict(checked: DataFrame, chain: str, order: str) -> DataFrame:
    """One row per chain: records, whether it is valid, the first broken record."""
    bad = ~(F.col("link_ok") & F.col("content_ok"))
    return checked.groupBy(chain).agg(
        F.count(F.lit(1)).alias("records"), (F.count_if(bad) == 0).alias("valid"), F.min(F.when(bad, F.col(order))).alias("first_broken")
    )


def sequential(rows: DataFrame, chain: str, order: str, payload: str, segment: int = 1024) -> DataFrame:
    """A true chain: each hash covers the one before. A chain is folded in segments of so many records, each from an empty start,
    and the heads of the segments are folded again, so no row holds more than a segment or a chain's heads."""
    fold = lambda xs: F.aggregate(xs, F.lit(""), lambda last, x: F.sha2(F.concat(last, F.lit("|"), x["p"]), 256))
    listed = lambda at, what: F.array_sort(F.collect_list(F.struct(F.col(at).alias("o"), F.col(what).alias("p"))))
    place = F.row_number().over(Window.partitionBy(chain).orderBy(order)) - 1
    numbered = rows.select(chain, F.col(order).alias("__o"), F.col(payload).alias("__p"), F.floor(place / segment).alias("__s"))
    heads = numbered.groupBy(chain, "__s").agg(F.count(F.lit(1)).alias("__n"), fold(listed("__o", "__p")).alias("__h"))
    return heads.groupBy(chain).agg(F.sum("__n").alias("records"), fold(listed("__s", "__h")).alias("head"))


def audit_text(stats: DataFrame, scope: str) -> DataFrame:
    """A line of an audit report from ``statistics``; figures that don't exist read n/a."""
    number = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("n/a"))
    shown = {c: F.when(F.col(c).isNull(), "n/a").otherwise(number(F.col(c))) for c in ("mean", "low", "high")}
    line = F.concat(F.lit("records: "), F.col("n").cast("string"), F.lit(", mean "), shown["mean"], F.lit(", from "), shown["low"], F.lit(" to "), shown["high"])
    return stats.select(F.lit(scope).alias("scope"), line.alias("line"))


def statistics(log: DataFrame, value: str = "confidence") -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(f(value), 6).alias(name) for name, f in (("mean", F.avg), ("low", F.min), ("high", F.max), ("spread", F.stddev_samp))],
    )
