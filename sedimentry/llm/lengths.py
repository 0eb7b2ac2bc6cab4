"""Token counts: an exact length histogram, and suffix sums over it for every context limit.

Documents are aggregated by encoded length, so everything after the one pass over the texts works on distinct lengths.
Suffix sums are taken at two levels (within blocks of lengths, then over block totals), so no task sorts all lengths.
For a context limit L the histogram answers: documents longer than L, tokens in documents up to L, and the total when
every document is cut to L, which is the tokens of shorter documents plus L for each longer one.

Edge cases: a null or empty text has length 0 and counts as a document; ties and repeated rows add up; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage, tokens

BLOCK = 256


def encoded_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_tokens: int = 0) -> DataFrame:
    """doc_id, n_tokens of every whole text."""
    path = path or tokens.default_path()

    def run(batches):
        for batch in batches:
            enc = tokens.encoder(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), storage.longs([len(x) // 4 + end_tokens for x in enc.encode(batch.column(1))])], ["doc_id", "n_tokens"])

    return storage.map_batches(storage.text_column(docs, key, text), run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct length taken as the context limit, exact for that limit; any limit between two lengths has
    the counts of the lower one (see truncated_total)."""
    hist = storage.store(hist.withColumn("__block", F.floor(F.col("n_tokens") / block)), "lengths")
    blocks = hist.groupBy("__block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    after = Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "__block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("__docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("__tokens_after"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("__block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(blocks, "__block")
    over_docs = F.col("__docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    over_tokens = F.col("__tokens_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0))
    out = out.withColumn("docs_over", over_docs).withColumn("tokens_over", over_tokens)
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_over",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length at which at least q of the documents fit (column n_tokens)."""
    return table.where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to limit (column tokens), for any limit."""
    low = table.where(F.col("context_limit") <= limit).agg(F.max(F.struct("context_limit", "docs_over", "tokens_within")).alias("x"))
    total = table.agg(F.first(F.col("docs_within") + F.col("docs_over")).alias("n"))
    return low.crossJoin(total).select(
        (F.coalesce(F.col("x.tokens_within"), F.lit(0)) + limit * F.coalesce(F.col("x.docs_over"), F.col("n"), F.lit(0))).alias("tokens")
    )


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    return limits(histogram(encoded_lengths(docs, key, text, path)))
