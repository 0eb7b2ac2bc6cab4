"""The registered queries of the operators in this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, lengths, licenses, mixing, pii, quality, substrings, suffixes, tokenbin


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 5, 2, 1 by source."""
    return mixing.mix_report(documents(spark, sf_dir))


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after substring dedup."""
    return substrings.report(documents(spark, sf_dir))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality.report(documents(spark, sf_dir))


def op8_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left after suffix-array dedup."""
    return suffixes.report(documents(spark, sf_dir))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals at every distinct token length of the documents."""
    return lengths.token_counts(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license templates in every document."""
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the license scan, which SQL can express; -1 where there is no place."""
    return licenses.license_scan(documents(spark, sf_dir)).select(*licenses.BASE).fillna(-1, ["first_word", "last_word"])


def op5_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets reach Jaccard 0.8."""
    return jaccard.similarity_components(documents(spark, sf_dir))


def op6_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_personal_data(documents(spark, sf_dir))


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as Huffman-coded files and read back."""
    return tokenbin.round_trip(documents(spark, sf_dir))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in the documents, as asked or with other numbers, names and units."""
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_license_scan": op2_license_scan,
    "license_base_places": license_base_places,
    "op3_suffix_trees": op3_suffix_trees,
    "op4_quality_cascade": op4_quality_cascade,
    "op5_partition_join": op5_partition_join,
    "op6_lstm_crf": op6_lstm_crf,
    "op7_huffman_ids": op7_huffman_ids,
    "op8_suffix_merge": op8_suffix_merge,
    "op9_length_histogram": op9_length_histogram,
    "op10_template_leaks": op10_template_leaks,
}
ORACLES = {"op1_pareto_mix": mixing.ORACLE, "license_base_places": licenses.BASE_ORACLE, "op4_quality_cascade": quality.ORACLE}
