"""Inputs that the queries derive from the driver's tables, each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Feedback rows from events: integer arithmetic decides type, correction and confidence.
FEEDBACK_SQL = """feedback as (
  select event_id as seq, ts, 'field_' || (user_id % 40)::varchar as raw_field, event_type as suggested_match,
    case when event_id % 10 in (6, 7, 8) then 'fix_' || (user_id % 3)::varchar end as human_correction,
    case when event_id % 10 < 6 then 'approved' when event_id % 10 < 9 then 'corrected' else 'rejected' end as feedback_type,
    ((event_id * 37) % 101)::double / 100.0 as confidence_score, 'user_' || (user_id % 7)::varchar as session_id
  from events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, last = table(spark, sf_dir, "events"), F.col("event_id") % 10
    text = lambda prefix, n: F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        text("field_", 40).alias("raw_field"),
        F.col("event_type").alias("suggested_match"),
        F.when(last.isin(6, 7, 8), text("fix_", 3)).alias("human_correction"),
        F.when(last < 6, "approved").when(last < 9, "corrected").otherwise("rejected").alias("feedback_type"),
        ((F.col("event_id") * 37) % 101 / F.lit(100.0)).alias("confidence_score"),
        text("user_", 7).alias("session_id"),
    )


#: Readings with planted nulls, text and impossible values.
READINGS_SQL = """readings as (
  select event_id, case when event_id % 50 = 0 then null when event_id % 33 = 0 then 'ERR' when event_id % 21 = 0 then '999'
    when event_id % 17 = 0 then '-273' else round(value, 2)::varchar end as reading,
    case when event_id % 13 = 0 then null else user_id end as unit, case when event_id % 19 = 0 then '' else event_type end as code,
    case when event_id % 7 = 0 then null else value end as level
  from events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    raw = F.when(n % 50 == 0, F.lit(None).cast("string")).when(n % 33 == 0, "ERR").when(n % 21 == 0, "999").when(n % 17 == 0, "-273")
    return table(spark, sf_dir, "events").select(
        n,
        F.when((n % 50 == 0) | (n % 33 == 0) | (n % 21 == 0) | (n % 17 == 0), raw).otherwise(F.round("value", 2).cast("string")).alias("reading"),
        F.when(n % 13 != 0, F.col("user_id")).alias("unit"),
        F.when(n % 19 == 0, "").otherwise(F.col("event_type")).alias("code"),
        F.when(n % 7 != 0, F.col("value")).alias("level"),
    )


#: Target names, in order, and messy names made from part types.
TARGETS = ("speed", "engine_rpm", "heart_rate", "brake_temperature", "tyre_pressure", "throttle", "steel", "copper", "brass", "polished")


def targets_sql() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TARGETS))
    return f"targets(idx, target) as (values {rows})"


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TARGETS)), "idx int, target string")


NAMES_SQL = "names as (select distinct lower(replace(p_type, ' ', '_')) as raw from part union select distinct event_type as raw from events)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("raw"))
    return parts.unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("raw"))).distinct()


PATTERN_SQL = """case when lower(target) = lower(raw) then 1.0::double
    when contains(lower(raw), lower(target)) or contains(lower(target), lower(raw)) then 0.8::double
    when length(target) >= 5 and length(raw) >= 5 and left(lower(target), 3) = left(lower(raw), 3) and right(lower(target), 2) = right(lower(raw), 2) then 0.6::double
    when regexp_replace(lower(target), '[^aeiou]', '', 'g') = regexp_replace(lower(raw), '[^aeiou]', '', 'g')
      and length(regexp_replace(lower(target), '[^aeiou]', '', 'g')) >= 2 then 0.5::double else 0.0::double end"""
