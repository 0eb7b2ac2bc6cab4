"""The human side of reconciliation: a review queue, decisions, learned mappings, usage and retraining figures.

A queue is a table (seq, raw_field, suggested_match, confidence_score); decisions are a table (seq, raw_field, action,
correction) with the action ``approve`` or ``correct``. A decision takes the first item of its name that is still pending; one
that finds none changes nothing. Queues and feedback are tables of any size: items and decisions of a name are numbered and
joined by name and number, so a name with very many items is split by the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import feedback as fb

QUEUE = ("seq", "raw_field", "suggested_match", "confidence_score")


def submit(scored: DataFrame, approve: float = 0.85) -> DataFrame:
    """The items that a reviewer must see: matched, but below the confidence that approves itself."""
    return scored.where(F.col("suggested_match").isNotNull() & (F.col("confidence_score") < approve)).select(*QUEUE)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("raw_field").orderBy("seq")))


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue with the action and correction that each item got; null where it is still pending."""
    made = _numbered(decisions).select("raw_field", "turn", "action", "correction")
    return _numbered(queue).join(made, ["raw_field", "turn"], "left").drop("turn")


def pending(decided: DataFrame) -> DataFrame:
    return decided.where("action is null").select(*QUEUE)


def as_feedback(decided: DataFrame) -> DataFrame:
    """The feedback rows that decisions append."""
    fixed = F.col("action") == "correct"
    done = decided.where("action is not null")
    return done.select("seq", "raw_field", "suggested_match", F.when(fixed, F.col("correction")).alias("human_correction"), F.when(fixed, "corrected").otherwise("approved").alias("feedback_type"), "confidence_score")


def settle(scored: DataFrame, decided: DataFrame, approve: float = 0.85) -> DataFrame:
    """The mapping after review: what approves itself, what was approved or corrected; the rest is left unmapped."""
    sure = scored.where((F.col("confidence_score") >= approve) & F.col("suggested_match").isNotNull())
    sure = sure.select("seq", "raw_field", F.col("suggested_match").alias("mapping"), F.lit("auto").alias("route"))
    seen = decided.select("seq", "raw_field", F.when(F.col("action") == "correct", F.col("correction")).when(F.col("action") == "approve", F.col("suggested_match")).alias("mapping"), F.coalesce("action", F.lit("pending")).alias("route"))
    none = scored.where("suggested_match is null").select("seq", "raw_field", F.lit(None).cast("string").alias("mapping"), F.lit("unmatched").alias("route"))
    return sure.unionByName(seen).unionByName(none)


def record_resolutions(feedback: DataFrame, resolutions: DataFrame) -> DataFrame:
    """feedback with accepted resolutions (seq, raw_field, match) appended as approvals of full confidence."""
    added = resolutions.where("match is not null").select("seq", "raw_field", F.col("match").alias("suggested_match"), F.lit(None).cast("string").alias("human_correction"), F.lit("approved").alias("feedback_type"), F.lit(1.0).alias("confidence_score"))
    return feedback.select(*added.columns).unionByName(added)


def cleared(feedback: DataFrame, before: Column) -> DataFrame:
    """feedback without what was given before an instant; what is left is written as a new table by the caller."""
    return feedback.where(F.col("ts") >= before)


def usage(resolved: DataFrame, method: str = "method", learned: tuple[str, ...] = ("learned", "fuzzy")) -> DataFrame:
    """Hits of learned mappings, fallbacks to scoring, and the share of hits."""
    hit = F.col(method).isin(*learned)
    return resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("fallbacks"), F.round(F.coalesce(F.try_divide(F.count_if(hit), F.count(F.lit(1))), F.lit(0.0)), 4).alias("hit_rate"))


def retraining_metrics(feedback: DataFrame) -> DataFrame:
    """Sizes of what retraining would use, one row per figure."""
    wrong = F.col("feedback_type") == "corrected"
    pattern = F.when(wrong, F.struct("suggested_match", "human_correction"))
    one = feedback.agg(
        F.count_if(wrong).alias("corrections"), F.countDistinct(pattern).alias("patterns"), F.count_if(wrong & (F.col("confidence_score") < 0.5)).alias("unsure"),
        F.count_if(wrong & (F.col("confidence_score") >= 0.5)).alias("sure_but_wrong"), F.countDistinct("suggested_match").alias("calibrated"),
    )
    return one.unpivot([], one.columns, "figure", "n")


def bias_items(feedback: DataFrame, most: int = 5) -> DataFrame:
    """Per confidence bucket the corrections seen first, as a list of at most ``most`` items (a report's feature)."""
    bucket = F.when(F.col("confidence_score") < 0.5, "low").otherwise("high")
    wrong = feedback.where("feedback_type = 'corrected'").withColumn("bucket", bucket)
    top = wrong.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))).where(F.col("place") <= most)
    item = F.format_string("%d %s %s", F.col("place"), "raw_field", "human_correction")
    return top.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("items"))


def retraining_plan(feedback: DataFrame, least: int = 5) -> DataFrame:
    """One row: whether there is enough feedback, the recommended threshold, what improvement to expect, and how often
    the commonest correction was made."""
    counted = feedback.agg(F.count(F.lit(1)).alias("n_records"))
    threshold = fb.recommended_threshold(fb.sweep(feedback))
    gain = fb.improvement(feedback).select("expected_error", "improvement_pct")
    worst = fb.bias(feedback).agg(F.max_by(F.struct("pattern", "n"), F.struct("n", "pattern")).alias("w"))
    rows = counted.crossJoin(threshold).crossJoin(gain).crossJoin(worst)  # one row each
    ready = F.col("n_records") >= least
    only = lambda c: F.when(ready, c)
    return rows.select(ready.alias("ready"), "n_records", only(F.col("threshold")).alias("threshold"), only(F.col("expected_error")).alias("expected_error"), only(F.col("improvement_pct")).alias("improvement_pct"), only(F.col("w.pattern")).alias("commonest"), only(F.col("w.n")).alias("times"))


def signed(body: Column) -> Column:
    """A report's text with its SHA-256, to be stored together."""
    return F.struct(body.alias("body"), F.sha2(body, 256).alias("signature"))


def report_body(plan: DataFrame) -> Column:
    """A retraining plan as one line of JSON with its keys in the order of the columns."""
    return F.to_json(F.struct(*plan.columns))


def change_over_time(points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Mean change of a value per unit of time between neighbouring points; zero for fewer than two."""
    by = Window.partitionBy(key).orderBy(at)
    step = points.withColumn("d", F.try_divide(F.col(value) - F.lag(value).over(by), F.col(at) - F.lag(at).over(by)))
    return step.groupBy(key).agg(F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("rate"))


def bundle(feedback: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: corrections per bin, change of the error rate, share of fields corrected."""
    bins = fb.minute_bins(feedback, key)
    share = feedback.groupBy(key).agg(F.round(fb.intervention_ratio(F.count_if(F.col("human_correction").isNotNull()), F.count(F.lit(1))), 6).alias("intervention_ratio"))
    return fb.fatigue(bins, key).join(fb.learning_rate(bins, key), key).join(share, key)
