"""Analytics over reviewer feedback: seq, ts, raw_field, suggested_match, human_correction, feedback_type, confidence_score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("approved", "corrected", "rejected")
#: The swept thresholds.
THRESHOLDS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)


def _share(condition: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(F.count_if(condition), F.count(F.lit(1))), F.lit(0.0)), digits)


def record(feedback: DataFrame) -> DataFrame:
    """Adds is_correction and rejects unknown types when the plan runs."""
    known = F.when(F.col("feedback_type").isin(*TYPES), F.col("feedback_type")).otherwise(F.raise_error(F.lit("unknown feedback type")).cast("string"))
    checked = feedback.withColumn("feedback_type", known).withColumn("confidence_score", F.round("confidence_score", 4))
    return checked.withColumn("is_correction", F.col("human_correction").isNotNull())


def consensus(feedback: DataFrame, least: float = 0.8) -> DataFrame:
    """Winning vote per raw field. Rejections don't vote but count in the ratio; ties go to the vote seen first."""
    vote = F.coalesce(F.when(F.col("human_correction") != "", F.col("human_correction")), F.col("suggested_match"))
    cast = feedback.withColumn("vote", F.when(F.col("feedback_type").isin("approved", "corrected"), vote))
    votes = cast.groupBy("raw_field", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    per = votes.groupBy("raw_field").agg(
        F.sum("n").alias("total"),
        F.max_by(F.struct("vote", "n"), F.when(F.col("vote").isNotNull(), F.struct("n", -F.col("first")))).alias("best"),
    )
    ratio = F.col("best.n") / F.col("total")
    return per.where(F.col("best.vote").isNotNull() & (ratio >= least)).select("raw_field", F.col("best.vote").alias("mapping"), F.round(ratio, 4).alias("agreement"))


def statistics(feedback: DataFrame) -> DataFrame:
    kinds = {t: F.col("feedback_type") == t for t in TYPES}
    counts = [F.count_if(c).alias(f"n_{t}") for t, c in kinds.items()]
    rates = [_share(c).alias(f"{t}_rate") for t, c in kinds.items()]
    means = [F.round(F.coalesce(F.avg(F.when(c, F.col("confidence_score"))), F.lit(0.0)), 6).alias(f"{t}_confidence") for t, c in kinds.items()]
    return feedback.agg(F.count(F.lit(1)).alias("total"), *counts, *rates, F.countDistinct("raw_field").alias("n_fields"), *means)


def bias(feedback: DataFrame) -> DataFrame:
    """How often a suggestion was corrected to what."""
    wrong = feedback.where("feedback_type = 'corrected'")
    return wrong.groupBy(F.concat_ws(" -> ", "suggested_match", "human_correction").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def bias_buckets(feedback: DataFrame) -> DataFrame:
    bucket = F.when(F.col("confidence_score") < 0.5, "low").otherwise("high").alias("bucket")
    return feedback.where("feedback_type = 'corrected'").groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def calibration(feedback: DataFrame) -> DataFrame:
    approved = (F.col("feedback_type") == "approved").cast("double")
    return feedback.groupBy("suggested_match").agg(F.round(F.avg(approved) * 1.5, 6).alias("factor"))


def sweep(feedback: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Accuracy and coverage at every threshold in one pass: each row feeds the thresholds that it reaches."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("confidence_score"))
    total = feedback.agg(F.count(F.lit(1)).alias("all"))
    flat = feedback.select((F.col("feedback_type") == "approved").alias("ok"), F.explode(reached).alias("threshold"))
    per = flat.groupBy("threshold").agg(F.count_if("ok").alias("good"), F.count(F.lit(1)).alias("n"))
    out = per.crossJoin(F.broadcast(total))
    return out.select("threshold", F.round(F.col("good") / F.col("n"), 4).alias("accuracy"), F.round(F.col("n") / F.col("all"), 4).alias("coverage"))


def recommended_threshold(swept: DataFrame) -> DataFrame:
    """Highest rounded accuracy; ties go to the lowest threshold."""
    return swept.agg(F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("threshold"))


def improvement(feedback: DataFrame, least: int = 10) -> DataFrame:
    one = feedback.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback_type") == "corrected").alias("fixed"))
    error = F.col("fixed") / F.col("n")
    gain = F.least(0.8 * error, F.lit(0.15))
    enough = F.col("n") >= least
    return one.select(
        "n",
        F.when(enough, F.round(error, 4)).alias("error"),
        F.when(enough, F.round(error - gain, 4)).alias("expected_error"),
        F.when(enough, F.round(F.coalesce(F.try_divide(gain, error), F.lit(0.0)) * 100, 1)).alias("improvement_pct"),
        F.when(~enough, "insufficient").when(F.col("fixed") > 20, "high").when(F.col("fixed") > 10, "medium").otherwise("low").alias("trust"),
    )


def history(feedback: DataFrame, raw_field: str) -> DataFrame:
    """Newest first; rows of one instant keep their order of arrival."""
    return feedback.where(F.col("raw_field") == raw_field).orderBy(F.col("ts").desc(), "seq")


def route(confidence: Column, match: Column, reviewer: bool, approve: float = 0.85) -> Column:
    low = F.lit("review" if reviewer else "accepted_silently")
    return F.when(match.isNull(), "unmatched").when(confidence >= approve, "auto_approved").otherwise(low)


def level(confidence: Column) -> Column:
    return F.when(confidence < 0.45, "critical").when(confidence <= 0.7, "warning").otherwise("safe")


def minute_bins(feedback: DataFrame, key: str = "session_id") -> DataFrame:
    """Corrections per minute since the session's first row. Empty minutes don't exist; each filled one counts as one."""
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    began = feedback.groupBy(key).agg(F.min(secs).alias("t0"))
    rows = feedback.join(began, key).withColumn("minute", F.floor((secs - F.col("t0")) / 60))
    per = rows.groupBy(key, "minute").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback_type") == "corrected").alias("fixed"))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("minute")) - 1
    return per.withColumn("ordinal", ordinal).withColumn("error_rate", F.col("fixed") / F.col("n"))


def fatigue(bins: DataFrame, key: str = "session_id") -> DataFrame:
    return bins.groupBy(key).agg(F.round(F.sum("fixed") / F.count(F.lit(1)), 6).alias("fatigue"))


def learning_rate(bins: DataFrame, key: str = "session_id") -> DataFrame:
    """Mean change of the error rate from bin to bin; zero for fewer than two bins."""
    before = F.lag("error_rate").over(Window.partitionBy(key).orderBy("ordinal"))
    change = bins.withColumn("change", F.col("error_rate") - before)
    return change.groupBy(key).agg(F.round(F.coalesce(F.avg("change"), F.lit(0.0)), 6).alias("learning_rate"))


def intervention_ratio(fixes: Column, fields: Column) -> Column:
    return F.when(fields > 0, fixes / fields).otherwise(0.0)
