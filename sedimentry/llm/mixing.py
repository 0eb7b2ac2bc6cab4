"""Mixing sources to target weights by Pareto order sampling.

Targets. A source's share of all words follows its weight; a target stops at ``most`` times the source's size and the
excess is shared again by weight. With sources sorted by cap/weight that water level has a closed form: the largest of
(total - caps before) / (weights from here on), a window over one row per source.

Sample. ``target / size`` splits into certain whole copies of every document and a fraction. For the fraction documents
are ranked by Pareto's order statistic, the random odds u/(1-u) divided by the inclusion odds, here proportional to the
square root of the document's size; the leading documents whose middle word lies within the residual target are taken,
so the sample has a fixed size in words. u comes from the MD5 of doc_id: reruns agree.

No source is ever ranked in one task. Ranks are cut into sqrt(documents) buckets, bucket sums give the bucket in which
the cut falls, and only that bucket's sqrt(documents) rows are ordered. The outcome is one threshold per source, applied
to the documents by a join with one row per source.

Edge cases: null or empty text has size 0 and is copied as often as certain copies ask; a null source is a source of its
own, ranked last; a null doc_id is hashed as the empty string; repeated rows share their rank and so their fate; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Above so many sources their table isn't broadcast; the join then shuffles, and Spark splits skewed partitions.
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(key: str, size: str) -> Column:
    """u/(1-u) over inclusion odds; null where there are no words to take."""
    x = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    u = (x.cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.when(F.col(size) > 0, u / (1.0 - u) / F.sqrt(F.col(size).cast("double")))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: __source, source_size, n_docs, target. sized: __source, __size."""
    per = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("__rank", rank).withColumn("__w", F.element_at(turn, F.pmod(F.col("__rank"), F.lit(len(weights))).cast("int") + 1))
    per = per.withColumn("__cap", F.col("source_size").cast("double") * float(most))
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    )
    per = per.withColumn("__level", level).withColumn("__level", F.max("__level").over(whole))
    return per.select("__source", "source_size", "n_docs", F.least("__cap", F.col("__level") * F.col("__w")).alias("target"))


def _bucket() -> Column:
    """Monotone in the key: 1 - 1/(1 + key * scale) is in [0, 1), near uniform when scale undoes the mean tilt."""
    scale = F.sqrt(F.col("source_size").cast("double") / F.col("n_docs"))
    return F.floor((1.0 - 1.0 / (1.0 + F.col("__key") * scale)) * F.ceil(F.sqrt(F.col("n_docs").cast("double"))))


def _beside(df: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    right = F.broadcast(per_source) if small else per_source
    other = right.withColumnRenamed("__source", "__of")
    return df.join(other, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")


def plan_mix(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, bool]:
    """Thresholds per source from sized (__id, __source, __size, __key); whether they are few enough to broadcast."""
    per = storage.store(source_targets(sized, weights, most), "targets")
    few = per.count() <= BROADCAST_SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("__whole", F.floor(ratio + 1e-12).cast("long"))
    per = per.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    ranked = _beside(sized.where("__key is not null"), per, few).withColumn("__bucket", _bucket())
    sums = ranked.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__words"))
    so_far = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = _beside(sums.withColumn("__end", F.sum("__words").over(so_far)), per.select("__source", "__rest"), few)
    # The bucket in which the residual target falls: the first whose end lies beyond it.
    cut = sums.where("__end > __rest").groupBy("__source").agg(F.min(F.struct("__bucket", (F.col("__end") - F.col("__words")).alias("b"))).alias("c"))
    cut = cut.select("__source", F.col("c.__bucket").alias("__cut"), F.col("c.b").alias("__before"))
    edge = _beside(ranked.select("__source", "__bucket", "__key", "__id", "__size", "__rest"), cut, few).where("__bucket = __cut")
    order = Window.partitionBy("__source").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("__upto", F.sum("__size").over(order) + F.col("__before"))
    edge = edge.where(F.col("__upto") - F.col("__size") / 2.0 <= F.col("__rest"))
    last = edge.groupBy("__source").agg(F.max(F.struct("__key", "__id")).alias("__last"))
    plan = _beside(_beside(per, cut.select("__source", "__cut"), few), last, few)
    return storage.store(plan, "thresholds"), few


def sized_documents(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    narrow = docs.select(F.col(key).alias("__id"), F.col(source).cast("string").alias("__source"), word_count(text).alias("__size"))
    return narrow.withColumn("__key", order_key("__id", "__size"))


def with_copies(sized: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """sized and any other columns, with target, source_size and copies (long)."""
    out = _beside(sized, plan, few).withColumn("__bucket", _bucket())
    taken = F.col("__key").isNotNull() & (F.col("__rest") > 0) & (
        F.col("__cut").isNull()
        | (F.col("__bucket") < F.col("__cut"))
        | ((F.col("__bucket") == F.col("__cut")) & F.coalesce(F.struct("__key", "__id") <= F.col("__last"), F.lit(False)))
    )
    return out.withColumn("copies", F.col("__whole") + F.when(taken, 1).otherwise(0))


def mix_report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = storage.store(sized_documents(docs, key, source, text), "sizes")
    plan, few = plan_mix(sized, weights, most)
    out = with_copies(sized, plan, few)
    return out.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of docs."""
    sized = storage.store(sized_documents(docs, key, source, text), "sizes")
    plan, few = plan_mix(sized, weights, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__id"), F.col(source).cast("string").alias("__source"), word_count(text).alias("__size"))
    out = with_copies(rows.withColumn("__key", order_key("__id", "__size")), plan, few)
    out = out.withColumn("__copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))))
    return out.select("__row.*")


ORACLE = r"""
with sized as (
  select doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w,
    source_size::double * 3.0 as cap, row_number() over (order by source nulls last) as r from per
), levels as (
  select *, (sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / w, r rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, r rows between unbounded preceding and 1 preceding), 0.0)) as level from weighed
), targets as (
  select source, source_size, least(cap, (max(level) over ()) * w) as target from levels
), split as (
  select *, case when source_size > 0 then floor(target / source_size + 1e-12)::bigint else 0 end as whole from targets
), keyed as (
  select s.doc_id, s.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size as rest, s.source,
    (('0x' || substr(md5(coalesce(s.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from sized s join split t on s.source is not distinct from t.source
), ranked as (
  select *, case when size > 0 then u / (1.0 - u) / sqrt(size::double) end as k from keyed
), summed as (
  select *, sum(size) over (partition by source order by k nulls last, doc_id rows between unbounded preceding and current row) as upto from ranked
)
select doc_id, size, source_size, target,
  ((whole + case when k is not null and rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end) * size)::bigint as taken from summed
"""
