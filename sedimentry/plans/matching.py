"""Queries: name matching and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import drift, feedback, reconcile
from ..session import table
from . import fixtures as fx

#: How the flagship query's source spells the columns of events.
MESSY = {"event_id": "EVENT_ID", "ts": "ts", "user_id": "user_id_v2", "event_type": "event_type_log", "value": "raw_value"}
GOLD = ["event_id", "ts", "user_id", "event_type", "value"]


def semantic_align_stats(spark, sf_dir):
    messy = table(spark, sf_dir, "events").select(*[F.col(k).alias(v) for k, v in MESSY.items()])
    found = reconcile.resolve_columns(messy.columns, GOLD, reconcile.python_pattern_score)
    clean = reconcile.apply_mapping(messy, found)
    v = F.col("value")
    return clean.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_samp(v), 6).alias("spread")
    )


def pattern_match_top1(spark, sf_dir):
    return reconcile.best_match(fx.names(spark, sf_dir), fx.targets(spark), reconcile.pattern_score)


def levenshtein_top1(spark, sf_dir):
    best = reconcile.best_match(fx.names(spark, sf_dir), fx.targets(spark), reconcile.edit_score)
    return best.withColumn("confidence", F.round("confidence", 6))


def ratio_match_top1(spark, sf_dir):
    best = reconcile.best_match(fx.names(spark, sf_dir), fx.targets(spark), lambda t, r: text.ratio(t, r))
    return best.withColumn("confidence", F.round("confidence", 6))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    gold = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("g"), F.min("vec_id").alias("gold_id"))
    return e.select("vec_id", "embedding"), gold.select(F.col("label").alias("idx"), F.concat(F.lit("t"), "label").alias("target"), "g", "gold_id")


def _embedding_scores(spark, sf_dir):
    raw, gold = _vectors(spark, sf_dir)
    rest = raw.join(gold.select(F.col("gold_id").alias("vec_id")), "vec_id", "left_anti")
    return reconcile.best_vector(rest, gold)


def embedding_top1_threshold(spark, sf_dir):
    return reconcile.accept(_embedding_scores(spark, sf_dir), 0.45)


def strict_fuzzy_accept(spark, sf_dir):
    return reconcile.accept(_embedding_scores(spark, sf_dir), 0.7, strict=True)


def tiered_resolve(spark, sf_dir):
    raw = fx.names(spark, sf_dir)
    learned = raw.where(F.length("raw") % 5 == 0).select("raw", F.concat(F.lit("known_"), F.left("raw", F.lit(4))).alias("target"))
    scored = reconcile.accept(reconcile.best_match(raw, fx.targets(spark), reconcile.pattern_score), 0.45)
    return reconcile.tiered(raw, learned, scored)


def confidence_sweep(spark, sf_dir):
    levels = (0.3, 0.4, 0.45, 0.5, 0.6)
    one = _embedding_scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(F.col("confidence") >= t).alias(str(i)) for i, t in enumerate(levels)])
    flat = one.select("n_all", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(i)).alias("n")) for i, t in enumerate(levels)])).alias("x"))
    return flat.where("x.n > 0").select("x.threshold", "x.n", F.round(F.col("x.n") / F.col("n_all"), 6).alias("share"))


def review_routing(spark, sf_dir):
    s = reconcile.accept(_embedding_scores(spark, sf_dir), 0.45)
    with_reviewer = feedback.route(F.col("confidence"), F.col("match"), True).alias("route")
    without = feedback.route(F.col("confidence"), F.col("match"), False).alias("route_without_reviewer")
    return s.groupBy(with_reviewer, without).agg(F.count(F.lit(1)).alias("n"))


def ui_levels(spark, sf_dir):
    return _embedding_scores(spark, sf_dir).groupBy(feedback.level(F.col("confidence")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def name_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", "name", drift.add_noise(F.col("name"), k).alias("noisy"), drift.cut(F.col("name"), k).alias("short"), drift.kind_of(k).alias("kind")
    )


def token_synonyms(spark, sf_dir):
    words = {"steel": "alloy", "copper": "cu", "brass": "cuzn", "small": "tiny", "large": "big"}
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))
    return p.select("p_partkey", drift.swap_tokens(F.col("name"), words).alias("swapped"))


def dropped_characters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", drift.drop_characters(F.lower("p_type"), F.col("p_partkey")).alias("name"))


def _mock(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))
    k = F.col("p_partkey")
    p = p.withColumn("raw", drift.add_noise(F.col("name"), k)).withColumn("kind", drift.kind_of(k))
    p = p.withColumn("match", F.left("raw", F.lit(15))).withColumn("confidence", F.least(0.75 + F.length("raw") % 10 * 0.025, F.lit(1.0)))
    return p.withColumn("correct", F.col("match") == F.col("name"))


def mock_resolver_accuracy(spark, sf_dir):
    return _mock(spark, sf_dir).agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"))


def match_metrics_by_entropy(spark, sf_dir):
    m = _mock(spark, sf_dir)
    rows = m.select("kind", "correct", "confidence", F.lit("prefix").alias("method"))
    score = reconcile.pattern_score(F.col("name"), F.col("raw"))
    rows = rows.unionByName(m.select("kind", (score >= 0.8).alias("correct"), score.alias("confidence"), F.lit("pattern").alias("method")))
    return drift.match_metrics(rows)


def chaos_toggle(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", drift.toggled(F.col("event_id"), 50).alias("active"))


_P = "(select p_partkey, lower(replace(p_type, ' ', '_')) as name from part)"
_NOISY = """case when p_partkey % 2 = 0 then name || ['_s1', '_logged', '_b', '_alt'][(p_partkey % 4 + 1)::int]
  else ['in_', 'dev_', 'k_'][(p_partkey % 3 + 1)::int] || name end"""
_KIND = "case when (p_partkey * 37) % 100 < 40 then 'synonyms' when (p_partkey * 37) % 100 < 75 then 'noise' else 'truncation' end"
_TOP = "with {ctes}, scored as (select raw, target, idx, {score} as s from names cross join targets), ranked as (select *, row_number() over (partition by raw order by s desc, idx) as rn from scored)"
_EMB = """with gold as (select label as idx, 't' || label::varchar as target, min_by(embedding, vec_id) as g, min(vec_id) as gold_id from embeddings group by label),
rest as (select vec_id, embedding from embeddings where vec_id not in (select gold_id from gold)),
scored as (select vec_id, target, idx, round(list_cosine_similarity(embedding::double[], g::double[]), 6) as s from rest cross join gold),
best as (select vec_id, target as match, s as confidence from (select *, row_number() over (partition by vec_id order by s desc, idx) as rn from scored) where rn = 1)"""
_MOCK = f"""with noisy as (select p_partkey, name, {_NOISY} as raw, {_KIND} as kind from {_P}),
mock as (select *, left(raw, 15) = name as correct, least(0.75::double + (length(raw) % 10) * 0.025::double, 1.0::double) as confidence from noisy)"""

QUERIES = {f.__name__: f for f in (
    semantic_align_stats, pattern_match_top1, levenshtein_top1, ratio_match_top1, embedding_top1_threshold, strict_fuzzy_accept, tiered_resolve, confidence_sweep,
    review_routing, ui_levels, name_drift, token_synonyms, dropped_characters, mock_resolver_accuracy, match_metrics_by_entropy, chaos_toggle,
)}

_top_ctes = f"{fx.NAMES_SQL}, {fx.targets_sql()}"
ORACLES = {
    "semantic_align_stats": "select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high, round(stddev_samp(value), 6) as spread from events group by event_type",
    "pattern_match_top1": _TOP.format(ctes=_top_ctes, score=fx.PATTERN_SQL) + " select raw, target as match, s as confidence from ranked where rn = 1",
    "levenshtein_top1": _TOP.format(ctes=_top_ctes, score="1.0::double - levenshtein(lower(target), lower(raw))::double / greatest(length(target), length(raw), 1)::double") + " select raw, target as match, round(s, 6) as confidence from ranked where rn = 1",
    "embedding_top1_threshold": _EMB + " select vec_id, case when confidence >= 0.45 then match end as match, confidence from best",
    "strict_fuzzy_accept": _EMB + " select vec_id, case when confidence > 0.7 then match end as match, confidence from best",
    "tiered_resolve": _TOP.format(ctes=_top_ctes, score=fx.PATTERN_SQL) + """, f as (select raw, case when s >= 0.45 then target end as match, s from ranked where rn = 1),
      l as (select raw, 'known_' || left(raw, 4) as target from names where length(raw) % 5 = 0)
      select n.raw, coalesce(l.target, f.match) as match, case when l.target is not null then 1.0::double else f.s end as confidence,
        case when l.target is not null then 'learned' when f.match is not null then 'scored' else 'none' end as method
      from names n left join l on n.raw = l.raw left join f on n.raw = f.raw""",
    "confidence_sweep": _EMB + """ select t as threshold, count(*) as n, round(count(*)::double / (select count(*) from best), 6) as share
      from best join (select unnest([0.3, 0.4, 0.45, 0.5, 0.6]::double[]) as t) on confidence >= t group by t""",
    "review_routing": _EMB + """, r as (select case when confidence < 0.45 then 'unmatched' when confidence >= 0.85 then 'auto_approved' else 'review' end as route from best)
      select route, case when route = 'review' then 'accepted_silently' else route end as route_without_reviewer, count(*) as n from r group by 1, 2""",
    "ui_levels": _EMB + " select case when confidence < 0.45 then 'critical' when confidence <= 0.7 then 'warning' else 'safe' end as level, count(*) as n from best group by 1",
    "name_drift": f"select p_partkey, name, {_NOISY} as noisy, case when length(name) > 3 then left(name, (3 + p_partkey % (length(name) - 3))::int) else name end as short, {_KIND} as kind from {_P}",
    "token_synonyms": f"""select p_partkey, array_to_string(list_transform(string_split(name, '_'), lambda t: case t when 'steel' then 'alloy' when 'copper' then 'cu' when 'brass' then 'cuzn'
      when 'small' then 'tiny' when 'large' then 'big' else t end), '_') as swapped from {_P}""",
    "dropped_characters": """with n as (select p_partkey, lower(p_type) as name, length(p_type) as len from part)
      select p_partkey, case when len > 3 then array_to_string([substr(name, i::int + 1, 1) for i in range(len) if (i * 7 + p_partkey * 3) % len >= p_partkey % greatest(least(3, len - 2), 1) + 1], '') else name end as name from n""",
    "mock_resolver_accuracy": _MOCK + " select round(avg(correct::int::double), 6) as accuracy, round(avg(confidence), 6) as confidence from mock",
    "match_metrics_by_entropy": _MOCK + f""", scored as (select *, {fx.PATTERN_SQL.replace("target", "name")} as s from mock),
      rows_ as (select 'prefix' as method, kind, correct, confidence from mock union all select 'pattern', kind, s >= 0.8, s from scored)
      select method, kind, round(avg(correct::int::double), 6) as accuracy, round(avg(confidence), 4) as confidence, count(*) as n from rows_ group by grouping sets ((method), (method, kind))""",
    "chaos_toggle": "select event_id, (event_id // 50) % 2 = 1 as active from events",
}
