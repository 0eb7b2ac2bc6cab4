"""Queries: the review loop, retraining, guards, snapshots, drift generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, feedback, guards, reconcile, review, telemetry
from ..session import table
from . import fixtures as fx
from .insight import _CHAIN, _F, _log, _FIELDS
from .matching import _EMB, _NOISY, _P, _vectors

# --- review loop -----------------------------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    return fx.feedback(spark, sf_dir).select("seq", "raw_field", F.when(F.col("seq") % 23 != 0, F.col("suggested_match")).alias("suggested_match"), "confidence_score")


def _decided(spark, sf_dir):
    """Every third item's name is decided, and a name that isn't in the queue."""
    f = fx.feedback(spark, sf_dir)
    action = F.when(F.col("seq") % 2 == 0, "approve").otherwise("correct")
    made = f.where("seq % 3 = 0").select("seq", F.when(F.col("seq") % 99 == 0, "unknown").otherwise(F.col("raw_field")).alias("raw_field"), action.alias("action"), F.concat(F.lit("fix_"), (F.col("seq") % 5).cast("string")).alias("correction"))
    return review.decide(review.submit(_scored(spark, sf_dir)), made)


def review_pending(spark, sf_dir):
    return review.pending(_decided(spark, sf_dir))


def review_feedback(spark, sf_dir):
    return review.as_feedback(_decided(spark, sf_dir))


def reviewed_mapping(spark, sf_dir):
    return review.settle(_scored(spark, sf_dir), _decided(spark, sf_dir))


def learned_after_resolutions(spark, sf_dir):
    f = fx.feedback(spark, sf_dir)
    accepted = f.where("seq % 4 = 1").select("seq", "raw_field", F.when(F.col("seq") % 12 != 1, F.lit("resolved")).alias("match"))
    return feedback.consensus(review.record_resolutions(f, accepted), 0.1)


def vector_tiers(spark, sf_dir):
    """Exact learned keys, then learned vectors above a cosine of 0.7, then target vectors from 0.45 on."""
    raw, gold = _vectors(spark, sf_dir)
    exact = raw.where("vec_id % 50 = 3").select("vec_id", F.concat(F.lit("known_"), F.col("vec_id").cast("string")).alias("learned"))
    known = gold.where("idx % 2 = 0").select(F.concat(F.lit("learned_"), "target").alias("target"), "idx", "g")
    rest = raw.join(gold.select(F.col("gold_id").alias("vec_id")), "vec_id", "left_anti")
    fuzzy = reconcile.accept(reconcile.best_vector(rest, known), 0.7, strict=True)
    plain = reconcile.accept(reconcile.best_vector(rest, gold), 0.45)
    return reconcile.tiers(rest.select("vec_id"), exact, fuzzy, plain, "vec_id")


def translator_usage(spark, sf_dir):
    return review.usage(vector_tiers(spark, sf_dir))


def retraining_metrics(spark, sf_dir):
    return review.retraining_metrics(fx.feedback(spark, sf_dir))


def bias_item_lists(spark, sf_dir):
    return review.bias_items(fx.feedback(spark, sf_dir))


def retraining_plan(spark, sf_dir):
    return review.retraining_plan(fx.feedback(spark, sf_dir))


def signed_report(spark, sf_dir):
    """Figures of the feedback as a line of text with its signature."""
    m = review.retraining_metrics(fx.feedback(spark, sf_dir))
    body = F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%d", "figure", "n"))), ";")
    return m.agg(body.alias("b")).select(review.signed(F.col("b")).alias("r")).select("r.body", "r.signature")


def rate_over_time(spark, sf_dir):
    """Change of the error rate per minute between the bins of a session."""
    bins = feedback.minute_bins(fx.feedback(spark, sf_dir))
    return review.change_over_time(bins, "session_id", "minute", "error_rate")


def session_bundle(spark, sf_dir):
    return review.bundle(fx.feedback(spark, sf_dir))


def matcher_comparison(spark, sf_dir):
    """Three matchers on drifted names against a schema; each always gives its best, however poor."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("name"))
    schema = p.select(F.col("name").alias("target")).distinct()
    drifted = p.select("name", drift.kind_of(F.col("p_partkey")).alias("kind"), drift.add_noise(F.col("name"), F.col("p_partkey")).alias("raw"))
    counted = drifted.groupBy("name", "kind", "raw").agg(F.count(F.lit(1)).alias("n"))
    found = counted.select("raw").distinct()
    out = None
    for method in ("pattern", "edit"):
        score = reconcile.scorer(method)
        best = reconcile.best_by_name(found, schema, lambda t, r, score=score: F.round(score(t, r), 9)).withColumn("method", F.lit(method))
        out = best if out is None else out.unionByName(best)
    cut = found.select("raw", F.left("raw", F.lit(15)).alias("match"), F.lit("prefix").alias("method"))
    rows = out.select("raw", "match", "method").unionByName(cut).join(counted, "raw")
    return rows.groupBy("method", "kind").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("match") == F.col("name"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))


# --- guards, shapes, snapshots ---------------------------------------------------------------------------------------


def priced_orders(spark, sf_dir):
    """Only texts with a price pass; the count of the others goes beside."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, F.lit("no price")).otherwise(F.concat(F.lit("total $"), F.floor("o_totalprice").cast("string"))).alias("text"))
    good, bad = guards.split_on(guards.non_empty(o), F.contains("text", F.lit("$")))
    return good.select("o_orderkey", guards.require(F.col("text"), "$").alias("text")).unionByName(bad.select("o_orderkey", F.lit("rejected").alias("text")))


def shaped_records(spark, sf_dir):
    """Records by key, lists of records and single records give rows of one shape."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("double").alias("quantity"))
    one = F.struct("line", "quantity")
    keyed = guards.records_of(li.select("l_orderkey", F.create_map(F.concat(F.lit("k"), F.col("line").cast("string")), one).alias("body")), "body", "key")
    listed = guards.records_of(li.select("l_orderkey", F.array(one).alias("body")), "body", "key")
    single = guards.records_of(li.select("l_orderkey", one.alias("body")), "body", "key")
    rows = keyed.withColumn("shape", F.lit("keyed")).unionByName(listed.withColumn("shape", F.lit("list"))).unionByName(single.withColumn("shape", F.lit("single")))
    return rows.groupBy("shape", F.coalesce("key", F.lit("-")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


def visible_elements(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ok = guards.visible(F.col("l_linenumber") - 1, F.col("l_quantity"), F.col("l_extendedprice") / 50)
    return li.groupBy(ok.alias("visible")).agg(F.count(F.lit(1)).alias("n"))


def lowered_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("NationKey"), F.col("n_name").alias("NAME"))
    return guards.lower_columns(n)


def renamed_fields(spark, sf_dir):
    """A source's field names to our own, then to those for display."""
    own = guards.rename_fields(table(spark, sf_dir, "events"), {"event_id": "id", "ts": "at", "absent": "nothing", "event_type": "kind", "value": "level"})
    return guards.display(own.drop("at"), {"level": "Level", "kind": "Kind of event"})


def tidied_names(spark, sf_dir):
    """Names without white space around them, in capitals; what is empty then is null."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).alias("raw"))
    return n.select("n_nationkey", guards.tidied(F.col("raw")).alias("name"))


def feedback_overview(spark, sf_dir):
    """Per field: entries, the newest entry, and how many were kept after a clearing of everything before a day."""
    f = fx.feedback(spark, sf_dir)
    left = review.cleared(f, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    kept = left.groupBy("raw_field").agg(F.count(F.lit(1)).alias("kept"))
    return f.groupBy("raw_field").agg(F.count(F.lit(1)).alias("n"), F.max_by("seq", F.struct("ts", "seq")).alias("newest")).join(kept, "raw_field", "left").na.fill(0, ["kept"])


def orders_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return guards.snapshot(o, "o_orderkey")


def first_orders(spark, sf_dir):
    return guards.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5)


def timing_statistics(spark, sf_dir):
    """Quantities as times of runs, by line number."""
    li = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("long"))
    return guards.timing(li, F.col("l_quantity").cast("double"), F.col("l_returnflag") != "R", F.col("l_discount").cast("double"), "line")


def auditability(spark, sf_dir):
    from ..operators import provenance

    log = _log(spark, sf_dir)
    log = log.withColumn("event_type", F.when(F.col("event_id") % 997 == 5, "forged").otherwise(F.col("event_type")))
    found = provenance.verdict(provenance.check(log, "chain", "event_id", *_FIELDS), "chain", "event_id")
    return found.select("chain", guards.auditability(F.col("valid")).alias("score"))


def audit_lines(spark, sf_dir):
    """The lines of an audit report: figures where there are any, n/a where not."""
    from ..operators import provenance

    s = provenance.statistics(fx.feedback(spark, sf_dir), "confidence_score")
    none = provenance.statistics(fx.feedback(spark, sf_dir).where("false"), "confidence_score")
    return provenance.audit_text(s, "all").unionByName(provenance.audit_text(none, "none"))


def anomaly_counts(spark, sf_dir):
    from ..operators import rules

    return guards.count_by_kind(fx.readings(spark, sf_dir), rules.anomaly_class(F.col("reading")), ("missing", "non_numeric", "impossible", "valid", "unheard_of"))


def value_summary(spark, sf_dir):
    return guards.summary(table(spark, sf_dir, "events"), "value")


def overridden_regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    changes = n.where("n_nationkey < 5").select(F.when(F.col("n_nationkey") == 4, 400).otherwise(F.col("n_nationkey")).cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), F.lit("changed").alias("n_name"))
    return guards.override(n, changes, "n_nationkey")


def first_per_customer(spark, sf_dir):
    return guards.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def sql_functions(spark, sf_dir):
    guards.register_functions(spark)
    fx.readings(spark, sf_dir).createOrReplaceTempView("sedimentry_readings")
    return spark.sql("select review_level(coalesce(safe_number(reading), 0) / 100) as level, count(*) as n, round(avg(edit_share(code, 'purchase')), 6) as share from sedimentry_readings group by 1")


# --- drift -----------------------------------------------------------------------------------------------------------

#: Our own lexicon.
LEXICON = {"steel": ("alloy", "iron"), "copper": ("cuprum", "bronze", "red_metal"), "anodized": ("coated", "oxidised")}
PACKET = {"gx": "lateral", "gz": "vertical"}


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))


def contained_synonyms(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", drift.contained_synonym(F.col("name"), F.col("p_partkey"), LEXICON).alias("name"))


def drift_by_intensity(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", *[drift.by_intensity(F.col("name"), F.col("p_partkey"), i).alias(f"at_{int(i * 100)}") for i in (0.0, 0.4, 1.0)])


def thinned_stream(spark, sf_dir):
    rows = drift.thinned(table(spark, sf_dir, "events"), F.col("event_id"), 0.3)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def drift_batch(spark, sf_dir):
    return drift.batch(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("n")), "n", 500, 0.5, 3)


def relabelled_packets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    packet = F.create_map(F.lit("gx"), F.col("value"), F.lit("gy"), F.lit(1.0), F.lit("gz"), F.col("value") * 2)
    out = drift.relabel_keys(packet, drift.toggled(F.col("event_id"), 50), PACKET)
    return e.select("event_id", F.array_join(F.map_keys(out), ",").alias("keys"))


def replay_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = drift.renamed_between(F.create_map(F.lit("speed_kph"), F.col("value")), F.col("event_id"), 151, 199, {"speed_kph": "speed_kmh"})
    return e.select("event_id", F.map_keys(out)[0].alias("key"))


def calibrated_weights(spark, sf_dir):
    """Weights for an expected accuracy of 0.85, with the accuracy that they give."""
    accuracy = {"synonyms": 0.7, "noise": 0.95, "truncation": 0.8}
    got = drift.calibrated({"synonyms": 0.4, "noise": 0.35, "truncation": 0.25}, accuracy, 0.85)
    expected = sum(x * accuracy[k] for k, x in got.items())
    return spark.createDataFrame([(round(sum(got.values()), 6), round(expected, 6))], "total double, expected double")


def _levels(spark):
    return spark.range(11).select((F.col("id") / 10.0).alias("drift_level"))


def accuracy_curves(spark, sf_dir):
    return drift.accuracy_curves(_levels(spark))


def accuracy_trials(spark, sf_dir):
    return drift.trials(drift.accuracy_curves(_levels(spark)), 500)


def messy_records(spark, sf_dir):
    return telemetry.messy_record(table(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_suppkey"))


def vitals_packets(spark, sf_dir):
    return telemetry.vitals_batch(table(spark, sf_dir, "customer"), "c_custkey")


_SCORED = f"{_F}, scored as (select seq, raw_field, case when seq % 23 <> 0 then suggested_match end as suggested_match, confidence_score from feedback)"
_DECIDED = f"""{_SCORED}, queue as (select *, row_number() over (partition by raw_field order by seq) as turn from scored where suggested_match is not null and confidence_score < 0.85),
  made as (select case when seq % 99 = 0 then 'unknown' else raw_field end as raw_field, seq, case when seq % 2 = 0 then 'approve' else 'correct' end as action, 'fix_' || (seq % 5)::varchar as correction from feedback where seq % 3 = 0),
  numbered as (select *, row_number() over (partition by raw_field order by seq) as turn from made),
  decided as (select q.seq, q.raw_field, suggested_match, confidence_score, action, correction from queue q left join numbered m on q.raw_field = m.raw_field and q.turn = m.turn)"""
_FIGURES = f"""{_F}, w as (select * from feedback where feedback_type = 'corrected'), figures as (
  select 'corrections' as figure, count(*) as n from w union all select 'patterns', count(*) from (select distinct suggested_match, human_correction from w)
  union all select 'unsure', count(*) from w where confidence_score < 0.5 union all select 'sure_but_wrong', count(*) from w where confidence_score >= 0.5
  union all select 'calibrated', count(distinct suggested_match) from feedback)"""
_BINS_T = f"""{_F}, t as (select *, min(ts) over (partition by session_id) as t0 from feedback),
  m as (select session_id, ((epoch_us(ts) // 1000000 - epoch_us(t0) // 1000000) // 60)::bigint as minute, count(*) as n, count(*) filter (feedback_type = 'corrected') as fixed from t group by 1, 2),
  bins as (select *, fixed::double / n as error_rate from m)"""
_TIERS = _EMB + """, known as (select idx, 'learned_' || target as target, g from gold where idx % 2 = 0),
f as (select vec_id, target, round(list_cosine_similarity(embedding::double[], g::double[]), 6) as s, idx from rest cross join known),
fuzzy as (select vec_id, target, s from (select *, row_number() over (partition by vec_id order by s desc, idx) as rn from f) where rn = 1 and s > 0.7),
tiers as (select b.vec_id, case when b.vec_id % 50 = 3 then 'known_' || b.vec_id::varchar when fuzzy.target is not null then fuzzy.target when b.confidence >= 0.45 then b.match end as match,
  case when b.vec_id % 50 = 3 then 1.0::double when fuzzy.target is not null then fuzzy.s else b.confidence end as confidence,
  case when b.vec_id % 50 = 3 then 'learned' when fuzzy.target is not null then 'fuzzy' when b.confidence >= 0.45 then 'scored' else 'none' end as method
  from best b left join fuzzy on b.vec_id = fuzzy.vec_id)"""
_UNIT = "(({seed} * 7919 + {salt} * 104729) % 1000)::double / 1000.0::double"
_SWAP = "array_to_string(list_transform(string_split({x}, '_'), lambda t: case t " + " ".join(f"when '{a}' then '{b}'" for a, b in drift.TOKENS.items()) + " else t end), '_')"
_CUT = "case when length({x}) > 3 then left({x}, (3 + {seed} % (length({x}) - 3))::int) else {x} end"
_NOISE = "case when {seed} % 2 = 0 then {x} || ['_s1', '_logged', '_b', '_alt'][({seed} % 4 + 1)::int] else ['in_', 'dev_', 'k_'][({seed} % 3 + 1)::int] || {x} end"


def _intensity_sql(source: str, seed: str, level: float, keep: str) -> str:
    steps, name = source, "name"
    for salt, step in enumerate((_SWAP, _NOISE, _CUT)):
        steps = f"(select {keep}, case when {_UNIT.format(seed=seed, salt=salt + 1)} < {level}::double then {step.format(x='name', seed=seed)} else name end as name from {steps})"
    return steps


QUERIES = {f.__name__: f for f in (
    review_pending, review_feedback, reviewed_mapping, learned_after_resolutions, vector_tiers, translator_usage, retraining_metrics, bias_item_lists, retraining_plan, signed_report,
    rate_over_time, session_bundle, matcher_comparison, priced_orders, shaped_records, visible_elements, lowered_columns, renamed_fields, tidied_names, feedback_overview, orders_snapshot, first_orders, timing_statistics,
    auditability, audit_lines, anomaly_counts, value_summary, overridden_regions, first_per_customer, sql_functions, contained_synonyms, drift_by_intensity, thinned_stream, drift_batch,
    relabelled_packets, replay_drift, calibrated_weights, accuracy_curves, accuracy_trials, messy_records, vitals_packets,
)}

_curve = "round(0.97::double - 0.12::double * d * d, 6) as vector, round(0.94::double * (1.0::double - d) + 0.12::double * d, 6) as edit, round(exp(d * -4.0::double), 6) as pattern"
ORACLES = {
    "review_pending": _DECIDED + " select seq, raw_field, suggested_match, confidence_score from decided where action is null",
    "review_feedback": _DECIDED + """ select seq, raw_field, suggested_match, case when action = 'correct' then correction end as human_correction,
      case when action = 'correct' then 'corrected' else 'approved' end as feedback_type, confidence_score from decided where action is not null""",
    "reviewed_mapping": _DECIDED + """ select seq, raw_field, suggested_match as mapping, 'auto' as route from scored where confidence_score >= 0.85 and suggested_match is not null
      union all select seq, raw_field, case action when 'correct' then correction when 'approve' then suggested_match end, coalesce(action, 'pending') from decided
      union all select seq, raw_field, null, 'unmatched' from scored where suggested_match is null""",
    "learned_after_resolutions": _F + """, both_ as (select seq, raw_field, suggested_match, human_correction, feedback_type from feedback
        union all select seq, raw_field, 'resolved', null, 'approved' from feedback where seq % 4 = 1 and seq % 12 <> 1),
      v as (select raw_field, case when feedback_type in ('approved', 'corrected') then coalesce(nullif(human_correction, ''), suggested_match) end as vote, seq from both_),
      g as (select raw_field, vote, count(*) as n, min(seq) as first_ from v group by 1, 2), t as (select *, sum(n) over (partition by raw_field) as total from g),
      r as (select *, row_number() over (partition by raw_field order by n desc, first_) as rn from t where vote is not null)
      select raw_field, vote as mapping, round(n::double / total, 4) as agreement from r where rn = 1 and n::double / total >= 0.1""",
    "vector_tiers": _TIERS + " select * from tiers",
    "translator_usage": _TIERS + """ select count(*) as total, count(*) filter (method in ('learned', 'fuzzy')) as hits, count(*) filter (method not in ('learned', 'fuzzy')) as fallbacks,
      round(count(*) filter (method in ('learned', 'fuzzy'))::double / count(*), 4) as hit_rate from tiers""",
    "retraining_metrics": _FIGURES + " select * from figures",
    "bias_item_lists": _F + """, w as (select *, case when confidence_score < 0.5 then 'low' else 'high' end as bucket from feedback where feedback_type = 'corrected'),
      r as (select *, row_number() over (partition by bucket order by seq) as place from w)
      select bucket, string_agg(place::varchar || ' ' || raw_field || ' ' || human_correction, '; ' order by place) as items from r where place <= 5 group by bucket""",
    "retraining_plan": _F + """, s as (select t as threshold, round(count(*) filter (feedback_type = 'approved')::double / count(*), 4) as accuracy
        from feedback join (select unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]::double[]) as t) on confidence_score >= t group by t),
      o as (select count(*) as n, count(*) filter (feedback_type = 'corrected') as fixed from feedback), e as (select *, fixed::double / n as err, least(0.8::double * fixed / n, 0.15::double) as gain from o),
      b as (select suggested_match || ' -> ' || human_correction as pattern, count(*) as n from feedback where feedback_type = 'corrected' group by 1)
      select n >= 5 as ready, n as n_records, (select threshold from s order by accuracy desc, threshold limit 1) as threshold, round(err - gain, 4) as expected_error,
        round(gain / err * 100, 1) as improvement_pct, (select pattern from b order by n desc, pattern desc limit 1) as commonest, (select max(n) from b) as times from e""",
    "signed_report": _FIGURES + ", b as (select string_agg(figure || '=' || n::varchar, ';' order by figure) as body from figures) select body, sha256(body) as signature from b",
    "rate_over_time": _BINS_T + """, d as (select session_id, (error_rate - lag(error_rate) over w) / (minute - lag(minute) over w) as c from bins window w as (partition by session_id order by minute))
      select session_id, round(coalesce(avg(c), 0), 6) as rate from d group by 1""",
    "session_bundle": _BINS_T + """, d as (select session_id, fixed, error_rate - lag(error_rate) over (partition by session_id order by minute) as c from bins),
      p as (select session_id, round(sum(fixed)::double / count(*), 6) as fatigue, round(coalesce(avg(c), 0), 6) as learning_rate from d group by 1)
      select p.*, q.intervention_ratio from p join (select session_id, round(count(human_correction)::double / count(*), 6) as intervention_ratio from feedback group by 1) q using (session_id)""",
    "matcher_comparison": f"""with p as (select p_partkey, lower(replace(p_brand, '#', '_')) as name from part), targets as (select distinct name as target from p),
      d as (select name, case when (p_partkey * 37) % 100 < 40 then 'synonyms' when (p_partkey * 37) % 100 < 75 then 'noise' else 'truncation' end as kind, {_NOISY} as raw from p),
      names as (select distinct raw from d),
      s as (select raw, target, {fx.PATTERN_SQL} as pattern, round(1.0::double - levenshtein(lower(target), lower(raw))::double / greatest(length(target), length(raw), 1)::double, 9) as edit from names cross join targets),
      b as (select raw, 'pattern' as method, target as match from (select *, row_number() over (partition by raw order by pattern desc, target) as rn from s) where rn = 1
        union all select raw, 'edit', target from (select *, row_number() over (partition by raw order by edit desc, target) as rn from s) where rn = 1 union all select raw, 'prefix', left(raw, 15) from names)
      select method, kind, count(*) as n, round(sum((match = name)::int)::double / count(*), 6) as accuracy from d join b using (raw) group by 1, 2""",
    "priced_orders": "select o_orderkey, case when o_orderkey % 6 = 0 then 'rejected' else 'total $' || floor(o_totalprice)::bigint::varchar end as text from orders",
    "shaped_records": """with l as (select l_linenumber, l_quantity from lineitem) select 'keyed' as shape, 'k' || l_linenumber::varchar as key, count(*) as n, round(sum(l_quantity), 2)::double as quantity from l group by 2
      union all select s, '-', count(*), round(sum(l_quantity), 2)::double from l, (select unnest(['list', 'single']) as s) group by 1""",
    "visible_elements": "select (l_linenumber > 1 and l_quantity > 0 and l_extendedprice / 50 < 900) as visible, count(*) as n from lineitem group by 1",
    "lowered_columns": "select n_nationkey as nationkey, n_name as name from nation",
    "renamed_fields": 'select event_id as id, event_type as "Kind of event", value as "Level" from events',
    "tidied_names": "select n_nationkey, case when n_nationkey % 7 <> 0 then upper(n_name) end as name from nation",
    "feedback_overview": _F + """ select raw_field, count(*) as n, max_by(seq, struct_pack(t := ts, s := seq)) as newest, count(*) filter (ts >= timestamp '2024-01-15 00:00:00') as kept from feedback group by 1""",
    "orders_snapshot": """select 'o_orderkey,o_custkey' as columns, (select count(*) from orders) as n_rows,
      (select sha256(string_agg(o_orderkey::varchar || '|' || o_custkey::varchar, chr(10) order by o_orderkey)) from (select * from orders order by o_orderkey limit 5)) as sample_hash""",
    "first_orders": "select o_orderkey, o_custkey from orders order by o_orderkey limit 5",
    "timing_statistics": """select l_linenumber::bigint as line, round(avg(l_quantity::double), 6) as mean, min(l_quantity)::double as least, max(l_quantity)::double as most, round(stddev_samp(l_quantity::double), 6) as spread,
      round(avg((l_returnflag <> 'R')::int::double) * 100, 4) as success_pct, round(avg(l_discount::double), 6) as confidence, round(count(*) / sum(l_quantity::double), 6) as per_unit from lineitem group by 1""",
    "auditability": _CHAIN + " select chain, case when bool_or(event_id % 997 = 5) then 0.0::double else 1.0::double end as score from log group by 1",
    "audit_lines": _F + """, s as (select count(*) as n, avg(confidence_score) as mean, min(confidence_score) as low, max(confidence_score) as high from feedback)
      select 'all' as scope, 'records: ' || n::varchar || ', mean ' || printf('%.4f', round(mean, 6)) || ', from ' || printf('%.4f', round(low, 6)) || ' to ' || printf('%.4f', round(high, 6)) as line from s
      union all select 'none', 'records: 0, mean n/a, from n/a to n/a'""",
    "anomaly_counts": f"""with {fx.READINGS_SQL}, c as (select case when reading is null then 'missing' when try_cast(reading as double) is null then 'non_numeric'
      when try_cast(reading as double) between -50 and 150 then 'valid' else 'impossible' end as kind from readings)
      select k as kind, count(kind) as n from (select unnest(['missing', 'non_numeric', 'impossible', 'valid', 'unheard_of']) as k) left join c on kind = k group by 1""",
    "value_summary": """select count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as spread, min(value) as least, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
      round(quantile_cont(value, 0.75), 6) as p75, max(value) as most from events""",
    "overridden_regions": "select n_nationkey, n_name from nation where n_nationkey >= 4 union all select case when n_nationkey = 4 then 400 else n_nationkey end, 'changed' from nation where n_nationkey < 5",
    "first_per_customer": "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1",
    "sql_functions": f"""with {fx.READINGS_SQL}, r as (select coalesce(try_cast(trim(reading) as double), 0) / 100 as c, 1.0::double - levenshtein(lower(code), 'purchase')::double / greatest(length(code), 8, 1)::double as s from readings)
      select case when c < 0.45 then 'critical' when c <= 0.7 then 'warning' else 'safe' end as level, count(*) as n, round(avg(s), 6) as share from r group by 1""",
    "contained_synonyms": f"""select p_partkey, case when contains(name, 'steel') or contains('steel', name) then ['alloy', 'iron'][(p_partkey % 2 + 1)::int]
      when contains(name, 'copper') or contains('copper', name) then ['cuprum', 'bronze', 'red_metal'][(p_partkey % 3 + 1)::int]
      when contains(name, 'anodized') or contains('anodized', name) then ['coated', 'oxidised'][(p_partkey % 2 + 1)::int] else name end as name from {_P}""",
    "drift_by_intensity": f"""select a.p_partkey, a.name as at_0, b.name as at_40, c.name as at_100 from {_P} a join {_intensity_sql(_P, 'p_partkey', 0.4, 'p_partkey')} b using (p_partkey)
      join {_intensity_sql(_P, 'p_partkey', 1.0, 'p_partkey')} c using (p_partkey)""",
    "thinned_stream": f"select event_type, count(*) as n from events where {_UNIT.format(seed='event_id', salt=9)} < 0.3::double group by 1",
    "drift_batch": f"""with l as (select list(distinct lower(n_name) order by lower(n_name)) as names from nation), r as (select range as id, names[(range % len(names) + 1)::int] as name from range(500), l)
      select r.id, r.name, x.name as drifted from r join {_intensity_sql('r', '(id + 3)', 0.5, 'id')} x using (id)""",
    "relabelled_packets": "select event_id, case when (event_id // 50) % 2 = 1 then 'lateral,gy,vertical' else 'gx,gy,gz' end as keys from events",
    "replay_drift": "select event_id, case when event_id between 151 and 199 then 'speed_kmh' else 'speed_kph' end as key from events",
    "calibrated_weights": "select 1.0::double as total, 0.85::double as expected",
    "accuracy_curves": f"select d as drift_level, {_curve} from (select range::double / 10.0::double as d from range(11))",
    "accuracy_trials": f"""with c as (select d as drift_level, {_curve} from (select range::double / 10.0::double as d from range(11))), t as (select ((range * 7919 + 104729) % 1000)::double / 1000.0::double as luck from range(500))
      select drift_level, round(avg((luck < vector)::int::double), 6) as vector, round(avg((luck < edit)::int::double), 6) as edit, round(avg((luck < pattern)::int::double), 6) as pattern from c, t group by 1""",
    "messy_records": "select s_suppkey::varchar as \"unit_ID\", ((s_suppkey * 31) % 90 + 60)::varchar as pulse_raw, ((s_suppkey * 17) % 260 + 40)::varchar || ' km/h' as \"SPEED\" from supplier",
    "vitals_packets": "select c_custkey as patient_id, packet::int as packet, ((c_custkey * 13 + packet * 7) % 45 + 58)::int as pulse, ((c_custkey * 13 + packet * 7) % 9 + 91)::int as oxygen from customer, (select unnest(range(10)) as packet)",
}
