"""Queries: feedback analytics, provenance, look-ups, ranges, telemetry and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as fb
from ..operators import lifecycle, lookup, provenance, telemetry
from ..session import table
from ..streaming import heal
from . import fixtures as fx


def feedback_consensus(spark, sf_dir):
    return fb.consensus(fx.feedback(spark, sf_dir), 0.1)


def feedback_stats(spark, sf_dir):
    return fb.statistics(fb.record(fx.feedback(spark, sf_dir)))


def feedback_bias(spark, sf_dir):
    return fb.bias(fx.feedback(spark, sf_dir))


def bias_buckets(spark, sf_dir):
    return fb.bias_buckets(fx.feedback(spark, sf_dir))


def calibration_factors(spark, sf_dir):
    return fb.calibration(fx.feedback(spark, sf_dir))


def threshold_sweep(spark, sf_dir):
    return fb.sweep(fx.feedback(spark, sf_dir))


def threshold_recommendation(spark, sf_dir):
    return fb.recommended_threshold(fb.sweep(fx.feedback(spark, sf_dir)))


def improvement_estimate(spark, sf_dir):
    return fb.improvement(fx.feedback(spark, sf_dir))


def correction_history(spark, sf_dir):
    return fb.history(fx.feedback(spark, sf_dir), "field_3").select("seq", "suggested_match", "feedback_type", "human_correction")


def minute_learning_curve(spark, sf_dir):
    bins = fb.minute_bins(fx.feedback(spark, sf_dir))
    return bins.select("session_id", "minute", F.col("ordinal").cast("bigint").alias("ordinal"), "n", F.round("error_rate", 6).alias("error_rate"))


def fatigue_score(spark, sf_dir):
    return fb.fatigue(fb.minute_bins(fx.feedback(spark, sf_dir)))


def learning_rate(spark, sf_dir):
    return fb.learning_rate(fb.minute_bins(fx.feedback(spark, sf_dir)))


def intervention_ratio(spark, sf_dir):
    per = fx.feedback(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("human_correction").isNotNull()).alias("fixes"), F.count(F.lit(1)).alias("fields"))
    return per.select("session_id", F.round(fb.intervention_ratio(F.col("fixes"), F.col("fields")), 6).alias("ratio"))


_FIELDS = ("event_id", "user_id", "event_type")


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("chain", F.col("user_id"))
    return provenance.build(e, "chain", "event_id", *_FIELDS)


def hash_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", provenance.row_hash(*_FIELDS).alias("hash"))


def chain_build(spark, sf_dir):
    return _log(spark, sf_dir).select("chain", "event_id", "transaction_hash", "previous_hash")


def chain_verify(spark, sf_dir):
    """One record in 997 is altered after logging, one in 1,009 gets another predecessor."""
    log = _log(spark, sf_dir)
    log = log.withColumn("event_type", F.when(F.col("event_id") % 997 == 5, "forged").otherwise(F.col("event_type")))
    log = log.withColumn("previous_hash", F.when(F.col("event_id") % 1009 == 7, "lost").otherwise(F.col("previous_hash")))
    found = provenance.verdict(provenance.check(log, "chain", "event_id", *_FIELDS), "chain", "event_id")
    return found.withColumn("first_broken", F.coalesce("first_broken", F.lit(-1)))


def chain_stats(spark, sf_dir):
    return provenance.statistics(fx.feedback(spark, sf_dir), "confidence_score")


def sequential_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return provenance.sequential(e.withColumn("payload", F.col("event_type")), "user_id", "event_id", "payload")


def roster_lookup_roles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("buyer"), (F.col("o_orderkey") % 2000).alias("referrer"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup.look_up_roles(o, people, "c_custkey", "c_name", {"buyer": "buyer_name", "referrer": "referrer_name"})


def team_label(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    home = F.broadcast(n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("home")))  # 25 nations
    return s.join(home, "s_nationkey", "left").select("s_suppkey", F.coalesce("home", F.lit("AWAY")).alias("label"))


def nested_orders(spark, sf_dir):
    """Documents of orders with their lines, flattened again with conditional columns."""
    li = table(spark, sf_dir, "lineitem")
    docs = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity")).alias("lines"))  # a handful of lines per order
    flat = docs.select("l_orderkey", F.explode("lines").alias("p"))
    flag = F.col("p.l_returnflag")
    return flat.where(flag != "N").select("l_orderkey", F.col("p.l_linenumber").alias("line"), F.when(flag == "R", "RETURNED").when(flag == "A", "ACCEPTED").alias("result"), F.when(flag == "R", F.col("p.l_quantity")).alias("returned"))


def zone_range_flag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    inside = lookup.in_zones(F.col("l_quantity"), [(5, 9), (20, 24.5), (40, 41)])
    return li.groupBy(inside.alias("in_zone")).agg(F.count(F.lit(1)).alias("n"))


def pit_semi_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_suppkey") % 5 + 1, F.lit(3).cast("long")).alias("laps"))
    li = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.where(F.array_contains("laps", F.col("l_linenumber").cast("long"))).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def grid_cross_product(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return n.select("n_nationkey", F.col("lap").cast("bigint").alias("lap"), F.col("tick").cast("bigint").alias("tick"), (F.col("lap") * 1000 + F.col("tick") * 100).cast("bigint").alias("ms"))


def left_default_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    r = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return s.join(F.broadcast(r), "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("BED-0")).alias("place"))  # 25 nations


def game_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", lookup.game_id(F.lit(20242025), F.lit("02"), (F.col("o_orderkey") % 1312).cast("int")).alias("game_id"))


def corner_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = telemetry.corner(F.pmod(F.col("event_id"), F.lit(1000)) / 1000.0)
    return e.select("event_id", F.round(c["cornering"], 6).alias("cornering"), F.round(c["braking"], 6).alias("braking"), c["side"].alias("side"))


def imu_kernel(spark, sf_dir):
    """Noise-free samples at 50 Hz along the lap."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_id") / 50.0
    m = telemetry.imu(t, telemetry.lap_position(t), noisy=False)
    g = telemetry.gps(telemetry.lap_position(t), noisy=False)
    return e.select("event_id", *[m[c].alias(c) for c in ("gx", "gy", "gz")], *[g[c].alias(c) for c in ("latitude", "longitude", "speed")])


def grid_session(spark, sf_dir):
    """A whole noise-free grid session of 20 drivers, 15 laps and 925 samples, summed per driver."""
    g = telemetry.grid_session(spark, telemetry.demo_session(), noisy=False)
    return g.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_pit_stop").alias("pit"), F.round(F.avg("speed_kph"), 3).alias("speed"), F.max("heart_rate_bpm").alias("top_rate"), F.sum("drs").alias("open_wing"), F.sum("sector").alias("sectors")
    )


def drift_severity(spark, sf_dir):
    return fx.feedback(spark, sf_dir).groupBy(lifecycle.drift_severity(F.col("confidence_score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def run_report_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id"))
    stages = F.when(F.col("event_id") % 11 == 0, "semantic_reconciliation").when(F.col("event_id") % 401 == 0, "error_recovery").otherwise("load")
    errors = e.where("event_id % 29 = 0").select("run_id", F.when(F.col("event_id") % 58 == 0, "CRITICAL failure").otherwise("timeout").alias("error"))
    return lifecycle.run_status(e.select("run_id", stages.alias("stage")), errors)


def report_validity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    run = F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderkey").cast("string"))
    end = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") - F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    return o.groupBy(lifecycle.report_is_valid(run, F.col("o_orderdate"), end).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def stream_hourly_counts(spark, sf_dir):
    out = heal.hourly(table(spark, sf_dir, "events"))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def session_activity(spark, sf_dir):
    out = heal.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "n")


def healed_keys(spark, sf_dir):
    """Drifted keys brought back by a mapping, without state."""
    e = table(spark, sf_dir, "events")
    odd = F.col("event_id") % 2 == 1
    m = F.create_map(F.when(odd, "lateral").otherwise("gx"), F.col("value"), F.when(odd, "vertical").otherwise("gz"), F.col("value") * 2)
    healed = heal.rename_keys(m, {"lateral": "gx", "vertical": "gz"})
    return e.select("event_id", healed["gx"].alias("gx"), healed["gz"].alias("gz"))


_F = f"with {fx.FEEDBACK_SQL}"
_BINS = f"""{_F}, t as (select *, min(ts) over (partition by session_id) as t0 from feedback),
  m as (select session_id, ((epoch_us(ts) // 1000000 - epoch_us(t0) // 1000000) // 60)::bigint as minute, count(*) as n, count(*) filter (feedback_type = 'corrected') as fixed from t group by 1, 2),
  bins as (select *, row_number() over (partition by session_id order by minute) - 1 as ordinal, fixed::double / n as error_rate from m)"""
_HASH = "sha256(length(event_id::varchar)::varchar || ':' || event_id::varchar || '|' || length(user_id::varchar)::varchar || ':' || user_id::varchar || '|' || length(event_type)::varchar || ':' || event_type)"
_CHAIN = f"""with h as (select *, {_HASH} as transaction_hash from events),
  log as (select user_id as chain, *, coalesce(lag(transaction_hash) over (partition by user_id order by event_id), 'genesis') as previous_hash from h)"""
_SWEEP = f"""{_F}, s as (select t as threshold, round(count(*) filter (feedback_type = 'approved')::double / count(*), 4) as accuracy,
  round(count(*)::double / (select count(*) from feedback), 4) as coverage from feedback join (select unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]::double[]) as t) on confidence_score >= t group by t)"""
_CORNERS = ", ".join(f"({c.start}::double, {c.end}::double, {c.intensity}::double, {c.side})" for c in telemetry.CORNERS)
_PLACED = f"""arcs(a, z, k, side) as (values {_CORNERS}), bends as (select p.*, coalesce(k * least((x - a) / (z - a) * 2.0, 2.0 - (x - a) / (z - a) * 2.0), 0) as cornering,
  coalesce(greatest(0, 1.0 - (x - a) / (z - a) * 3.0), 0) as braking, coalesce(side, 0) as side from p left join arcs on x between a and z)"""

QUERIES = {f.__name__: f for f in (
    feedback_consensus, feedback_stats, feedback_bias, bias_buckets, calibration_factors, threshold_sweep, threshold_recommendation, improvement_estimate, correction_history,
    minute_learning_curve, fatigue_score, learning_rate, intervention_ratio, hash_rows, chain_build, chain_verify, chain_stats, sequential_chain, roster_lookup_roles, team_label,
    nested_orders, zone_range_flag, pit_semi_join, grid_cross_product, left_default_lookup, game_ids, corner_profile, imu_kernel, grid_session, drift_severity, run_report_status,
    report_validity, stream_hourly_counts, session_activity, healed_keys,
)}

ORACLES = {
    "feedback_consensus": _F + """, v as (select raw_field, case when feedback_type in ('approved', 'corrected') then coalesce(nullif(human_correction, ''), suggested_match) end as vote, seq from feedback),
      g as (select raw_field, vote, count(*) as n, min(seq) as first_ from v group by 1, 2), t as (select *, sum(n) over (partition by raw_field) as total from g),
      r as (select *, row_number() over (partition by raw_field order by n desc, first_) as rn from t where vote is not null)
      select raw_field, vote as mapping, round(n::double / total, 4) as agreement from r where rn = 1 and n::double / total >= 0.1""",
    "feedback_stats": _F + "select count(*) as total, " + ", ".join(f"count(*) filter (feedback_type = '{t}') as n_{t}, round(count(*) filter (feedback_type = '{t}')::double / count(*), 4) as {t}_rate, round(coalesce(avg(round(confidence_score, 4)) filter (feedback_type = '{t}'), 0), 6) as {t}_confidence" for t in fb.TYPES) + ", count(distinct raw_field) as n_fields from feedback",
    "feedback_bias": _F + " select suggested_match || ' -> ' || human_correction as pattern, count(*) as n from feedback where feedback_type = 'corrected' group by 1",
    "bias_buckets": _F + " select case when confidence_score < 0.5 then 'low' else 'high' end as bucket, count(*) as n from feedback where feedback_type = 'corrected' group by 1",
    "calibration_factors": _F + " select suggested_match, round(avg((feedback_type = 'approved')::int::double) * 1.5, 6) as factor from feedback group by 1",
    "threshold_sweep": _SWEEP + " select * from s",
    "threshold_recommendation": _SWEEP + " select threshold from s order by accuracy desc, threshold limit 1",
    "improvement_estimate": _F + """, o as (select count(*) as n, count(*) filter (feedback_type = 'corrected') as fixed from feedback), e as (select *, fixed::double / n as err, least(0.8::double * fixed / n, 0.15::double) as gain from o)
      select n, round(err, 4) as error, round(err - gain, 4) as expected_error, round(gain / err * 100, 1) as improvement_pct, case when fixed > 20 then 'high' when fixed > 10 then 'medium' else 'low' end as trust from e""",
    "correction_history": _F + " select seq, suggested_match, feedback_type, human_correction from feedback where raw_field = 'field_3'",
    "minute_learning_curve": _BINS + " select session_id, minute, ordinal, n, round(error_rate, 6) as error_rate from bins",
    "fatigue_score": _BINS + " select session_id, round(sum(fixed)::double / count(*), 6) as fatigue from bins group by 1",
    "learning_rate": _BINS + ", d as (select session_id, error_rate - lag(error_rate) over (partition by session_id order by ordinal) as c from bins) select session_id, round(coalesce(avg(c), 0), 6) as learning_rate from d group by 1",
    "intervention_ratio": _F + " select session_id, round(count(human_correction)::double / count(*), 6) as ratio from feedback group by 1",
    "hash_rows": f"select event_id, {_HASH} as hash from events",
    "chain_build": _CHAIN + " select chain, event_id, transaction_hash, previous_hash from log",
    "chain_verify": _CHAIN + """, c as (select chain, event_id, (event_id % 997 = 5 or event_id % 1009 = 7) as bad from log)
      select chain, count(*) as records, not bool_or(bad) as valid, coalesce(min(case when bad then event_id end), -1) as first_broken from c group by chain""",
    "chain_stats": _F + " select count(*) as n, round(avg(confidence_score), 6) as mean, round(min(confidence_score), 6) as low, round(max(confidence_score), 6) as high, round(stddev_samp(confidence_score), 6) as spread from feedback",
    "roster_lookup_roles": """select o_orderkey, o_custkey as buyer, o_orderkey % 2000 as referrer, b.c_name as buyer_name, r.c_name as referrer_name from orders
      left join customer b on b.c_custkey = o_custkey and o_custkey <> 0 left join customer r on r.c_custkey = o_orderkey % 2000 and o_orderkey % 2000 <> 0""",
    "team_label": "select s_suppkey, coalesce(n_name, 'AWAY') as label from supplier left join nation on n_nationkey = s_nationkey and n_regionkey = 1",
    "nested_orders": "select l_orderkey, l_linenumber as line, case l_returnflag when 'R' then 'RETURNED' when 'A' then 'ACCEPTED' end as result, case when l_returnflag = 'R' then l_quantity end as returned from lineitem where l_returnflag <> 'N'",
    "zone_range_flag": "select (l_quantity between 5 and 9 or l_quantity between 20 and 24.5 or l_quantity between 40 and 41) as in_zone, count(*) as n from lineitem group by 1",
    "pit_semi_join": "select l_suppkey, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey where l_linenumber = s_suppkey % 5 + 1 or l_linenumber = 3 group by 1",
    "grid_cross_product": "select n_nationkey, lap, tick, lap * 1000 + tick * 100 as ms from nation, (select unnest(range(5)) as lap), (select unnest(range(10)) as tick)",
    "left_default_lookup": "select s_suppkey, coalesce(n_name, 'BED-0') as place from supplier left join nation on n_nationkey = s_nationkey and n_nationkey % 2 = 0",
    "game_ids": "select o_orderkey, '2024202502' || lpad((o_orderkey % 1312)::varchar, 4, '0') as game_id from orders",
    "corner_profile": f"""with p as (select event_id, (event_id % 1000)::double / 1000.0::double as x from events), {_PLACED}
      select event_id, round(cornering, 6) as cornering, round(braking, 6) as braking, side from bends""",
    "imu_kernel": f"""with t as (select event_id, event_id::double / 50.0::double as t from events), p as (select *, (t * 58.0::double) % 4640.0::double / 4640.0::double as x from t), {_PLACED}
      select event_id, round(side * cornering * 4.2::double, 3) as gx, round((1.0 - cornering) * 1.1::double - braking * 3.8::double, 3) as gy, round(cornering * cornering * 0.6::double + cos(t * 3.0) * 0.2::double + 1.0, 3) as gz,
        round(sin(x * 2 * pi()) * (480.0::double / 111320.0::double) + 47.0, 6) as latitude, round(cos(x * 2 * pi()) * (950.0::double / (111320.0::double * cos(radians(47.0::double)))) + 8.0, 6) as longitude,
        round((1.0 - cornering * 0.35::double) * (58.0::double * 3.6::double), 1) as speed from bends""",
    "grid_session": f"""with d as (select range as k from range(20)), drivers as (select 'D' || lpad(k::varchar, 2, '0') as id, 296.0::double + k % 11 as top, [6 + k % 4, 11] as pits, 58.0::double + k % 9 as rest, 172.0::double + k % 13 as lim, 0.6::double + (k % 8)::double / 20 as calm from d),
      s as (select *, i::double / 925.0::double as share from drivers, (select unnest(range(15)) as lap), (select unnest(range(925)) as i)),
      p as (select *, list_contains(pits, lap) and share between 0.48 and 0.58 as stopped, case when list_contains(pits, lap) and share between 0.48 and 0.58 then 444.0::double / 925.0::double else share end as x from s), {_PLACED},
      v as (select *, case when stopped then 0.0 else greatest(45.0::double, top * (1.0 - 0.55::double * cornering) - 35.0 * braking) end as speed, case when stopped then 0.0 else greatest(0, least(100, (1.0 - braking) * (100.0 - 60.0 * cornering))) end as throttle from bends),
      l as (select *, sqrt((cornering * cornering + braking * braking + speed / top * (speed / top)) / 3.0) * (case when stopped then 0.25 else 1.0 end)::double as load from v)
      select id as driver_id, count(*) as n, sum(stopped::int)::bigint as pit, round(avg(round(speed, 1)), 3) as speed, round(max(greatest(40, least(210, rest + (lim - rest) * pow(load, 0.7::double)))), 1) as top_rate,
        count(*) filter (throttle >= 90 and (x * 4640 between 1100 and 1650 or x * 4640 between 3050 and 3900)) as open_wing, sum(least(floor(x * 3) + 1, 3))::bigint as sectors from l group by 1""",
    "sequential_chain": """with recursive e as (select user_id, event_id, event_type as p, row_number() over (partition by user_id order by event_id) - 1 as k from events),
      f(user_id, k, h) as (select user_id, k, sha256('|' || p) from e where k % 1024 = 0
        union all select e.user_id, e.k, sha256(f.h || '|' || e.p) from f join e on e.user_id = f.user_id and e.k = f.k + 1 where e.k % 1024 <> 0),
      t as (select user_id, k // 1024 as s, max_by(h, k) as h, count(*) as n from f group by 1, 2),
      g(user_id, s, h) as (select user_id, s, sha256('|' || h) from t where s = 0 union all select t.user_id, t.s, sha256(g.h || '|' || t.h) from g join t on t.user_id = g.user_id and t.s = g.s + 1)
      select g.user_id, (select sum(n) from t where t.user_id = g.user_id)::bigint as records, max_by(g.h, g.s) as head from g group by 1""",
    "drift_severity": _F + " select case when confidence_score < 0.7 then 'medium' else 'low' end as severity, count(*) as n from feedback group by 1",
    "run_report_status": """with l as (select user_id as run_id, count(*) filter (event_id % 11 <> 0 and event_id % 401 = 0) as rec, count(*) filter (event_id % 11 = 0) as actions from events group by 1),
      e as (select user_id as run_id, count(*) as n_errors, count(*) filter (event_id % 58 = 0) as crit from events where event_id % 29 = 0 group by 1)
      select run_id, case when coalesce(crit, 0) > 0 then 'failed' when coalesce(n_errors, 0) = 0 or rec > 0 then 'success' else 'partial' end as status, actions, coalesce(n_errors, 0) as n_errors from l left join e using (run_id)""",
    "report_validity": "select (o_orderkey % 9 <> 0 and o_orderkey % 4 <> 0) as valid, count(*) as n from orders group by 1",
    "stream_hourly_counts": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "session_activity": """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
      s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as began, count(*) as n from s group by user_id, k""",
    "healed_keys": "select event_id, value as gx, value * 2 as gz from events",
}
