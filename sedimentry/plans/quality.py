"""Queries: validation, casts, anomalies, text and time normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lifecycle, rules
from ..sources import generators
from ..session import table
from . import fixtures as fx



def _validated(spark, sf_dir):
    checks = [*rules.required("unit", "level"), *rules.required_truthy("code"), rules.in_range("level", 1.0, 150.0)]
    return rules.validate(fx.readings(spark, sf_dir), checks)


def row_violations(spark, sf_dir):
    return _validated(spark, sf_dir).select("event_id", F.array_join("violations", ",").alias("violations"))


def violation_counts(spark, sf_dir):
    return rules.violation_counts(_validated(spark, sf_dir))


def first10_violations(spark, sf_dir):
    return rules.first_errors(_validated(spark, sf_dir), "event_id").select("event_id", "rule", F.col("rank").cast("bigint").alias("rank"), "total")


def range_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    broken = rules.validate(li, [rules.in_range("l_quantity", 2, 45), rules.in_range("l_discount", 0.01, 0.09)])
    return rules.violation_counts(broken)


def anomaly_classes(spark, sf_dir):
    return fx.readings(spark, sf_dir).groupBy(rules.anomaly_class(F.col("reading")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def nulled_anomalies(spark, sf_dir):
    return fx.readings(spark, sf_dir).select("event_id", rules.null_anomalies(F.col("reading")).alias("value"))


def null_statistics(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    v = rules.null_anomalies(F.col("reading"))
    return r.agg(F.count(F.lit(1)).alias("total"), F.count_if(v.isNull()).alias("missing"), F.count_if(v.isNotNull()).alias("present"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("spread"))


def safe_cast_normalise(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    return r.select("event_id", rules.safe_double(F.col("reading")).alias("as_double"), rules.safe_long(F.col("code")).alias("as_long"))


def truthy_boolean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_linenumber") == 1, F.lit(None).cast("string")).when(F.col("l_linenumber") == 2, "on").otherwise((F.col("l_quantity").cast("bigint") % 3).cast("string"))
    flag = rules.truthy(raw, raw.try_cast("double").isNotNull())
    return li.groupBy("l_linenumber", flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def resilience_score(spark, sf_dir):
    r = fx.readings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(rules.null_anomalies(F.col("reading")).isNull()).alias("bad"))
    return r.select(F.round(lifecycle.resilience(F.col("n"), F.col("bad")), 6).alias("score"))


def anomaly_table_summary(spark, sf_dir):
    t = generators.anomaly_table(spark)
    kind = rules.anomaly_class(F.col("eng_temp_sensor"))
    return t.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def describe_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


def event_breakdown(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("high_values"))


def replay_time_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = F.pmod(F.col("event_id"), F.lit(7200))
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)
    part = lambda i: F.split(clock, ":")[i].cast("bigint")
    millis = (part(0) * 3600 + part(1) * 60 + part(2)) * 1000
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), millis.alias("lap_ms"))


def pseudo_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", (n.cast("bigint") * 20).alias("time_ms"))


def last_k_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return e.withColumn("rank", newest.cast("bigint")).where("rank <= 12").select("event_type", "rank", "event_id", "value")


def alias_coalesce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = F.when(F.col("event_id") % 3 == 0, F.col("value")), F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.col("value") * 2)
    return e.select("event_id", F.coalesce(F.nullif(a, F.lit(0.0)), F.nullif(b, F.lit(0.0)), F.lit(0.0)).alias("speed"))


def default_on_missing(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    return r.select("event_id", F.coalesce(F.nullif("code", F.lit("")), F.lit("unknown")).alias("code"), F.coalesce(F.col("unit").cast("string"), F.lit("None")).alias("unit"))


def ndjson_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("line"))


def price_extract(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    note = F.concat(F.lit("now $"), F.format_number("p_retailprice", 2), F.lit(" was $"), (F.col("p_size") * 100).cast("string"), F.lit(" ($, off)"))
    return p.select("p_partkey", F.explode(text.price_tokens(note)).alias("price"))


def best_price(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    note = F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 7 == 0, "sold out").otherwise(F.concat(F.lit("$"), (F.col("p_size") * 100).cast("string"), F.lit(" or $"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", text.best_price(note).alias("price"))


def tag_density(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    h = F.col("html")
    return p.select("page_id", F.round(text.tag_density(h), 9).alias("density"), text.page_route(h).alias("route"))


def url_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def page_text_lengths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(text.html_text(F.col("html"))).cast("bigint").alias("n_chars"))


_R = f"with {fx.READINGS_SQL}"
_V = f"""{_R}, v as (select event_id, list_filter([case when unit is null then 'unit:required' end, case when level is null then 'level:required' end,
  case when code is null or code in ('', '0', '0.0') then 'code:required' end, case when level not between 1.0 and 150.0 then 'level:range' end], lambda x: x is not null) as violations from readings)"""
_VALUE = "case when try_cast(reading as double) between -50 and 150 then try_cast(reading as double) end"

QUERIES = {f.__name__: f for f in (
    row_violations, violation_counts, first10_violations, range_violations, anomaly_classes, nulled_anomalies, null_statistics, safe_cast_normalise, truthy_boolean,
    resilience_score, anomaly_table_summary, describe_events, event_breakdown, replay_time_normalise, pseudo_time, last_k_rows, alias_coalesce, default_on_missing,
    ndjson_rows, price_extract, best_price, tag_density, url_hosts, page_text_lengths,
)}

ORACLES = {
    "page_text_lengths": r"""select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::bigint as n_chars from pages""",
    "row_violations": _V + " select event_id, array_to_string(violations, ',') as violations from v",
    "violation_counts": _V + " select rule, count(*) as n from (select unnest(violations) as rule from v) group by rule",
    "first10_violations": _V + """, f as (select event_id, unnest(violations) as rule from v)
      select event_id, rule, rank, total from (select *, row_number() over (partition by rule order by event_id) as rank, count(*) over (partition by rule) as total from f) where rank <= 10""",
    "range_violations": """select 'l_quantity:range' as rule, count(*) as n from lineitem where l_quantity not between 2 and 45 having count(*) > 0
      union all select 'l_discount:range', count(*) from lineitem where l_discount not between 0.01::double and 0.09::double having count(*) > 0""",
    "anomaly_classes": _R + """ select case when reading is null then 'missing' when try_cast(reading as double) is null then 'non_numeric'
      when try_cast(reading as double) between -50 and 150 then 'valid' else 'impossible' end as class, count(*) as n from readings group by 1""",
    "nulled_anomalies": _R + f" select event_id, {_VALUE} as value from readings",
    "null_statistics": _R + f""", x as (select {_VALUE} as v from readings) select count(*) as total, count(*) filter (v is null) as missing, count(v) as present,
      min(v) as low, max(v) as high, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as spread from x""",
    "safe_cast_normalise": _R + " select event_id, try_cast(reading as double) as as_double, try_cast(code as bigint) as as_long from readings",
    "truthy_boolean": """select l_linenumber, case when l_linenumber in (1, 2) then false else l_quantity::bigint % 3 <> 0 end as flag, count(*) as n from lineitem group by 1, 2""",
    "resilience_score": _R + f" select round((count(*) - count(*) filter ({_VALUE} is null))::double / count(*) * 100, 6) as score from readings",
    "anomaly_table_summary": "select * from (values ('valid', 90::bigint), ('missing', 3), ('non_numeric', 3), ('impossible', 4)) t(class, n)",
    "describe_events": "select count(value) as n, min(value) as low, max(value) as high, round(avg(value), 6) as mean, count(distinct user_id) as users, count(distinct event_type) as types from events",
    "event_breakdown": "select event_type, count(*) as n, count(*) filter (value > 100) as high_values from events group by event_type",
    "replay_time_normalise": "select event_id, epoch_us(ts) // 1000 as timestamp_ms, (event_id % 7200) * 1000 as lap_ms from events",
    "pseudo_time": "select event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) * 20 as time_ms from events",
    "last_k_rows": "select event_type, rank, event_id, value from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rank from events) where rank <= 12",
    "alias_coalesce": "select event_id, coalesce(nullif(case when event_id % 3 = 0 then value end, 0), nullif(case when event_id % 2 = 0 then 0.0::double else value * 2 end, 0), 0.0::double) as speed from events",
    "default_on_missing": _R + " select event_id, coalesce(nullif(code, ''), 'unknown') as code, coalesce(unit::varchar, 'None') as unit from readings",
    "ndjson_rows": """select n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as line from nation""",
    "price_extract": """with n as (select p_partkey, 'now $' || format('{:,.2f}', p_retailprice) || ' was $' || (p_size * 100)::varchar || ' ($, off)' as note from part)
      select p_partkey, price from (select p_partkey, try_cast(regexp_replace(unnest(regexp_extract_all(note, '\\$[0-9,]+(?:\\.[0-9]{2})?')), '[$,]', '', 'g') as double) as price from n) where price is not null""",
    "best_price": """select p_partkey, case when p_partkey % 10 = 0 then 'N/A' when p_partkey % 7 = 0 then 'Price Not Found' else least(p_size * 100, p_partkey)::bigint::varchar end as price from part""",
    "tag_density": """with d as (select page_id, html, len(regexp_extract_all(html, '<[A-Za-z][^>]*>'))::double / (length(html) + 1) as density from pages)
      select page_id, round(density, 9) as density, case when density < 0.01 or contains(html, '__NEXT_DATA__') then 'browser' else 'static' end as route from d""",
    "url_hosts": "select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, count(*) as n from pages group by 1",
}
