"""Review, guards, drift generators, sources, sinks and streams on small cases."""

import difflib
import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sedimentry.operators import drift, guards, reconcile, review, telemetry
from sedimentry.plans import catalogue
from sedimentry.sources import files, generators
from sedimentry.streaming import heal


def test_queue_takes_the_first_pending(spark):
    queue = spark.createDataFrame([(1, "a", "x", 0.5), (2, "b", "y", 0.6), (3, "a", "z", 0.7)], "seq long, raw_field string, suggested_match string, confidence_score double")
    made = spark.createDataFrame([(9, "a", "approve", None), (10, "nobody", "approve", None), (11, "b", "correct", "w")], "seq long, raw_field string, action string, correction string")
    done = review.decide(queue, made)
    assert [r.seq for r in review.pending(done).collect()] == [3]
    got = {r.seq: (r.feedback_type, r.human_correction) for r in review.as_feedback(done).collect()}
    assert got == {1: ("approved", None), 2: ("corrected", "w")}


def test_too_little_feedback(spark):
    rows = spark.createDataFrame([(1, "f", "s", "c", "corrected", 0.4, "u")], "seq long, raw_field string, suggested_match string, human_correction string, feedback_type string, confidence_score double, session_id string")
    plan = review.retraining_plan(rows).first()
    assert not plan.ready and plan.threshold is None and plan.commonest is None


def test_guards(spark):
    with pytest.raises(guards.EmptyBatch):
        guards.non_empty(spark.createDataFrame([], "a int"))
    df = spark.createDataFrame([("costs $4",), ("free",)], "t string")
    with pytest.raises(Exception, match="no '\\$' in: free"):
        df.select(guards.require(F.col("t"), "$")).collect()
    with pytest.raises(TypeError):
        guards.records_of(df, "t", "k")
    assert guards.register_functions(spark) == ("safe_number", "review_level", "edit_share")
    assert tuple(spark.sql("select safe_number(' 4 '), safe_number('x'), review_level(0.5), edit_share('abc', 'abd')").first())[:3] == (4.0, None, "warning")


def test_history_is_newest_first(spark):
    got = catalogue.QUERIES["correction_history"](spark, SF).collect()
    stamps = {r.event_id: r.ts for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts").collect()}
    keys = [(stamps[r.seq], -r.seq) for r in got]
    assert len(keys) > 1 and keys == sorted(keys, reverse=True)


def test_ratio_match_against_brute_force(spark):
    from sedimentry.plans import fixtures

    got = {r.raw: (r.match, r.confidence) for r in catalogue.QUERIES["ratio_match_top1"](spark, SF).collect()}
    names = [r.raw for r in fixtures.names(spark, SF).collect()]
    for raw in names:
        scores = [difflib.SequenceMatcher(None, t.lower(), raw.lower()).ratio() for t in fixtures.TARGETS]
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        assert got[raw] == (fixtures.TARGETS[best], pytest.approx(scores[best], abs=1e-6)), raw
    assert len(names) == len(got)


def test_long_schema_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)], "vec_id long, embedding array<double>")
    targets = spark.createDataFrame([(f"t{k}", k, [float(k), 1.0, 0.5]) for k in range(9)], "target string, idx int, g array<double>")
    whole = sorted(map(tuple, reconcile.best_vector(rows, targets).collect()))
    monkeypatch.setattr(reconcile._blocks, "__defaults__", (2,))
    assert sorted(map(tuple, reconcile.best_vector(rows, targets).collect())) == whole


def test_scorers_by_name():
    assert reconcile.scorer("pattern") is reconcile.pattern_score
    with pytest.raises(ValueError, match="unknown method"):
        reconcile.scorer("guess")


def test_calibration_reaches_the_target():
    accuracy = {"a": 0.6, "b": 0.9, "c": 0.7}
    for target in (0.65, 0.75, 0.88):
        got = drift.calibrated({"a": 0.4, "b": 0.3, "c": 0.3}, accuracy, target)
        assert sum(got.values()) == pytest.approx(1) and sum(got[k] * accuracy[k] for k in got) == pytest.approx(target, abs=1e-6)
    assert sum(x * accuracy[k] for k, x in drift.calibrated({"a": 0.5, "b": 0.5, "c": 0.1}, accuracy, 1.0).items()) == pytest.approx(0.9, abs=1e-6)
    assert drift.calibrated({"a": 1.0}, {"a": 0.5}, 0.9) == {"a": 1.0}


def test_thinning_bounds(spark):
    rows = spark.range(2000)
    assert drift.thinned(rows, F.col("id"), 0.0).count() == 0 and drift.thinned(rows, F.col("id"), 1.0).count() == 2000
    with pytest.raises(ValueError):
        drift.thinned(rows, F.col("id"), 1.5)


def test_noise_leaves_signals_positive(spark):
    g = telemetry.grid_session(spark, telemetry.demo_session(2, laps=12))
    low = g.agg(*[F.min(c).alias(c) for c in ("heart_rate_bpm", "hrv_ms", "skin_conductance", "respiration_rate")]).first()
    assert all(x > 0 for x in low)
    stopped = g.where("is_pit_stop = 1").agg(F.countDistinct("distance_m").alias("places"), F.max("speed_kph").alias("speed")).first()
    assert stopped.places == 1 and stopped.speed == 0


def test_csv_appends_or_creates(spark, tmp_path):
    path = str(tmp_path / "rows")
    files.append_csv(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    files.append_csv(spark.createDataFrame([(2, "b")], "k int, v string"), path)
    assert sorted(map(tuple, files.csv(spark, path, "k int, v string").collect())) == [(1, "a"), (2, "b")]
    files.write_csv(spark.createDataFrame([(3, "c")], "k int, v string"), path, single=True)
    assert files.csv(spark, path).collect() == [(3, "c")]


def test_json_lines_and_reports(spark, tmp_path):
    path = str(tmp_path / "lines")
    files.append_json(spark.createDataFrame([(1,)], "k int"), path)
    files.append_json(spark.createDataFrame([(2,)], "k int"), path)
    assert sorted(r.k for r in files.json_lines(spark, path, "k int").collect()) == [1, 2]
    files.write_report(spark.createDataFrame([(True, 7)], "ready boolean, n int"), str(tmp_path / "report"))
    row = spark.read.json(str(tmp_path / "report")).first()
    import hashlib

    assert json.loads(row.body) == {"ready": True, "n": 7} and row.signature == hashlib.sha256(row.body.encode()).hexdigest()


def test_messy_records_widen(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2.5, "c": {"d": 1}}',)], "value string")
    got = files.messy_records(spark, lines)
    assert set(got.columns) == {"a", "b", "c"} and sorted(float(r.a) for r in got.collect()) == [1.0, 2.5]
    assert files.messy_records(spark, lines.where("false")).count() == 0


def test_generators(spark):
    got = generators.vitals(spark, 100).collect()
    assert len(got) == 100 and {len(r.measures) for r in got} == {3} and len({r.vendor for r in got}) > 1
    stream = telemetry.packets(generators.packet_stream(spark, 10))
    assert stream.isStreaming and {"imu", "gps", "sample_id"} <= set(stream.columns)


def _recording(spark, path, files_=3):
    for k in range(files_):
        rows = [(f"d{i % 2}", k * 4 + i, "lateral" if i % 2 else "gx", float(i)) for i in range(4)]
        spark.createDataFrame(rows, "Driver_ID string, Sample_ID long, Raw_Key string, Value double").coalesce(1).write.mode("append").json(path)


def test_replay_keeps_a_rolling_view(spark, tmp_path):
    path = str(tmp_path / "in")
    _recording(spark, path)
    stream = files.replay(spark, path, "Driver_ID string, Sample_ID long, Raw_Key string, Value double", 1, {"value": "reading"})
    assert stream.columns == ["driver_id", "sample_id", "raw_key", "reading"]
    query = heal.rolling_view(stream, "sample_id", 5, str(tmp_path / "view"), str(tmp_path / "mark"))
    query.awaitTermination(120)
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [4, 4, 4]
    last = spark.read.parquet(str(tmp_path / "view" / "batch=2"))
    assert sorted(r.sample_id for r in last.collect()) == [7, 8, 9, 10, 11]


def test_side_stream_of_learned_keys(spark, tmp_path):
    path = str(tmp_path / "in")
    _recording(spark, path, 2)
    stream = files.replay(spark, path, "Driver_ID string, Sample_ID long, Raw_Key string, Value double")
    healed = heal.heal(stream, lambda raw: ("gy", 0.9) if raw == "lateral" else (None, 0.0))
    heal.with_events(healed, str(tmp_path / "rows"), str(tmp_path / "events"), str(tmp_path / "mark")).awaitTermination(120)
    rows, events = (spark.read.parquet(str(tmp_path / x)) for x in ("rows", "events"))
    assert rows.count() == 8 and {r.healed_key for r in rows.collect()} == {"gx", "gy"}
    assert [(r.driver_id, r.raw_key, r.healed_key) for r in events.collect()] == [("d1", "lateral", "gy")]


def test_streaming_sessions_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = heal.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("session_rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.user_id, r.began): r.n for r in spark.table("session_rows").collect()}
    want = {(r.user_id, r.began): r.n for r in heal.sessions(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())
