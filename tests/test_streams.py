"""Streams give what their batch operators give, over several micro-batches and after a restart."""

import random
import time
from datetime import datetime, timedelta

from fleetmill.operators import streaks
from fleetmill.streaming import streaks as stream_module
from fleetmill.streaming.reports import append_to, stream_counter_deltas, stream_metric_report
from fleetmill.streaming.streaks import stored_counters, stream_failure_streaks

T0 = datetime(2024, 1, 1)
ATTEMPTS = (
    "attempt_id bigint, pipeline_id bigint, attempt_time timestamp_ntz, ok boolean, log string"
)
COUNTERS = "pipeline_id bigint, failure_count int, updated_at timestamp_ntz"
SAMPLES = "event_id bigint, ts timestamp_ntz, kind string, metric string, value double"


def feed(spark, rows, schema, path, parts):
    """One file per part, in time order."""
    size = len(rows) // parts + 1
    for i in range(0, len(rows), size):
        df = spark.createDataFrame(rows[i : i + size], schema)
        df.coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(writer, log):
    writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def test_streaks_carry_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        (i, 5 if rng.random() < 0.4 else rng.choice([*range(20), None]), T0 + timedelta(minutes=i),
         rng.choice([True, False, False, None]), rng.choice(["log", None]))
        for i in range(400)
    ]
    counters = spark.createDataFrame([(5, 2, T0), (77, 1, T0), (78, 0, T0)], COUNTERS)
    fed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def go():
        streamed = stream_failure_streaks(source(spark, fed, ATTEMPTS), counters)
        finish(append_to(out, streamed), log)

    feed(spark, rows[:250], ATTEMPTS, fed, 3)
    go()
    feed(spark, rows[250:], ATTEMPTS, fed, 2)
    go()
    batch = streaks.failure_streaks(spark.createDataFrame(rows, ATTEMPTS), counters)
    named = batch.where("pipeline_id is not null")
    streamed = spark.read.parquet(out)
    assert dict(streamed.dtypes) == dict(batch.dtypes)
    assert sorted(map(tuple, streamed.select(batch.columns).collect()), key=str) == sorted(
        map(tuple, batch.collect()), key=str
    )
    ended = streaks.final_counters(named, counters).where("failure_count > 0")
    kept = stored_counters(spark, log).where("pipeline_id is not null")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, ended.collect()))


def test_pipelines_that_share_a_bucket_have_counters_of_their_own(spark, tmp_path, monkeypatch):
    # A group per pipeline took 30 ms each, in every micro-batch.
    monkeypatch.setattr(stream_module, "BUCKETS", 3)
    rng = random.Random(2)
    rows = [
        (i, rng.choice([*range(40), None]), T0 + timedelta(minutes=rng.randrange(200)),
         rng.choice([True, False, False, None]), rng.choice(["log", None]))
        for i in range(900)
    ]
    rows.sort(key=lambda r: (r[2], r[0]))
    counters = spark.createDataFrame([(k, k % 4, T0) for k in range(0, 60, 2)], COUNTERS)
    fed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for part in (rows[:300], rows[300:]):
        feed(spark, part, ATTEMPTS, fed, 2)
        finish(append_to(out, stream_failure_streaks(source(spark, fed, ATTEMPTS), counters)), log)
    batch = streaks.failure_streaks(spark.createDataFrame(rows, ATTEMPTS), counters)
    found = spark.read.parquet(out).select(batch.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, batch.collect()), key=str)
    ended = streaks.final_counters(batch.where("pipeline_id is not null"), counters).where("failure_count > 0")
    kept = stored_counters(spark, log).where("pipeline_id is not null")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, ended.collect()))
    state = spark.read.format("statestore").option("stateVarName", "counter").load(log)
    assert state.select("key").distinct().count() <= 3 < kept.count()


def test_a_batch_touches_only_the_counters_of_its_pipelines(spark, tmp_path):
    counters = spark.createDataFrame([(k, 1, T0) for k in range(500)], COUNTERS)
    fed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    written = []
    for batch in range(3):
        feed(spark, [(batch, 3, T0, False, "x")], ATTEMPTS, fed, 1)
        streamed = stream_failure_streaks(source(spark, fed, ATTEMPTS), counters)
        query = append_to(out, streamed).option("checkpointLocation", log)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        written.append(query.lastProgress["stateOperators"][0]["numRowsUpdated"])
    assert written[0] >= 500 and written[1:] == [1, 1]
    assert stored_counters(spark, log).count() == 500


def test_idle_counters_are_forgotten(spark, tmp_path):
    counters = spark.createDataFrame([], COUNTERS)
    fed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    spark.createDataFrame([], ATTEMPTS).write.parquet(fed)
    streamed = stream_failure_streaks(source(spark, fed, ATTEMPTS), counters, idle=2)
    writer = append_to(out, streamed).option("checkpointLocation", log)
    # Time-to-live goes by the clock, so this stream does not end by itself.
    query = writer.trigger(processingTime="200 milliseconds").start()
    try:
        for batch in range(2):
            feed(spark, [(batch, 3, T0, False, "x")], ATTEMPTS, fed, 1)
            for _ in range(150):
                if spark.read.schema(streamed.schema).parquet(out).count() > batch:
                    break
                time.sleep(0.2)
            time.sleep(3)
    finally:
        query.stop()
    assert [r.failure_number for r in spark.read.parquet(out).collect()] == [1, 1]


def test_reports_per_interval_drop_late_samples(spark, tmp_path, zone):
    rows = [(i, T0 + timedelta(minutes=i), "timer", f"m{i % 2}", float(i)) for i in range(180)]
    late = [(900, T0 + timedelta(minutes=1), "timer", "m0", 5.0),
            (901, T0 + timedelta(minutes=179), "timer", "m0", None),
            (902, T0 + timedelta(minutes=400), "timer", "m0", 1.0)]
    fed = str(tmp_path / "in")
    feed(spark, rows, SAMPLES, fed, 3)
    feed(spark, late, SAMPLES, fed, 1)
    results = {
        "deltas": stream_counter_deltas(source(spark, fed, SAMPLES), "1 hour", "10 minutes"),
        "stats": stream_metric_report(source(spark, fed, SAMPLES), "1 hour", "10 minutes", 0.5),
    }
    found = {}
    for name, result in results.items():
        finish(append_to(str(tmp_path / name), result), str(tmp_path / f"{name}-log"))
        rows_out = spark.read.schema(result.schema).parquet(str(tmp_path / name)).collect()
        found[name] = {(r.report_time, r.metric): r for r in rows_out}
    hours = [T0 + timedelta(hours=h) for h in (1, 2, 3)]
    assert set(found["deltas"]) == {(h, m) for h in hours for m in ("m0", "m1")}
    assert found["deltas"][hours[0], "m0"].delta == 30
    assert found["deltas"][hours[2], "m0"].delta == 31
    stats = found["stats"][hours[1], "m1"]
    assert (stats.sum, stats.sample_count, stats.minimum, stats.maximum) == (
        sum(range(61, 120, 2)) / 2, 30.0, 30.5, 59.5,
    )
    assert stats["mean"] == 45.0
