"""Last values by hash aggregation, events of unknown pipelines, and ranks beyond the pushed limit."""

import datetime

import pytest
from pyspark.sql import functions as F

from fleetmill.operators import metrics, notifications, retention, streaks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at(second):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=second)


SAMPLES = "kind string, metric string, ts timestamp_ntz, event_id long, reading string"


def test_gauges_only_and_hashed(spark):
    rows = [
        ("gauge", "a", at(1), 9, "1.5"),
        ("gauge", "a", at(2), 1, "2.5"),
        ("gauge", "a", at(2), 3, "3.5"),
        ("gauge", "b", at(1), 1, "4"),
        ("gauge", "b", at(5), 1, "n/a"),
        ("counter", "c", at(1), 1, "7"),
    ]
    found = metrics.metric_gauges(spark.createDataFrame(rows, SAMPLES), "reading")
    assert [(r.metric, r.value) for r in found.collect()] == [("a", 3.5)]
    assert "SortAggregate" not in plan(found)


def test_final_counters_hash(spark):
    rows = [(1, 0, at(9), 2), (1, 3, at(9), 5), (2, 0, at(1), 1)]
    replayed = spark.createDataFrame(
        rows, "pipeline_id long, counter int, attempt_time timestamp_ntz, attempt_id long"
    )
    before = spark.createDataFrame(
        [(2, 1, at(0)), (3, 2, at(0))],
        "pipeline_id long, failure_count int, updated_at timestamp_ntz",
    )
    found = streaks.final_counters(replayed, before)
    assert "SortAggregate" not in plan(found)
    assert sorted((r.pipeline_id, r.failure_count) for r in found.collect()) == [(1, 3), (3, 2)]


def test_events_of_unknown_pipelines_are_kept(spark):
    events = spark.createDataFrame([(1, "x"), (2, "y")], "pipeline_id long, event string")
    known = spark.createDataFrame([(1, "p", None)], "id long, name string, owner string")
    found = notifications.route_notifications(events, known, ["a@b.c"]).orderBy("pipeline_id")
    assert [(r.pipeline_id, r.medium, r.recipients) for r in found.collect()] == [
        (1, "email", "a@b.c"),
        (2, "invalid", None),
    ]


@pytest.mark.parametrize("k", [1, 999, 1_000, 1_001, 5_000, 20_000])
def test_newest_starts_for_any_k(spark, k):
    rows = spark.range(6_000).select(
        (F.col("id") % 2).alias("pipeline_id"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0)").alias(
            "actual_start"
        ),
    )
    found = retention.latest_starts(rows, k, heavy_rows=500)
    assert found.count() == 2 * min(k, 3_000)
    if k <= 1_000:
        assert "WindowGroupLimit" in plan(found)


@pytest.mark.parametrize("limit", ["1000", "3", "-1"])
def test_cuts_follow_the_limit_of_the_session(spark, limit):
    starts = spark.range(3_000).select(
        (F.col("id") % 2).alias("pipeline_id"),
        F.lit(None).cast("string").alias("health_status"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0)").alias(
            "actual_start"
        ),
    )
    pipelines = spark.createDataFrame([(0, 2), (1, 1_200), (2, 1)], "id long, retention int")
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        cuts = retention.retention_cuts(starts, pipelines, heavy_rows=200).collect()
    finally:
        spark.conf.set(name, before)
    minutes = {
        r.pipeline_id: r.healthy_cut and (r.healthy_cut - at(0)).total_seconds() / 60 for r in cuts
    }
    assert minutes == {0: 2_996, 1: 2_999 - 2 * 1_199, 2: None}
