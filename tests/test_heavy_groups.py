"""Groups too large for one task: same results as for ordinary ones."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmill.operators import metrics, ordered, retention, schedule, streaks
from fleetmill.operators.streaks import final_counters

T0 = datetime(2024, 1, 1)


def skewed_attempts(n=6000, seed=3):
    """A third of all attempts belongs to one pipeline, and a fifth of them share one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pipeline = 7 if rng.random() < 0.34 else rng.randrange(300)
        at = T0 if rng.random() < 0.2 else T0 + timedelta(seconds=rng.randrange(10_000))
        rows.append((i, pipeline, at, rng.random() < 0.35, f"log {i}"))
    return rows


ATTEMPTS = (
    "attempt_id bigint, pipeline_id bigint, attempt_time timestamp_ntz, ok boolean, log string"
)
COUNTERS = "pipeline_id bigint, failure_count int, updated_at timestamp_ntz"


def replay(rows, counters, most=3):
    count = dict(counters)
    out = {}
    for i, p, at, ok, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if ok:
            count.pop(p, None)
            out[i] = (None, 0, "cleared")
            continue
        before = count.get(p, 0)
        if before >= most:
            out[i] = (most, "deactivated")
        else:
            count[p] = before + 1
            out[i] = (before + 1, "failed_to_schedule")
    return out, count


@pytest.mark.parametrize("heavy_rows", [10**9, 200, 1])
def test_failure_streaks_match_a_sequential_replay(spark, heavy_rows):
    rows = skewed_attempts()
    counters = {p: 1 + p % 3 for p in range(0, 300, 2)} | {7: 2, 1000: 3}
    attempts = spark.createDataFrame(rows, ATTEMPTS).repartition(5)
    prior = spark.createDataFrame([(p, c, T0) for p, c in counters.items()], COUNTERS)
    result = streaks.failure_streaks(attempts, prior, heavy_rows=heavy_rows)
    found = {r.attempt_id: r for r in result.collect()}
    expected, left = replay(rows, counters)
    assert len(found) == len(rows)
    for i, want in expected.items():
        r = found[i]
        if r.ok:
            assert (r.failure_number, r.counter, r.event) == want
        else:
            assert (r.counter, r.event) == want
    after = final_counters(result, prior)
    assert {r.pipeline_id: r.failure_count for r in after.collect()} == left


def test_running_and_previous_over_slices(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", i, rng.randrange(-50, 50))
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    sliced = ordered.cut_slices(df, ["k"], ["t"])
    assert sliced.where("k = 'hot'").select("_slice").distinct().count() > 2
    summed = ordered.running(sliced, ["k"], ["t"], F.col("v"), "total")
    both = ordered.running(summed, ["k"], ["t"], F.col("v"), "top", how="max")
    found = ordered.previous(both, ["k"], ["t"], "v", "before").collect()
    groups = defaultdict(list)
    for k, t, v in rows:
        groups[k].append((t, v))
    expected = {}
    for k, values in groups.items():
        total, top, before = 0, None, None
        for t, v in sorted(values):
            total, top = total + v, v if top is None else max(top, v)
            expected[k, t] = (total, top, before)
            before = v
    assert {(r.k, r.t): (r.total, r.top, r.before) for r in found} == expected


def test_null_keys_are_groups_too(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(500)] + [("a", 1, 1)],
                               "k string, t bigint, v bigint")
    light, heavy = ordered.split_heavy(df, ["k"], 100)
    assert light.count() == 1 and heavy.count() == 500
    sliced = ordered.cut_slices(heavy, ["k"], ["t"])
    totals = ordered.running(sliced, ["k"], ["t"], F.col("v"), "total")
    assert sorted(r.total for r in totals.collect()) == list(range(1, 501))


def test_number_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, rng.randrange(100)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(7)
    found = ordered.number_rows(df, ["a", "b"], "n").collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.n)] == sorted(rows)
    assert sorted(r.n for r in found) == list(range(5000))


def test_number_rows_of_nothing(spark):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert ordered.number_rows(df, ["a", "b"], "n").count() == 0


SAMPLES = "event_id bigint, ts timestamp_ntz, kind string, metric string, value double"


def skewed_samples(n=5000):
    rng = random.Random(11)
    return [
        (i, T0 + timedelta(seconds=rng.randrange(3600)), "timer",
         "hot" if rng.random() < 0.4 else f"m{rng.randrange(40)}",
         None if rng.random() < 0.02 else float(rng.randrange(200)) / 4)
        for i in range(n)
    ]


@pytest.mark.parametrize("heavy_rows", [10**9, 500, 1])
def test_percentiles_are_exact(spark, heavy_rows):
    rows = skewed_samples()
    df = spark.createDataFrame(rows, SAMPLES)
    quantiles = tuple(metrics.PERCENTILES)
    found = metrics.metric_percentiles(df, quantiles, heavy_rows=heavy_rows).collect()
    groups = defaultdict(list)
    for _, _, _, metric, value in rows:
        if value is not None:
            groups[metric].append(value)
    assert len(found) == len(groups) * len(quantiles)
    for r in found:
        q = next(q for q, label in metrics.PERCENTILES.items() if label == r.percentile)
        assert r.value == pytest.approx(np.percentile(groups[r.metric], q * 100), abs=1e-9)


def test_approximate_percentiles_are_close(spark):
    df = spark.createDataFrame(skewed_samples(), SAMPLES)
    exact = {(r.metric, r.percentile): r.value for r in metrics.metric_percentiles(df).collect()}
    for r in metrics.metric_percentiles(df, approx=True).collect():
        assert r.value == pytest.approx(exact[r.metric, r.percentile], abs=5)


@pytest.mark.parametrize("heavy_rows", [10**9, 20])
def test_counter_deltas(spark, heavy_rows):
    rng = random.Random(2)
    rows, expected = [], {}
    for metric, n in (("hot", 400), ("a", 5), ("b", 1)):
        value = 0
        for i in range(n):
            grown = rng.randrange(9)
            value += grown
            rows.append(("counter", metric, T0 + timedelta(hours=i), value))
            expected[metric, T0 + timedelta(hours=i)] = grown
    df = spark.createDataFrame(
        rows, "kind string, metric string, report_time timestamp_ntz, value bigint"
    ).repartition(4)
    found = metrics.counter_deltas(df, heavy_rows=heavy_rows).collect()
    assert {(r.metric, r.report_time): r.delta for r in found} == expected


RUNS = "aws_id string, pipeline_id bigint, actual_start timestamp_ntz, health_status string"


@pytest.mark.parametrize("largest, heavy_rows", [(5, 10**9), (20_000, 10**9), (20_000, 50)])
def test_retention_rule(spark, largest, heavy_rows):
    rng = random.Random(9)
    rows = []
    for i in range(4000):
        pipeline = 1 if rng.random() < 0.4 else rng.randrange(2, 40)
        start = T0 + timedelta(days=rng.randrange(300 if pipeline == 1 else 8))
        rows.append((f"df-{i}", pipeline, start, rng.choice(["ERROR", "HEALTHY", None])))
    keep = {p: p % 4 for p in range(40)} | {1: 100, 2: largest}
    runs = spark.createDataFrame(rows, RUNS)
    pipelines = spark.createDataFrame(list(keep.items()), "id bigint, retention int")
    cuts = retention.retention_cuts(runs, pipelines, heavy_rows)
    judged = runs.join(cuts, "pipeline_id").select(
        "aws_id",
        F.when(retention.is_failed(), retention.is_beyond_retention("failed_cut"))
        .otherwise(retention.is_beyond_retention("healthy_cut"))
        .alias("gone"),
    )
    starts = defaultdict(set)
    for _, p, start, health in rows:
        starts[p, health == "ERROR"].add(start)
    for aws_id, gone in judged.collect():
        _, p, start, health = rows[int(aws_id[3:])]
        newest = sorted(starts[p, health == "ERROR"], reverse=True)[: max(keep[p], 0)]
        assert gone == (start not in newest), (p, start)


@pytest.mark.parametrize("n", [3, 60, 1500])
def test_take_due_is_the_head_of_the_order(spark, n):
    rows = [(i, True, None, T0 + timedelta(days=i % 5)) for i in range(2000)]
    df = spark.createDataFrame(
        rows, "id bigint, is_active boolean, end_time timestamp_ntz, next_run_time timestamp_ntz"
    )
    taken = schedule.take_due(df, F.lit("2025-01-01").cast("timestamp_ntz"), n).collect()
    expected = sorted((r[3], r[0]) for r in rows)[:n]
    assert sorted((r.next_run_time, r.id) for r in taken) == expected


def test_latest_starts_limits_ranks_before_the_shuffle(spark):
    rows = [(f"df-{i}", i % 3, T0 + timedelta(days=i % 50), None) for i in range(600)]
    newest = retention.latest_starts(spark.createDataFrame(rows, RUNS), 2)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    found = {(r.pipeline_id, r.start_rank): r.actual_start for r in newest.collect()}
    assert found[0, 1] > found[0, 2] and len(found) == 6


@pytest.mark.parametrize("heavy_rows", [10**9, 10])
def test_latest_starts_with_a_large_k(spark, heavy_rows):
    rows = [(f"df-{i}", i % 3, T0 + timedelta(days=i % 50), None) for i in range(600)]
    runs = spark.createDataFrame(rows, RUNS)
    found = retention.latest_starts(runs, 20_000, heavy_rows).collect()
    expected = set()
    for p in range(3):
        days = sorted({r[2] for r in rows if r[1] == p}, reverse=True)
        expected |= {(p, day, rank + 1) for rank, day in enumerate(days)}
    assert {(r.pipeline_id, r.actual_start, r.start_rank) for r in found} == expected
