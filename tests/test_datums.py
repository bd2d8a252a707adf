"""Metric figures and data points."""

import math
import random
from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators import datums, metrics
from fleetmill.plans.metric_report import metric_report
from fleetmill.sources.datums import write_datums

T0 = datetime(2024, 1, 1)
SAMPLES = "event_id bigint, ts timestamp_ntz, kind string, metric string, value double"


def moving_rates(offsets, as_of, minutes, tick=5.0):
    """A meter that is updated tick by tick, by its textbook definition."""
    alpha = 1 - math.exp(-tick / 60 / minutes)
    counts = defaultdict(int)
    for s in offsets:
        counts[int(s // tick)] += 1
    rate = None
    for i in range(min(counts), int(as_of // tick)):
        now = counts[i] / tick
        rate = now if rate is None else rate + alpha * (now - rate)
    return rate or 0.0


@pytest.mark.parametrize("as_of", [3600, 3604.5, 12, 5000])
def test_moving_rates_equal_a_meter(spark, zone, as_of):
    rng = random.Random(as_of)
    rows, expected = [], {}
    for m in range(5):
        offsets = [rng.uniform(m * 2, min(as_of, 3600)) for _ in range(40)]
        rows += [(i, T0 + timedelta(seconds=s), "meter", f"m{m}", 1.0) for i, s in enumerate(offsets)]
        expected[f"m{m}"] = [moving_rates(offsets, as_of, k) for k in (1, 5, 15)]
    late = T0 + timedelta(seconds=as_of + 60)
    rows.append((99, late, "meter", "m0", 1.0))
    df = spark.createDataFrame(rows, SAMPLES)
    found = metrics.metric_ewma_rates(df, times.as_timestamp(T0 + timedelta(seconds=as_of)))
    for r in found.collect():
        assert [r.rate_1m, r.rate_5m, r.rate_15m] == pytest.approx(expected[r.metric], abs=1e-12)


def test_mean_rate(spark):
    rows = [(i, T0 + timedelta(seconds=i), "meter", "m", 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, SAMPLES)
    as_of = times.as_timestamp(T0 + timedelta(seconds=20))
    assert metrics.metric_mean_rate(df, as_of).first().mean_rate == 0.5
    assert metrics.metric_mean_rate(df, as_of, 60).first().mean_rate == 30
    assert metrics.metric_mean_rate(df, times.as_timestamp(T0)).first().mean_rate is None


def test_gauge_is_the_last_value_if_it_is_a_number(spark):
    rows = [("a", 1, "1"), ("a", 2, "2.5"), ("b", 1, "1"), ("b", 2, "n/a"), ("c", 1, None)]
    df = spark.createDataFrame(
        [(t, T0, "gauge", m, v) for m, t, v in rows],
        "event_id bigint, ts timestamp_ntz, kind string, metric string, value string",
    )
    assert {r.metric: r.value for r in metrics.metric_gauges(df).collect()} == {"a": 2.5}


def test_moments_of_one_sample(spark):
    df = spark.createDataFrame([(1, T0, "timer", "m", 4.0)], SAMPLES)
    row = metrics.metric_moments(df, 0.5).first()
    assert (row["mean"], row.std_dev) == (2.0, 0.0)


def test_unknown_percentile(spark):
    with pytest.raises(ValueError):
        metrics.metric_percentiles(spark.createDataFrame([], SAMPLES), (0.33,))


@pytest.mark.parametrize(
    "text, name, dimensions",
    [
        ("plain.name", "plain.name", {}),
        ("a.b[k:v]", "a.b", {"k": "v"}),
        ("a[k:v, x : y z ,n]", "a", {"k": "v", "x": "y z"}),
        ("old a[k:v,k:w]", "a", {"k": "w"}),
        ("a[k:v:w]tail", "a", {"k": "v"}),
        ("a[b]c]", "a", {}),
        ("a[]", "a[]", {}),
        ("[k:v]", "[k:v]", {}),
    ],
)
def test_decoding(spark, text, name, dimensions):
    row = datums.decode_dimensions(spark.createDataFrame([(text,)], "metric string")).first()
    assert (row.metric_name, row.dimensions) == (name, dimensions)


def test_own_dimensions_go_before_global_ones(spark):
    df = spark.createDataFrame([("a[Stack:mine,k:v]", "count"), ("b", "gauge")],
                               "metric string, datum_type string")
    merged = datums.global_dimensions(
        datums.decode_dimensions(df), ("Stack=x", "Env = test", "Type=ignored")
    )
    found = {r.metric[0]: r.dimensions for r in merged.collect()}
    assert found["a"] == {"Stack": "mine", "Env": "test", "Type": "count", "k": "v"}
    assert found["b"] == {"Stack": "x", "Env": "test", "Type": "gauge"}
    with pytest.raises(ValueError):
        datums.global_dimensions(df, ("nothing",))


def test_clean_values(spark):
    inf, nan = float("inf"), float("nan")
    given = [0.0, 1.5, -1.5, 1e-200, -1e-200, 1e200, -1e200, nan, inf, -inf, None]
    low, high = datums.SMALLEST_VALUE, datums.LARGEST_VALUE
    df = spark.createDataFrame(list(enumerate(given)), "i int, value double")
    found = {r.i: r.value for r in datums.clean_values(df).collect()}
    assert found == {0: 0.0, 1: 1.5, 2: -1.5, 3: low, 4: -low, 5: high, 6: -high, 10: None}


def all_kinds():
    rows, i = [], 0
    for kind in datums.KINDS:
        for m in range(7):
            for s in range(3):
                rows.append((i, T0 + timedelta(seconds=i), kind, f"{kind}{m}[n:{m}]", float(s * m)))
                i += 1
    return rows


def test_report(spark, tmp_path):
    df = spark.createDataFrame(all_kinds(), SAMPLES)
    as_of = times.as_timestamp(T0 + timedelta(seconds=200))
    rows = metric_report(df, as_of).collect()
    per_kind = {"gauge": 1, "counter": 1, "histogram": 6, "meter": 5, "timer": 10}
    assert len(rows) == 7 * sum(per_kind.values())
    ordered = sorted(rows, key=lambda r: r.datum_number)
    assert [r.datum_number for r in ordered] == list(range(len(rows)))
    assert [r.batch for r in ordered] == [i // 20 for i in range(len(rows))]
    assert [r.kind for r in ordered] == sorted(
        (r.kind for r in rows), key=list(datums.KINDS).index
    )
    timer = {r.datum_type: r for r in rows if r.metric == "timer3[n:3]"}
    assert set(timer) == {
        "75%", "99%", "snapshot-mean [in-milliseconds]", "snapshot-std-dev [in-milliseconds]",
        "snapshot-summary", "1-min-mean-rate [per-second]", "5-min-mean-rate [per-second]",
        "15-min-mean-rate [per-second]", "mean-rate [per-second]", "count",
    }
    summary = timer["snapshot-summary"]
    assert summary.value is None and tuple(summary.statistics) == (9.0, 3.0, 0.0, 6.0)
    assert (timer["count"].unit, timer["75%"].unit, timer["mean-rate [per-second]"].unit) == (
        "Count", "Milliseconds", "Bytes",
    )
    assert timer["count"].dimensions == {"Type": "count", "n": "3"}
    assert {r.resolution for r in rows} == {1}
    write_datums(metric_report(df, as_of), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == len(rows)


def test_report_leaves_out_zeros_and_reports_growth(spark):
    df = spark.createDataFrame(all_kinds(), SAMPLES)
    as_of = times.as_timestamp(T0 + timedelta(seconds=200))
    reported = df.groupBy("kind", "metric").agg(F.count("*").alias("count")).where(
        "metric <> 'counter1[n:1]'"
    )
    rows = metric_report(df, as_of, datums.ReportSettings(statistic_set=True), reported).collect()
    assert {r.metric for r in rows if r.datum_type == "count"} == {"counter1[n:1]"}
    assert not any(r.value == 0 for r in rows)
    assert {r.metric for r in rows if r.metric.startswith("histogram0")} == {"histogram0[n:0]"}
    assert [r.datum_type for r in rows if r.metric == "histogram0[n:0]"] == ["snapshot-summary"]


@pytest.mark.parametrize("heavy_rows", [10**9, 1])
def test_report_of_heavy_metrics_is_the_same(spark, heavy_rows):
    df = spark.createDataFrame(all_kinds(), SAMPLES)
    as_of = times.as_timestamp(T0 + timedelta(seconds=200))
    settings = replace(datums.SERVICE_SETTINGS, percentiles=(0.5, 0.75, 0.999))
    rows = metric_report(df, as_of, settings, heavy_rows=heavy_rows).collect()
    found = {(r.metric, r.datum_type): r.value for r in rows}
    assert found["timer6[n:6]", "50%"] == 6.0
    assert found["timer6[n:6]", "75%"] == 9.0
    assert found["histogram6[n:6]", "99.9%"] == pytest.approx(11.988)
