"""Stored quantile sketches against exact percentiles."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmill.functions.times import as_timestamp as ts
from fleetmill.operators import metrics, sketches
from fleetmill.operators.datums import SERVICE_SETTINGS
from fleetmill.plans.metric_report import metric_report

T = datetime.datetime(2001, 1, 1)
SAMPLES = "event_id long, ts timestamp_ntz, kind string, metric string, value double"
ALL = tuple(metrics.PERCENTILES)


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(7)
    rows = [("timer", "hot", rng.lognormvariate(0, 2)) for _ in range(30_000)]
    rows += [("histogram", "few", float(i % 90)) for i in range(700)]
    rows += [("timer", "one", 4.0), ("timer", "one", None), ("timer", "one", float("nan"))]
    rows += [("timer", "none", None)]
    rows = [(i, T + datetime.timedelta(seconds=13 * i % 200_000), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, SAMPLES)


def values(df):
    return {(r.metric, r.percentile): r.value for r in df.collect()}


def rank_range(sorted_values, value):
    n = len(sorted_values)
    return np.searchsorted(sorted_values, value) / n, np.searchsorted(sorted_values, value, "right") / n


def test_merged_sketches_stay_within_the_bound(spark, samples, tmp_path):
    path = str(tmp_path / "sketches")
    hours = sketches.interval_sketches(samples)
    sketches.save_sketches(hours, path)
    stored = sketches.load_sketches(spark, path, "2001-01-01", "2001-01-09")
    assert stored.where("metric = 'hot'").count() > 50
    once = sketches.interval_sketches(samples, "365000 days")
    exact = {"hot": [], "few": [], "one": [4.0]}
    for r in samples.where("metric in ('hot', 'few')").collect():
        exact[r.metric].append(r.value)
    by_day = sketches.merged_sketches(stored, "1 day")
    assert by_day.where("metric = 'hot'").count() == 3
    for made in (stored, once, by_day):
        found = values(sketches.sketch_percentiles(made, ALL))
        assert len(found) == 3 * len(ALL)
        for (metric, label), value in found.items():
            low, high = rank_range(np.sort(exact[metric]), value)
            q = next(q for q in ALL if metrics.PERCENTILES[q] == label)
            assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR
            if metric != "hot":  # as many values as a sketch holds: exact
                assert low <= q <= high
    assert {r.metric: r.n for r in sketches.merged_sketches(stored).collect()} == {
        "hot": 30_000, "few": 700, "one": 1
    }


def test_days_are_replaced_and_only_wanted_ones_read(spark, samples, tmp_path):
    path = str(tmp_path / "sketches")
    hours = sketches.interval_sketches(samples)
    sketches.save_sketches(hours, path)
    before = {p for p in (tmp_path / "sketches").rglob("*.parquet")}
    sketches.save_sketches(hours.where("to_date(interval_start) = '2001-01-02'"), path)
    gone = before - {p for p in (tmp_path / "sketches").rglob("*.parquet")}
    assert gone and {p.parent.name for p in gone} == {"day=2001-01-02"}
    one = sketches.load_sketches(spark, path, "2001-01-02", "2001-01-02")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert one.agg(F.sum("n")).first()[0] == samples.where(
        "to_date(ts) = '2001-01-02' and value is not null and not isnan(value)"
    ).count()


def test_a_report_from_sketches(spark, samples):
    known = samples.where("metric = 'few'")
    hours = sketches.interval_sketches(known)
    report = metric_report(known, ts("2001-01-04 00:00:00"), SERVICE_SETTINGS, sketches=hours)
    plain = metric_report(known, ts("2001-01-04 00:00:00"), SERVICE_SETTINGS)
    assert report.columns == plain.columns and report.count() == plain.count()


def test_empty_and_unknown(spark, samples):
    none = sketches.interval_sketches(samples.limit(0))
    assert sketches.sketch_percentiles(none).count() == 0
    with pytest.raises(ValueError):
        sketches.sketch_percentiles(none, (0.123,))
