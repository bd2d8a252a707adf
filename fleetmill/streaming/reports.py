"""ST2 and ST3: counts and statistics per report interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetmill.functions import times
from fleetmill.operators.metrics import METRIC, moment_aggregates, statistic_aggregates

LATENESS = "1 hour"


def _per_interval(samples: DataFrame, interval: str, lateness: str) -> GroupedData:
    """Samples grouped by metric and interval. Watermarks need an instant, so ``ts`` becomes the
    one it is in UTC, whatever the session's zone."""
    instants = samples.withColumn("ts", times.to_instant(F.col("ts")))
    return instants.withWatermark("ts", lateness).groupBy(
        F.window("ts", interval).alias("w"), *METRIC
    )


def _report_time() -> Column:
    return times.from_instant(F.col("w.end")).alias("report_time")


def stream_counter_deltas(
    samples: DataFrame, interval: str, lateness: str = LATENESS
) -> DataFrame:
    """ST2: events per metric and report interval.

    The growth of a counter in an interval is the number of its events there, so nothing has to
    be remembered beyond the open intervals. Samples later than ``lateness`` are dropped.
    """
    counted = _per_interval(samples, interval, lateness).agg(F.count(F.lit(1)).alias("delta"))
    return counted.select(_report_time(), *METRIC, "delta")


def stream_metric_report(
    samples: DataFrame, interval: str, lateness: str = LATENESS, factor: float = 1.0
) -> DataFrame:
    """ST3: statistic set, mean and deviation per metric and report interval."""
    figures = _per_interval(samples.where(F.col("value").isNotNull()), interval, lateness).agg(
        *statistic_aggregates(factor), *moment_aggregates(factor)
    )
    return figures.select(
        _report_time(),
        *METRIC,
        "sum",
        "sample_count",
        "minimum",
        "maximum",
        "mean",
        "std_dev",
    )


def append_to(path: str, results: DataFrame) -> DataStreamWriter:
    """Writes closed intervals below ``path``; each is written once."""
    return results.writeStream.format("parquet").outputMode("append").option("path", path)
