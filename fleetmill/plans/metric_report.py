"""Metric samples to batches of data points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators import datums as points
from fleetmill.operators import metrics
from fleetmill.operators.datums import UNIT_SECONDS, ReportSettings
from fleetmill.operators.metrics import HEAVY_METRIC_ROWS
from fleetmill.operators.sketches import sketch_percentile_arrays
from fleetmill.session import materialize


def metric_figures(
    samples: DataFrame,
    as_of: Column,
    settings: ReportSettings,
    reported: DataFrame | None = None,
    heavy_rows: int = HEAVY_METRIC_ROWS,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """All figures of each metric in one row.

    One aggregation gives what combines, and is written out: its counts also tell which metrics
    are too heavy for the built-in percentile. Percentiles and moving rates are aggregated on
    their own and joined per metric. Only the kinds that have them are read for them. Given
    ``sketches`` of intervals, percentiles are those of the intervals closed by ``as_of``.
    """
    known = samples.where(F.col("ts") <= as_of)
    timer = F.col("kind") == "timer"
    factor = F.when(timer, settings.duration_factor).otherwise(1.0)
    unit_seconds = UNIT_SECONDS[settings.rate_unit]
    key = metrics.METRIC
    base = materialize(
        known.groupBy(*key).agg(
            F.max_by("value", times.packed_order(F.col("ts"), F.col("event_id"))).alias("gauge"),
            F.count(F.lit(1)).alias("count"),
            *metrics.statistic_aggregates(factor),
            *metrics.moment_aggregates(factor),
            F.min("ts").alias("_first"),
        )
    )
    sizes = base.where(F.col("kind").isin("histogram", "timer")).select(*key, "count")
    base = base.withColumn(
        "mean_rate", metrics.mean_rate(F.col("count"), F.col("_first"), as_of, unit_seconds)
    )
    if not settings.raw_counts and reported is not None:
        before = reported.select(*key, F.col("count").alias("_before"))
        since = F.col("count") - F.coalesce("_before", F.lit(0))
        base = base.join(before, key, "left").withColumn("count", since).drop("_before")
    figures = base
    if settings.percentiles:
        has_percentiles = F.col("kind").isin("histogram", "timer")
        if sketches is not None:
            closed = sketches.where(has_percentiles & (F.col("interval_end") <= as_of))
            quantiles = sketch_percentile_arrays(closed, settings.percentiles)
        else:
            quantiles = metrics.percentile_arrays(
                known.where(has_percentiles),
                settings.percentiles,
                settings.approximate,
                heavy_rows=heavy_rows,
                sizes=sizes,
            )
        scaled = F.transform("quantile_values", lambda v: v * factor)
        figures = figures.join(quantiles, key, "left").withColumn("quantile_values", scaled)
    else:
        figures = figures.withColumn("quantile_values", F.lit(None).cast("array<double>"))
    rates = metrics.metric_ewma_rates(
        known.where(F.col("kind").isin("meter", "timer")), as_of, unit_seconds=unit_seconds
    )
    return figures.join(rates, key, "left").drop("_first")


def metric_report(
    samples: DataFrame,
    as_of: Column,
    settings: ReportSettings = points.SERVICE_SETTINGS,
    reported: DataFrame | None = None,
    heavy_rows: int = HEAVY_METRIC_ROWS,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """The data points of one report, cleaned, with dimensions and batch numbers.

    A name is decoded once per metric, and dimensions are put together after the numbering, so
    what is sorted for the batches stays narrow.
    """
    figures = metric_figures(samples, as_of, settings, reported, heavy_rows, sketches)
    named = points.decode_dimensions(figures)
    staged = points.stage_datums(named, settings, as_of, ("metric_name", "dimensions"))
    batched = points.batch_datums(points.clean_values(staged))
    return points.global_dimensions(batched, settings.global_dimensions)
