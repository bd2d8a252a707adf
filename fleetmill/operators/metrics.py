"""Metric samples to figures.

``samples(event_id, ts, kind, metric, value)`` has one row per recorded value, of kind ``gauge``,
``counter``, ``histogram``, ``meter`` or ``timer``. All figures but exact percentiles are
aggregates that combine before the shuffle, so a metric with a third of all samples costs its
reducer one row per map task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators.ordered import (
    HEAVY_GROUP_ROWS,
    cut_slices,
    per_group,
    previous,
    running,
    split_heavy,
)
from fleetmill.session import lookup

#: The built-in exact percentile holds the distinct values of up to 128 groups in memory before it
#: sorts instead, so a group must be small.
HEAVY_METRIC_ROWS = 100_000

METRIC = ["kind", "metric"]

# The percentiles that can be reported, with their labels.
PERCENTILES = {
    0.50: "50%",
    0.75: "75%",
    0.95: "95%",
    0.98: "98%",
    0.99: "99%",
    0.995: "99.5%",
    0.999: "99.9%",
}
DEFAULT_PERCENTILES = (0.75, 0.95, 0.999)
SERVICE_PERCENTILES = (0.75, 0.99)

#: Seconds between two updates of a moving rate, and the minutes it looks back.
TICK_SECONDS = 5
RATE_MINUTES = (1, 5, 15)


def metric_gauges(samples: DataFrame, value: str = "value") -> DataFrame:
    """The last value of each gauge; none if that is null or not a number."""
    number = F.col(value).try_cast("double")
    last = times.packed_order(F.col("ts"), F.col("event_id"))
    return (
        samples.where(F.col("kind") == "gauge")
        .groupBy(*METRIC)
        .agg(F.max_by(number, last).alias("value"))
        .where(F.col("value").isNotNull())
    )


def metric_counts(samples: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Events per metric: in total, or since the totals in ``reported(…, count)``."""
    counts = samples.groupBy(*METRIC).agg(F.count(F.lit(1)).alias("count"))
    if reported is None:
        return counts
    before = reported.select(*METRIC, F.col("count").alias("_before"))
    since = F.col("count") - F.coalesce("_before", F.lit(0))
    return counts.join(before, METRIC, "left").select(*METRIC, since.alias("count"))


def statistic_aggregates(factor: Column | float = 1.0) -> list[Column]:
    scale = factor if isinstance(factor, Column) else F.lit(factor)
    return [
        (F.sum("value") * scale).alias("sum"),
        F.count("value").cast("double").alias("sample_count"),
        (F.min("value") * scale).alias("minimum"),
        (F.max("value") * scale).alias("maximum"),
    ]


def moment_aggregates(factor: Column | float = 1.0) -> list[Column]:
    scale = factor if isinstance(factor, Column) else F.lit(factor)
    return [
        (F.avg("value") * scale).alias("mean"),
        (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) * scale).alias("std_dev"),
    ]


def metric_statistic_set(samples: DataFrame, factor: float = 1.0) -> DataFrame:
    """A10: sum, sample count, smallest and largest value per metric, times ``factor``."""
    present = samples.where(F.col("value").isNotNull())
    return present.groupBy(*METRIC).agg(*statistic_aggregates(factor))


def metric_moments(samples: DataFrame, factor: float = 1.0) -> DataFrame:
    """Mean and sample standard deviation per metric; 0 deviation for one sample."""
    present = samples.where(F.col("value").isNotNull())
    return present.groupBy(*METRIC).agg(*moment_aggregates(factor))


def percentile_arrays(
    samples: DataFrame,
    quantiles: tuple[float, ...] = DEFAULT_PERCENTILES,
    approx: bool = False,
    heavy_rows: int = HEAVY_METRIC_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``quantile_values`` per metric, in the order of ``quantiles``.

    Exact values interpolate between the two neighbouring samples. The built-in keeps all
    distinct values of a metric in one buffer, so it is given ordinary metrics only. For a heavy
    one the (metric, value) counts are put in order by range partitioning, and the samples at
    the wanted positions are picked by their running count. ``approx`` uses a bounded digest.
    ``sizes(kind, metric, count)`` saves counting the samples once more.
    """
    present = samples.where(F.col("value").isNotNull()).select(*METRIC, "value")
    wanted = F.array(*[F.lit(q) for q in quantiles])
    if approx:
        return present.groupBy(*METRIC).agg(
            F.percentile_approx("value", list(quantiles), 10_000).alias("quantile_values")
        )
    light, heavy = split_heavy(present, METRIC, heavy_rows, sizes)
    result = light.groupBy(*METRIC).agg(F.percentile("value", wanted).alias("quantile_values"))
    if heavy is None:
        return result
    return result.unionByName(_heavy_percentiles(heavy, quantiles))


def _heavy_percentiles(samples: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    counted = samples.groupBy(*METRIC, "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(
        cut_slices(counted, METRIC, ["value"]), METRIC, ["value"], F.col("_n"), "_end"
    )
    totals = lookup(placed.groupBy(*METRIC).agg((F.max("_end") - 1).alias("_last")))
    ranged = placed.join(totals, METRIC)

    def sample_at(position: Column) -> Column:
        here = (position < F.col("_end")) & (position >= F.col("_end") - F.col("_n"))
        return F.max(F.when(here, F.col("value")))

    picks = []
    for i, q in enumerate(quantiles):
        position = F.col("_last") * F.lit(q)
        picks += [
            sample_at(F.floor(position)).alias(f"_low{i}"),
            sample_at(F.ceil(position)).alias(f"_high{i}"),
        ]
    picked = ranged.groupBy(*METRIC, "_last").agg(*picks)
    values = []
    for i, q in enumerate(quantiles):
        position = F.col("_last") * F.lit(q)
        share = position - F.floor(position)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        values.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share))
    return picked.select(*METRIC, F.array(*values).alias("quantile_values"))


def metric_percentiles(
    samples: DataFrame,
    quantiles: tuple[float, ...] = DEFAULT_PERCENTILES,
    approx: bool = False,
    heavy_rows: int = HEAVY_METRIC_ROWS,
) -> DataFrame:
    """One row per metric and percentile, labelled ``50%`` to ``99.9%``."""
    unknown = [q for q in quantiles if q not in PERCENTILES]
    if unknown:
        raise ValueError(f"not a reportable percentile: {unknown}")
    labels = F.array(*[F.lit(PERCENTILES[q]) for q in quantiles])
    arrays = percentile_arrays(samples, quantiles, approx, heavy_rows)
    return arrays.select(
        *METRIC, F.explode(F.arrays_zip(labels.alias("label"), "quantile_values")).alias("p")
    ).select(
        *METRIC, F.col("p.label").alias("percentile"), F.col("p.quantile_values").alias("value")
    )


def mean_rate(count: Column, first: Column, as_of: Column, unit_seconds: float) -> Column:
    """Events per unit since ``first``; null if no time has passed."""
    elapsed = times.micros_between(first, as_of)
    return F.when(elapsed > 0, count * (times.MICROS_PER_SECOND * unit_seconds) / elapsed)


def metric_mean_rate(samples: DataFrame, as_of: Column, unit_seconds: float = 1.0) -> DataFrame:
    """Events per unit of time since the first sample of each metric."""
    known = samples.where(F.col("ts") <= as_of)
    totals = known.groupBy(*METRIC).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first")
    )
    rate = mean_rate(F.col("_n"), F.col("_first"), as_of, unit_seconds)
    return totals.select(*METRIC, rate.alias("mean_rate"))


def metric_ewma_rates(
    samples: DataFrame,
    as_of: Column,
    minutes: tuple[int, ...] = RATE_MINUTES,
    tick_seconds: int = TICK_SECONDS,
    unit_seconds: float = 1.0,
) -> DataFrame:
    """Exponentially weighted rates, one column ``rate_<m>m`` per look-back.

    Every tick the rate moves towards the tick's own by 1 - exp(-tick / look-back); a metric's
    first tick sets it. Unrolled, each tick of age a has the weight alpha * (1 - alpha) ** a, the
    first one (1 - alpha) ** a. Age is counted back from the last full tick, so the sum needs
    neither an order nor empty ticks. Ticks are whole multiples of ``tick_seconds`` since the
    epoch; the one ``as_of`` lies in has not ended and does not count.
    """
    tick_micros = tick_seconds * times.MICROS_PER_SECOND
    current = times.floor_to(as_of, tick_micros)
    age = F.call_function(
        "div",
        times.micros_between(times.floor_to(F.col("ts"), tick_micros), current),
        F.lit(tick_micros).cast("bigint"),
    )
    ticks = (
        samples.where(F.col("ts") <= as_of)
        .groupBy(*METRIC, (age - 1).alias("_age"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ended = F.col("_age") >= 0
    rates = []
    for m in minutes:
        keep = math.exp(-tick_seconds / (60.0 * m))
        weighted = F.when(ended, F.pow(F.lit(keep), F.col("_age")) * F.col("_n"))
        total = F.coalesce(F.sum(weighted), F.lit(0.0)) * (1 - keep)
        first = F.coalesce(F.max_by(weighted, F.when(ended, F.col("_age"))), F.lit(0.0)) * keep
        rates.append(((total + first) * unit_seconds / tick_seconds).alias(f"rate_{m}m"))
    return ticks.groupBy(*METRIC).agg(*rates)


def counter_deltas(
    reports: DataFrame, keys: list[str] = METRIC, heavy_rows: int = HEAVY_GROUP_ROWS
) -> DataFrame:
    """Growth of each counter from one report to the next; the first reports its value.

    ``reports`` has one row per counter and ``report_time``, with the counter's ``value``.
    """
    order = ["report_time"]
    window = Window.partitionBy(*keys).orderBy(*order)
    with_before = per_group(
        reports,
        keys,
        order,
        lambda rows: rows.withColumn("_before", F.lag("value").over(window)),
        lambda rows: previous(rows, keys, order, "value", "_before"),
        heavy_rows,
    )
    delta = F.col("value") - F.coalesce("_before", F.lit(0))
    return with_before.withColumn("delta", delta).drop("_before")
