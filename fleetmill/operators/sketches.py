"""A12 from sketches: quantile summaries of closed intervals, stored once and merged for longer spans.

A sketch of a metric's values in an interval has a size that hardly grows with their number, combines
before the shuffle, and merges with others. So percentiles of a day or a month come from the stored
sketches of its hours, without the samples. Rank errors of a merged sketch stay within ``RANK_ERROR``,
as those of a sketch made in one pass do; up to ``SIZE`` values a sketch is exact. Quantiles are
samples, not interpolated ones. Nulls and values that are not a number do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmill.operators.metrics import DEFAULT_PERCENTILES, METRIC, PERCENTILES

#: The sketches' parameter of size.
SIZE = 800
#: Part of all values by which a rank may be off. Of this size it is expected within 0.0035 in 99 of 100
#: cases; this bound is nearly three times that.
RANK_ERROR = 0.01


def interval_sketches(samples: DataFrame, length: str = "1 hour") -> DataFrame:
    """``(kind, metric, interval_start, interval_end, n, least, most, sketch)`` from samples.

    Intervals are aligned to the epoch, whatever the session's time zone.
    """
    known = samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
    span = F.window("ts", length)
    return (
        known.groupBy(*METRIC, span.alias("_span"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("least"),
            F.max("value").alias("most"),
            F.kll_sketch_agg_double("value", SIZE).alias("sketch"),
        )
        .select(
            *METRIC,
            F.col("_span.start").alias("interval_start"),
            F.col("_span.end").alias("interval_end"),
            *_SUMMARY,
        )
    )


_SUMMARY = ["n", "least", "most", "sketch"]


def merged_sketches(sketches: DataFrame, length: str | None = None) -> DataFrame:
    """Sketches of longer intervals, or of all there is: one row per metric (and interval).

    ``length`` is a multiple of what the sketches were made of, so that no interval lies across two.
    """
    merged = [
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", SIZE).alias("sketch"),
    ]
    if length is None:
        return sketches.groupBy(*METRIC).agg(*merged)
    longer = sketches.groupBy(*METRIC, F.window("interval_start", length).alias("_span")).agg(*merged)
    return longer.select(
        *METRIC,
        F.col("_span.start").alias("interval_start"),
        F.col("_span.end").alias("interval_end"),
        *_SUMMARY,
    )


def quantile_values(quantiles: tuple[float, ...]) -> Column:
    """The values at ``quantiles`` of a row's sketch, never outside what was seen."""
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in quantiles]
    return F.array(*[F.least(F.greatest(v, "least"), "most") for v in at])


def sketch_percentile_arrays(sketches: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """``quantile_values`` per metric over all intervals, in the order of ``quantiles``."""
    found = quantile_values(quantiles).alias("quantile_values")
    return merged_sketches(sketches).select(*METRIC, found)


def sketch_percentiles(
    sketches: DataFrame, quantiles: tuple[float, ...] = DEFAULT_PERCENTILES
) -> DataFrame:
    """A12 from sketches: one row per metric and percentile, labelled like the exact ones."""
    unknown = [q for q in quantiles if q not in PERCENTILES]
    if unknown:
        raise ValueError(f"not a reportable percentile: {unknown}")
    labels = F.array(*[F.lit(PERCENTILES[q]) for q in quantiles])
    arrays = sketch_percentile_arrays(sketches, quantiles)
    pairs = F.explode(F.arrays_zip(labels.alias("label"), F.col("quantile_values").alias("value")))
    return arrays.select(*METRIC, pairs.alias("p")).select(
        *METRIC, F.col("p.label").alias("percentile"), F.col("p.value").alias("value")
    )


def save_sketches(sketches: DataFrame, path: str) -> None:
    """Writes sketches to ``<path>/day=…``. Days that are written again are replaced as a whole."""
    rows = sketches.withColumn("day", F.to_date("interval_start")).repartition("day")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def load_sketches(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """The stored sketches from ``first_day`` to ``last_day``; the other days' folders are not read."""
    stored = spark.read.parquet(path)
    days = F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    return stored.where(days).drop("day")
