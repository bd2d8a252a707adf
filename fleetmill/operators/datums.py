"""Metric figures to data points ready to be sent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.operators.metrics import (
    DEFAULT_PERCENTILES,
    METRIC,
    PERCENTILES,
    SERVICE_PERCENTILES,
)
from fleetmill.operators.ordered import number_rows

# Limits of the metrics service.
SMALLEST_VALUE = 8.515920e-109
LARGEST_VALUE = 1.174271e108
DATUMS_PER_REQUEST = 20

# How a name carries dimensions, and what a data point's type is called.
DIMENSIONED_NAME = r"([\w.-]+)\[([\w\W]+)]"
TYPE = "Type"
STANDARD_UNITS = {
    "seconds": "Seconds",
    "milliseconds": "Milliseconds",
    "microseconds": "Microseconds",
}
UNIT_SECONDS = {"seconds": 1.0, "milliseconds": 1e-3, "microseconds": 1e-6}

# The order in which the kinds are reported.
KINDS = ("gauge", "counter", "histogram", "meter", "timer")

#: Order columns that identify a data point.
DATUM_ORDER = ["kind_rank", "metric", "datum_rank"]


@dataclass(frozen=True)
class ReportSettings:
    """Which figures are reported and how; the default reports counts and percentiles only."""

    percentiles: tuple[float, ...] = DEFAULT_PERCENTILES
    #: Percentiles from a bounded digest, in one aggregation however large a metric is.
    approximate: bool = False
    one_minute_rate: bool = False
    five_minute_rate: bool = False
    fifteen_minute_rate: bool = False
    mean_rate: bool = False
    arithmetic_mean: bool = False
    std_dev: bool = False
    statistic_set: bool = False
    zero_values: bool = False
    raw_counts: bool = False
    high_resolution: bool = False
    rate_unit: str = "seconds"
    duration_unit: str = "milliseconds"
    #: Unit name sent with rates in place of the one of ``rate_unit``.
    meter_unit: str | None = None
    #: What one unit of a timer sample is in ``duration_unit``.
    duration_factor: float = 1.0
    global_dimensions: tuple[str, ...] = ()

    @property
    def resolution(self) -> int:
        return 1 if self.high_resolution else 60


#: What the scheduling service itself reports.
SERVICE_SETTINGS = ReportSettings(
    percentiles=SERVICE_PERCENTILES,
    one_minute_rate=True,
    five_minute_rate=True,
    fifteen_minute_rate=True,
    mean_rate=True,
    arithmetic_mean=True,
    std_dev=True,
    statistic_set=True,
    zero_values=True,
    raw_counts=True,
    high_resolution=True,
    meter_unit="Bytes",
)


def _last_of_each_name(entries: Column) -> Column:
    """Entries whose name does not come again later in the array."""
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"]
        ),
    )


def decode_dimensions(samples: DataFrame, name: str = "metric") -> DataFrame:
    """``metric_name`` and ``dimensions`` out of ``name[k:v,k:v]``.

    A name without brackets is taken whole, with no dimensions. A part without a value is left
    out; of a repeated key the last value counts.
    """
    text = F.col(name)
    encoded = text.rlike(DIMENSIONED_NAME)
    parts = F.transform(
        F.split(F.regexp_extract(text, DIMENSIONED_NAME, 2), ","), lambda p: F.split(p, ":")
    )
    entries = F.transform(
        F.filter(parts, lambda p: F.size(p) > 1),
        lambda p: F.struct(F.trim(p[0]).alias("name"), F.trim(p[1]).alias("value")),
    )
    decoded = F.map_from_entries(_last_of_each_name(entries))
    empty = F.create_map().cast("map<string,string>")
    return samples.withColumns(
        {
            "metric_name": F.when(
                encoded, F.trim(F.regexp_extract(text, DIMENSIONED_NAME, 1))
            ).otherwise(text),
            "dimensions": F.when(encoded, decoded).otherwise(empty),
        }
    )


def global_dimensions(datums: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Adds ``name=value`` dimensions and the data point's type to ``dimensions``.

    Of a repeated name the data point's own value counts, then the type, then the last given.
    """
    pairs = dict(tuple(p.strip() for p in (*d.split("=")[:2], "")[:2]) for d in dimensions)
    if any("=" not in d for d in dimensions):
        raise ValueError("a dimension is written name=value")
    pairs.pop(TYPE, None)
    given = F.create_map(
        *[F.lit(text) for pair in pairs.items() for text in pair], F.lit(TYPE), F.col("datum_type")
    )
    own = F.col("dimensions")
    kept = F.map_filter(given, lambda name, _: ~F.map_contains_key(own, name))
    return datums.withColumn("dimensions", F.map_concat(kept, own))


def sendable(value: Column) -> Column:
    """``value`` brought into the accepted range by magnitude; 0 stays 0."""
    size = F.abs(value)
    clamped = F.greatest(F.lit(SMALLEST_VALUE), F.least(F.lit(LARGEST_VALUE), size))
    return F.when(value == 0, value).otherwise(F.signum(value) * clamped)


def is_number(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def clean_values(datums: DataFrame, value: str = "value") -> DataFrame:
    """Values clamped to the accepted range; NaN and infinite ones are dropped.

    A null value (a data point with a statistic set) stays.
    """
    kept = datums.where(F.col(value).isNull() | is_number(F.col(value)))
    return kept.withColumn(value, sendable(F.col(value)))


def _type_labels(settings: ReportSettings) -> tuple[str, str]:
    per = f"-rate [per-{settings.rate_unit.removesuffix('s')}]"
    return per, f" [in-{settings.duration_unit}]"


def stage_datums(
    figures: DataFrame, settings: ReportSettings, as_of: Column, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per data point from one row of figures per metric.

    ``figures`` has per (kind, metric): ``gauge``, ``count``, ``quantile_values``, ``mean``,
    ``std_dev``, ``sum``, ``sample_count``, ``minimum``, ``maximum``, ``rate_1m``, ``rate_5m``,
    ``rate_15m`` and ``mean_rate``, with durations and rates in their units. Figures that are
    null, switched off or not above zero (unless zero values are sent) give no data point; a
    statistic set is sent whenever there are samples. Columns in ``carry`` are taken along.
    """
    per, inside = _type_labels(settings)
    is_timer = F.col("kind") == "timer"
    sampled = F.col("kind").isin("histogram", "timer")
    rated = F.col("kind").isin("meter", "timer")
    value_unit = F.when(is_timer, STANDARD_UNITS[settings.duration_unit]).otherwise("None")
    suffix = F.when(is_timer, inside).otherwise("")
    rate_unit = F.lit(settings.meter_unit or STANDARD_UNITS[settings.rate_unit])

    points: list[Column] = []

    def point(when: Column, kind: Column, unit: Column, value: Column) -> None:
        shown = value > 0 if not settings.zero_values else value.isNotNull()
        points.append(
            F.when(
                when & is_number(value) & shown,
                F.struct(
                    F.lit(len(points)).alias("datum_rank"),
                    kind.alias("datum_type"),
                    value.cast("double").alias("value"),
                    F.lit(None).cast(_STATISTICS).alias("statistics"),
                    unit.alias("unit"),
                ),
            )
        )

    point(F.col("kind") == "gauge", F.lit("gauge"), F.lit("None"), F.col("gauge"))
    for i, q in enumerate(settings.percentiles):
        value = F.get("quantile_values", F.lit(i))
        point(sampled, F.lit(PERCENTILES[q]), value_unit, value)
    if settings.arithmetic_mean:
        point(sampled, F.concat(F.lit("snapshot-mean"), suffix), value_unit, F.col("mean"))
    if settings.std_dev:
        point(sampled, F.concat(F.lit("snapshot-std-dev"), suffix), value_unit, F.col("std_dev"))
    if settings.statistic_set:
        points.append(
            F.when(
                sampled & (F.col("sample_count") > 0),
                F.struct(
                    F.lit(len(points)).alias("datum_rank"),
                    F.lit("snapshot-summary").alias("datum_type"),
                    F.lit(None).cast("double").alias("value"),
                    F.struct("sum", "sample_count", "minimum", "maximum").alias("statistics"),
                    value_unit.alias("unit"),
                ),
            )
        )
    for switched_on, label, column in (
        (settings.one_minute_rate, "1-min-mean", "rate_1m"),
        (settings.five_minute_rate, "5-min-mean", "rate_5m"),
        (settings.fifteen_minute_rate, "15-min-mean", "rate_15m"),
        (settings.mean_rate, "mean", "mean_rate"),
    ):
        if switched_on:
            point(rated, F.lit(label + per), rate_unit, F.col(column))
    point(F.col("kind") != "gauge", F.lit("count"), F.lit("Count"), F.col("count").cast("double"))

    kind_rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return figures.select(
        kind_rank.alias("kind_rank"),
        *METRIC,
        *carry,
        F.explode(F.array_compact(F.array(*points))).alias("point"),
    ).select(
        as_of.alias("ts"),
        "kind_rank",
        *METRIC,
        *carry,
        "point.*",
        F.lit(settings.resolution).alias("resolution"),
    )


_STATISTICS = "struct<sum:double,sample_count:double,minimum:double,maximum:double>"


def batch_datums(datums: DataFrame, size: int = DATUMS_PER_REQUEST) -> DataFrame:
    """Numbers the data points in reporting order and puts ``size`` into each batch."""
    numbered = number_rows(datums, DATUM_ORDER, "datum_number")
    batch = F.call_function("div", F.col("datum_number"), F.lit(size).cast("bigint"))
    return numbered.withColumn("batch", batch)
