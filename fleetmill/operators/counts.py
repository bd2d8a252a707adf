"""Fleet-wide figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators.schedule import is_due
from fleetmill.sources.catalog import Catalog

_FIGURES = ("active_pipelines", "due_pipelines", "in_console_runs", "total_inventory")


def fleet_counts(catalog: Catalog, inventory: DataFrame, tick_end: Column) -> DataFrame:
    """A1: one row with the active and due pipelines, in-console runs and inventory entries."""
    nothing = F.lit(0).cast("bigint")

    def row(df: DataFrame, **figures: Column) -> DataFrame:
        return df.agg(*[figures.get(f, nothing).alias(f) for f in _FIGURES])

    parts = [
        row(
            catalog["pipelines"],
            active_pipelines=F.count_if("is_active"),
            due_pipelines=F.count_if(is_due(tick_end)),
        ),
        row(catalog["scheduled_pipelines"], in_console_runs=F.count_if("in_console")),
        row(inventory, total_inventory=F.count(F.lit(1))),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.agg(*[F.sum(f).alias(f) for f in _FIGURES])


def scheduler_run_times(scheduler_metrics: DataFrame) -> DataFrame:
    """Each scheduler run with its duration in seconds, null while unfinished."""
    micros = times.micros_between(F.col("start_time"), F.col("end_time"))
    return scheduler_metrics.withColumn("duration_seconds", micros / times.MICROS_PER_SECOND)


def scheduler_run_stats(scheduler_metrics: DataFrame) -> DataFrame:
    """The scheduler's runs per day: number, finished, pipelines and durations."""
    timed = scheduler_run_times(scheduler_metrics)
    return timed.groupBy(F.col("start_time").cast("date").alias("run_date")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("end_time").alias("finished_runs"),
        F.sum("pipeline_count").alias("pipelines"),
        F.min("duration_seconds").alias("shortest_seconds"),
        F.avg("duration_seconds").alias("average_seconds"),
        F.max("duration_seconds").alias("longest_seconds"),
    )
