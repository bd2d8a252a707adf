"""Consecutive schedule failures, replayed over any number of attempts per pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators.ordered import HEAVY_GROUP_ROWS, per_group, running
from fleetmill.session import lookup

MAX_FAILURES = 3

CLEARED = "cleared"
FAILED = "failed_to_schedule"
DEACTIVATED = "deactivated"

_KEYS = ["pipeline_id"]
_ORDER = ["attempt_time", "attempt_id"]


def failure_streaks(
    attempts: DataFrame,
    counters: DataFrame,
    max_failures: int = MAX_FAILURES,
    heavy_rows: int = HEAVY_GROUP_ROWS,
) -> DataFrame:
    """Each attempt with its place in a run of failures and what follows from it.

    A success clears the counter. The f-th failure in a row is reported while f is at most
    ``max_failures`` and deactivates the pipeline beyond; the counter stays at the maximum then,
    and further failures have the same number. Failures before the first success continue from
    the pipeline's recorded counter. An attempt without a result is a failure.

    The number of failures so far minus that number at the last success is the place in the run.
    Both are running aggregates, so a pipeline of any size can be cut into slices.
    """
    fails = F.when(F.col("ok"), 0).otherwise(1).cast("bigint")
    at_success = F.when(F.col("ok"), F.col("_fails"))
    up_to_here = (
        Window.partitionBy(*_KEYS)
        .orderBy(*_ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    attempts = attempts.withColumn("ok", F.coalesce("ok", F.lit(False)))
    prior = counters.select("pipeline_id", F.col("failure_count").alias("_prior"))

    def ordinary(rows: DataFrame) -> DataFrame:
        counted = rows.withColumn("_fails", F.sum(fails).over(up_to_here))
        cleared = counted.withColumn("_cleared", F.max(at_success).over(up_to_here))
        return cleared.join(prior, "pipeline_id", "left")

    def sliced(rows: DataFrame) -> DataFrame:
        counted = running(rows, _KEYS, _ORDER, fails, "_fails")
        cleared = running(counted, _KEYS, _ORDER, at_success, "_cleared", how="max")
        heavy = rows.select("pipeline_id").distinct()
        known = lookup(prior.join(heavy, "pipeline_id", "left_semi"))
        return cleared.join(known, "pipeline_id", "left")

    placed = per_group(attempts, _KEYS, _ORDER, ordinary, sliced, heavy_rows)
    start = F.coalesce(F.col("_cleared"), -F.col("_prior"), F.lit(0))
    most = F.lit(max_failures + 1).cast("bigint")
    number = F.when(~F.col("ok"), F.least(F.col("_fails") - start, most))
    return placed.withColumn("failure_number", number).select(
        "attempt_id",
        "pipeline_id",
        "attempt_time",
        "ok",
        "log",
        "failure_number",
        counter_after(F.col("failure_number"), max_failures).cast("int").alias("counter"),
        event_of(F.col("failure_number"), max_failures).alias("event"),
    )


def counter_after(failure_number: Column, max_failures: int) -> Column:
    most = F.least(failure_number, F.lit(max_failures))
    return F.when(failure_number.isNull(), 0).otherwise(most)


def event_of(failure_number: Column, max_failures: int) -> Column:
    return (
        F.when(failure_number.isNull(), CLEARED)
        .when(failure_number > max_failures, DEACTIVATED)
        .otherwise(FAILED)
    )


def final_counters(streaks: DataFrame, counters: DataFrame) -> DataFrame:
    """The counter table after the replay: cleared ones are gone, untouched ones stay."""
    last = times.packed_order(F.col("attempt_time"), F.col("attempt_id"))
    ended = streaks.groupBy("pipeline_id").agg(
        F.max_by("counter", last).alias("failure_count"),
        F.max_by(F.col("attempt_time"), last).alias("updated_at"),
    )
    untouched = counters.join(ended.select("pipeline_id"), "pipeline_id", "left_anti")
    kept = ended.where(F.col("failure_count") > 0)
    return untouched.unionByName(kept.select(*counters.columns))
