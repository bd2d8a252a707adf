"""Comparing the run log with the live inventory, and the retention rule.

The rule keeps the newest ``retention`` distinct start times of each pipeline, for healthy and
for failed runs separately. Ranking the runs themselves would need a pipeline's whole history
in one task. Only the start time at which the cut falls is needed, so the distinct starts are
aggregated first, the cut is found among them, and a run is then judged by comparing its own
start with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators.ordered import HEAVY_GROUP_ROWS, per_group, running
from fleetmill.session import lookup

FINISHED = "FINISHED"
ERROR = "ERROR"

DELETE_HEALTHY = "delete_healthy"
DELETE_FAILED = "delete_failed"
KEEP_FAILED = "keep_failed"


def active_pipelines(pipelines: DataFrame) -> DataFrame:
    """the active pipelines."""
    return pipelines.where("is_active")


def in_console_runs(runs: DataFrame) -> DataFrame:
    """runs that still show in the console."""
    return runs.where("in_console")


def runs_with_pipeline(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Each run with the retention and owner of its pipeline."""
    settings = pipelines.select(F.col("id").alias("pipeline_id"), "retention", "owner")
    return runs.join(settings, "pipeline_id")


def runs_with_status(runs: DataFrame, status: DataFrame) -> DataFrame:
    """Each run with its inventory status, null where the inventory lacks it."""
    found = status.select(
        "aws_id", "health_status", "pipeline_state", F.lit(True).alias("in_inventory")
    )
    return runs.join(found, "aws_id", "left").withColumn(
        "in_inventory", F.coalesce("in_inventory", F.lit(False))
    )


def vanished_runs(runs: DataFrame, status: DataFrame) -> DataFrame:
    """In-console runs that the inventory no longer has."""
    return in_console_runs(runs).join(status.select("aws_id"), "aws_id", "left_anti")


def new_failures(kept: DataFrame, failed: DataFrame) -> DataFrame:
    """Kept failed runs that are not recorded as failed yet."""
    return kept.join(failed.select("aws_id"), "aws_id", "left_anti")


def is_finished() -> Column:
    return F.coalesce(F.col("pipeline_state") == FINISHED, F.lit(False))


def is_failed() -> Column:
    return F.col("health_status").eqNullSafe(F.lit(ERROR))


def finished_runs(runs_with_status: DataFrame) -> DataFrame:
    """runs whose inventory status says finished."""
    return runs_with_status.where(F.col("pipeline_state") == FINISHED)


def split_by_health(finished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failed, healthy). No health value counts as healthy."""
    return finished.where(is_failed()), finished.where(~is_failed())


def latest_starts(runs: DataFrame, k: int, heavy_rows: int = HEAVY_GROUP_ROWS) -> DataFrame:
    """O2: the newest ``k`` distinct starts of each pipeline, with the runs that share each."""
    starts = runs.groupBy("pipeline_id", "actual_start").agg(
        F.count(F.lit(1)).alias("run_count")
    )
    ranked = _rank_starts(starts, ["pipeline_id"], k, heavy_rows)
    return ranked.withColumnRenamed("_rank", "start_rank")


def _rank_starts(starts: DataFrame, keys: list[str], most: int, heavy_rows: int) -> DataFrame:
    """Adds ``_rank`` to distinct starts, newest first, and keeps ranks up to ``most``.

    Up to the largest limit that the session pushes below the shuffle, few rows per group are left
    before it. A larger one leaves all of them, and groups with very many are then sliced.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("actual_start"))

    def ordinary(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(newest).cast("bigint"))

    if most <= _rank_limit(starts.sparkSession):
        # The limit is pushed down if the rank is compared as it comes.
        ranked = starts.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= most)
        return ranked.withColumn("_rank", F.col("_rank").cast("bigint"))
    aged = starts.withColumn("_age", -times.wall_micros(F.col("actual_start")))
    one = F.lit(1).cast("bigint")
    ranked = per_group(
        aged,
        keys,
        ["_age"],
        ordinary,
        lambda rows: running(rows, keys, ["_age"], one, "_rank"),
        heavy_rows,
    )
    return ranked.where(F.col("_rank") <= most).drop("_age")


def _rank_limit(spark: SparkSession) -> int:
    """Up to this rank a filter on ranks is applied before the shuffle."""
    return max(0, int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")))


def retention_cuts(
    finished: DataFrame, pipelines: DataFrame, heavy_rows: int = HEAVY_GROUP_ROWS
) -> DataFrame:
    """Per pipeline the oldest start that is kept, among healthy and among failed runs.

    Null cut: fewer distinct starts than ``retention``, all are kept. A retention below one keeps
    none.
    """
    settings = pipelines.select(F.col("id").alias("pipeline_id"), "retention")
    starts = finished.select(
        "pipeline_id", is_failed().alias("failed"), "actual_start"
    ).distinct()
    largest = settings.agg(F.max("retention")).first()[0] or 0
    limit = _rank_limit(finished.sparkSession)
    if largest <= limit:
        ranked = _rank_starts(starts, ["pipeline_id", "failed"], largest, heavy_rows)
    else:
        # A pipeline's own retention decides how its starts are ranked.
        few, many = settings.where(F.col("retention") <= limit), settings.where(
            F.col("retention") > limit
        )
        own = [starts.join(x, "pipeline_id", "left_semi") for x in (few, many)]
        ranked = _rank_starts(own[0], ["pipeline_id", "failed"], limit, heavy_rows).unionByName(
            _rank_starts(own[1], ["pipeline_id", "failed"], largest, heavy_rows)
        )
        # spread over tasks by rank as well, only the ranks that equal a retention go on
        wanted = settings.select("pipeline_id", F.col("retention").cast("bigint").alias("_rank"))
        ranked = ranked.join(wanted, ["pipeline_id", "_rank"], "left_semi")
    at_cut = F.col("_rank") == F.col("retention")
    return (
        settings.join(ranked, "pipeline_id", "left")
        .groupBy("pipeline_id", "retention")
        .agg(
            F.max(F.when(at_cut & ~F.col("failed"), F.col("actual_start"))).alias("healthy_cut"),
            F.max(F.when(at_cut & F.col("failed"), F.col("actual_start"))).alias("failed_cut"),
        )
    )


def is_beyond_retention(cut: str) -> Column:
    return (F.col("retention") < 1) | F.coalesce(
        F.col("actual_start") < F.col(cut), F.lit(False)
    )


def judge_finished(finished: DataFrame, pipelines: DataFrame) -> DataFrame:
    """W1 and W2 in one pass: each finished run with ``action``, null for healthy and kept."""
    cuts = lookup(retention_cuts(finished, pipelines))
    action = F.when(
        is_failed(), F.when(is_beyond_retention("failed_cut"), DELETE_FAILED).otherwise(KEEP_FAILED)
    ).when(is_beyond_retention("healthy_cut"), DELETE_HEALTHY)
    return finished.join(cuts, "pipeline_id").withColumn("action", action)


def retention_healthy(healthy: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Healthy runs to delete: all that share a start older than the newest ``retention``."""
    judged = judge_finished(healthy.where(~is_failed()), pipelines)
    return judged.where(F.col("action") == DELETE_HEALTHY).select(
        "aws_id", "pipeline_id", "action"
    )


def retention_failed(failed: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Failed runs, each kept or deleted by the same rule, ranked among themselves."""
    judged = judge_finished(failed.where(is_failed()), pipelines)
    return judged.select("aws_id", "pipeline_id", "action")


def cleanup_report(runs: DataFrame, status: DataFrame) -> DataFrame:
    """A5: per pipeline, what the clean-up finds among its in-console runs."""
    found = runs_with_status(in_console_runs(runs), status)
    return found.groupBy("pipeline_id").agg(
        F.count(F.lit(1)).alias("in_console"),
        F.count_if(F.col("in_inventory")).alias("in_inventory"),
        F.count_if(~F.col("in_inventory")).alias("vanished"),
        F.count_if(is_finished()).alias("finished"),
        F.count_if(is_finished() & is_failed()).alias("failed"),
        F.count_if(is_finished() & ~is_failed()).alias("healthy"),
    )


def deleted_count(actions: DataFrame) -> DataFrame:
    """How many healthy runs are deleted. Deleted failed runs are not counted."""
    return actions.agg(F.count_if(F.col("action") == DELETE_HEALTHY).alias("pipeline_deleted"))
