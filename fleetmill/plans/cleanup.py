"""Keeping the inventory small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.operators import retention, unmanaged
from fleetmill.operators.ordered import HEAVY_GROUP_ROWS
from fleetmill.session import lookup, materialize
from fleetmill.sources.catalog import Catalog
from fleetmill.sources.changes import append_rows

MARK_NOT_IN_CONSOLE = "mark_not_in_console"
RECORD_FAILURE = "record_failure"


@dataclass(frozen=True)
class Cleanup:
    """What to do with which run, the catalog once it is done, and runs that cannot be judged."""

    actions: DataFrame
    catalog: Catalog
    quarantined: DataFrame


def cleanup_existing(
    catalog: Catalog, status: DataFrame, now: Column, heavy_rows: int = HEAVY_GROUP_ROWS
) -> Cleanup:
    """Applies the retention rule to the in-console runs.

    Status and recorded failures are both joined on the run's id, so the runs are shuffled once
    for that and once more by pipeline for the cuts. The joined rows are written out in between:
    cuts and verdicts must come from the same snapshot, and deletions cannot be taken back.

    Runs of a pipeline that is not there or has no retention are quarantined, not touched.
    """
    runs = retention.in_console_runs(catalog["scheduled_pipelines"]).select(
        "aws_id", "pipeline_id", "actual_start"
    )
    recorded = catalog["failed_pipelines"].select("aws_id", F.lit(True).alias("_recorded"))
    found = materialize(
        retention.runs_with_status(runs, status).join(recorded, "aws_id", "left")
    )
    cuts = lookup(
        retention.retention_cuts(
            retention.finished_runs(found), catalog["pipelines"], heavy_rows
        )
    )
    finished, failed = retention.is_finished(), retention.is_failed()
    action = (
        F.when(~F.col("in_inventory"), MARK_NOT_IN_CONSOLE)
        .when(
            finished & failed & retention.is_beyond_retention("failed_cut"),
            retention.DELETE_FAILED,
        )
        .when(finished & failed & F.col("_recorded").isNull(), RECORD_FAILURE)
        .when(
            finished & ~failed & retention.is_beyond_retention("healthy_cut"),
            retention.DELETE_HEALTHY,
        )
    )
    judged = found.join(cuts, "pipeline_id", "left").select(
        "aws_id",
        "pipeline_id",
        F.when(F.col("retention").isNull(), "quarantine").otherwise(action).alias("action"),
    )
    decided = materialize(judged.where(F.col("action").isNotNull()))
    quarantine = F.col("action") == "quarantine"
    actions = decided.where(~quarantine)
    return Cleanup(
        actions,
        apply_actions(catalog, actions, now),
        decided.where(quarantine).select("aws_id", "pipeline_id"),
    )


def apply_actions(catalog: Catalog, actions: DataFrame, now: Column) -> Catalog:
    """The catalog with deleted and vanished runs out of the console and new failures recorded."""
    gone = actions.where(F.col("action") != RECORD_FAILURE).select(
        "aws_id", F.lit(True).alias("_gone")
    )
    runs = catalog["scheduled_pipelines"]
    still = F.when(F.col("_gone"), False).otherwise(F.col("in_console"))
    marked = runs.join(gone, "aws_id", "left").select(
        *[still.alias(c) if c == "in_console" else F.col(c) for c in runs.columns]
    )
    failures = actions.where(F.col("action") == RECORD_FAILURE).select(
        "aws_id",
        "pipeline_id",
        F.lit(False).alias("resolved"),
        now.alias("checked_time"),
    )
    return {
        **catalog,
        "scheduled_pipelines": marked,
        "failed_pipelines": append_rows(catalog["failed_pipelines"], failures),
    }


@dataclass(frozen=True)
class UnmanagedCleanup:
    """Ids to delete, number of runs that concerns, and the run log once they are deleted."""

    ids: DataFrame
    affected: DataFrame
    runs: DataFrame


def cleanup_unmanaged(
    inventory: DataFrame,
    status: DataFrame,
    runs: DataFrame,
    exclude_prefixes: list[str],
    cutoff: Column,
    own_prefix: str,
    state: str = "FINISHED",
    force: bool = False,
    dry_run: bool = False,
) -> UnmanagedCleanup:
    """C4: old entries that no in-console run accounts for; with ``force`` of all entries.

    The status filter comes first, so only candidates reach the joins on the id. What is deleted is
    decided once and written: all three results follow from the same ids.
    """
    candidates = unmanaged.deletable_unmanaged(
        status, exclude_prefixes, cutoff, own_prefix, state, force
    ).select("aws_id")
    listed = candidates.join(inventory.select("aws_id"), "aws_id", "left_semi")
    ids = materialize(unmanaged.unmanaged_inventory(listed, runs, force))
    affected = unmanaged.runs_in_ids(runs, ids).agg(F.count(F.lit(1)).alias("updated_runs"))
    if dry_run:
        return UnmanagedCleanup(ids, affected, runs)
    gone = ids.withColumn("_gone", F.lit(True))
    still = F.when(F.col("_gone"), False).otherwise(F.col("in_console"))
    marked = runs.join(gone, "aws_id", "left").select(
        *[still.alias(c) if c == "in_console" else F.col(c) for c in runs.columns]
    )
    return UnmanagedCleanup(ids, affected, marked)


def summarize_unmanaged(
    inventory: DataFrame, status: DataFrame, runs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Unmanaged entries (by state, by creation date).

    Both are sums of one table of counts, which is written: the entries are found once.
    """
    ids = unmanaged.unmanaged_inventory(inventory, runs)
    found = status.join(ids, "aws_id", "left_semi")
    counts = materialize(
        found.groupBy(unmanaged.state_of(), unmanaged.date_of()).agg(
            F.count(F.lit(1)).alias("entries")
        )
    )
    added = F.sum("entries").alias("entries")
    return (
        counts.groupBy("state").agg(added).orderBy(F.desc("entries"), "state"),
        counts.groupBy("created_on").agg(added).orderBy(F.desc("created_on")),
    )
