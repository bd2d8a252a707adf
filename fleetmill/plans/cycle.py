"""One service cycle: schedule, take in the results, clean up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.operators import schedule
from fleetmill.plans.cleanup import cleanup_existing
from fleetmill.plans.schedule_tick import apply_dispatch_results, schedule_tick
from fleetmill.plans.stages import Tables, finished_once
from fleetmill.session import materialize
from fleetmill.sources.catalog import Catalog
from fleetmill.sources.changes import append_rows


@dataclass(frozen=True)
class Cycle:
    """The catalog after the cycle, what the cycle did, and what it could not handle.

    ``unhandled (reason, row_key)``: due pipelines whose period is no use (``rejected_launch``, the
    pipeline's id), attempts without a pipeline (``rejected_attempt``, the attempt's id), and runs that
    the clean-up cannot judge (``quarantined_run``, the run's id).
    """

    catalog: Catalog
    launches: DataFrame
    events: DataFrame
    actions: DataFrame
    unhandled: DataFrame


def launch_attempts(launches: DataFrame, results: DataFrame, missing: DataFrame) -> DataFrame:
    """One attempt per launch: it failed if the launch did or if its name was not found."""
    lost = missing.select("pipeline_id", F.col("error").alias("_error"))
    failed = F.coalesce(~F.col("ok"), F.lit(True)) | F.col("_error").isNotNull()
    return (
        launches.select("pipeline_id")
        .join(results, "pipeline_id", "left")
        .join(lost, "pipeline_id", "left")
        .select(
            "pipeline_id",
            F.col("pipeline_id").alias("attempt_id"),
            (~failed).alias("ok"),
            F.coalesce("log", "_error").alias("log"),
        )
    )


def hourly_cycle(
    catalog: Catalog,
    tick_start: Column,
    tick_end: Column,
    now: Column,
    prefix: str,
    results: DataFrame,
    inventory_names: DataFrame,
    activations: DataFrame,
    status: DataFrame,
    max_pipelines: int | None = schedule.MAX_PIPELINES,
    work: str | None = None,
) -> Cycle:
    """C1, C2 and C3 over one catalog.

    ``results(pipeline_id, ok, log)`` tells how each launch went. What a step decides is written
    out before the next one reads it: launches, new runs, attempts, actions. Those are small. The
    tables themselves are not copied in between.

    Given ``work``, a folder of this cycle's own on shared storage, the cycle resumes: which pipelines are
    launched, how that went, and the catalog afterwards are stages whose results are kept there. A
    repeated call reads finished stages back and goes on with the next, whatever has changed in the
    meantime in what they were made of. The catalog it returns is then the one stored in ``work``.
    """
    spark = results.sparkSession

    def stage(name: str, names: list[str], make: Callable[[], Tables]) -> Tables:
        return make() if work is None else finished_once(spark, work, name, names, make)

    def schedule_stage() -> Tables:
        tick = schedule_tick(catalog, tick_end, now, prefix, max_pipelines)
        launches = tick.launches if work else materialize(tick.launches)
        rejected = _told(tick.rejected, "rejected_launch", "id")
        return {"launches": launches, "metrics": tick.metrics, "unhandled": rejected}

    tick = stage("scheduled", ["launches", "metrics", "unhandled"], schedule_stage)
    launches = tick["launches"]

    def launch_stage() -> Tables:
        launched = launches.join(results.where("ok"), "pipeline_id", "left_semi")
        deployed = launched.select(
            "pipeline_id",
            F.col("deployment_name").alias("pipeline_name"),
            now.alias("deployed_time"),
        )
        new_runs, missing = schedule.activated_runs(
            deployed, inventory_names, activations, tick_start, now
        )
        attempts = launch_attempts(launches, results, missing)
        return {"attempts": attempts, "new_runs": new_runs if work else materialize(new_runs)}

    told = stage("launched", ["attempts", "new_runs"], launch_stage)

    def last_stage() -> Tables:
        dispatched = apply_dispatch_results(
            catalog, told["attempts"], told["new_runs"], tick_end, now
        )
        cleaned = cleanup_existing(dispatched.catalog, status, now)
        unhandled = tick["unhandled"]
        unhandled = unhandled.union(_told(dispatched.rejected, "rejected_attempt", "attempt_id"))
        unhandled = unhandled.union(_told(cleaned.quarantined, "quarantined_run", "aws_id"))
        metrics = append_rows(cleaned.catalog["scheduler_metrics"], tick["metrics"])
        return {
            **cleaned.catalog,
            "scheduler_metrics": metrics,
            "events": dispatched.events,
            "actions": cleaned.actions,
            "unhandled": unhandled,
        }

    done = stage("cycle", [*catalog, "events", "actions", "unhandled"], last_stage)
    return Cycle(
        {name: done[name] for name in catalog},
        launches,
        done["events"],
        done["actions"],
        done["unhandled"],
    )


def _told(rows: DataFrame, reason: str, key: str) -> DataFrame:
    return rows.select(F.lit(reason).alias("reason"), F.col(key).cast("string").alias("row_key"))
