"""Planning a tick, and taking in what came of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators import schedule, streaks
from fleetmill.session import lookup, materialize
from fleetmill.sources.catalog import Catalog
from fleetmill.sources.changes import append_rows


@dataclass(frozen=True)
class TickPlan:
    """Launches of a tick, pipelines whose period is no use, and the scheduler's own row."""

    launches: DataFrame
    rejected: DataFrame
    metrics: DataFrame


def schedule_tick(
    catalog: Catalog,
    tick_end: Column,
    now: Column,
    prefix: str,
    max_pipelines: int | None = schedule.MAX_PIPELINES,
    jar_locations: DataFrame | None = None,
    finished_at: Column | None = None,
) -> TickPlan:
    """Which pipelines are launched in this tick, and for how many runs each.

    With ``jar_locations(jar, location)`` each launch gets the place its jar was resolved to.

    The due pipelines are written out: all results are made of the same ones, and what tells a period
    from a useless one, a test of texts, is not moved into what the pipeline table is made of.
    """
    due = materialize(schedule.take_due(catalog["pipelines"], tick_end, max_pipelines))
    usable, rejected = schedule.parse_periods(due)
    launches = schedule.backfill_plan(usable, tick_end, now, prefix)
    if jar_locations is not None:
        launches = launches.join(lookup(jar_locations), "jar", "left")
    ended = F.lit(None).cast("timestamp_ntz") if finished_at is None else finished_at
    metrics = due.agg(F.count(F.lit(1)).cast("int").alias("pipeline_count")).select(
        now.alias("start_time"), "pipeline_count", ended.alias("end_time")
    )
    return TickPlan(launches, rejected, metrics)


@dataclass(frozen=True)
class DispatchResult:
    """The catalog after a tick, what is to be told, and attempts without a pipeline."""

    catalog: Catalog
    events: DataFrame
    rejected: DataFrame


def apply_dispatch_results(
    catalog: Catalog,
    attempts: DataFrame,
    new_runs: DataFrame,
    tick_end: Column,
    now: Column,
    max_failures: int = streaks.MAX_FAILURES,
) -> DispatchResult:
    """Success moves the next run on and clears the counter; failure counts up or deactivates.

    ``attempts(pipeline_id, attempt_id, ok, log)`` are all applied, in ``attempt_id`` order, as W4
    replays them. Only attempts without a pipeline are returned as rejected. The next run is moved
    past the tick's end if any attempt succeeded, even if the pipeline ends earlier; otherwise it
    stays, so the next tick owes a longer backfill. A pipeline that is deactivated on the way stays
    so. Its counter row stays at the maximum: once re-activated, its next failure deactivates it
    again. A row that no attempt changed keeps its time.

    The attempted pipelines are joined once with the pipeline table and written out; every result
    is made of that table and of the replayed attempts.
    """
    pipelines, counters = catalog["pipelines"], catalog["schedule_failure_counters"]
    tried = lookup(
        attempts.select("pipeline_id")
        .distinct()
        .join(
            pipelines.select(F.col("id").alias("pipeline_id"), "next_run_time", "period"),
            "pipeline_id",
        )
    )
    keys = tried.select("pipeline_id")
    rejected = attempts.join(keys, "pipeline_id", "left_anti").select(*attempts.columns)
    known = materialize(
        attempts.join(keys, "pipeline_id", "left_semi").select(
            "pipeline_id", "attempt_id", "ok", "log", now.alias("attempt_time")
        )
    )
    replayed = materialize(streaks.failure_streaks(known, counters, max_failures))

    ended = replayed.groupBy("pipeline_id").agg(
        F.max("ok").alias("_ok"),
        F.max(F.col("event") == streaks.DEACTIVATED).alias("_gives_up"),
        F.min(F.coalesce("failure_number", F.lit(0))).alias("_least"),
        F.max_by("counter", "attempt_id").alias("failure_count"),
    )
    parsed = ended.join(tried, "pipeline_id").withColumns(
        {
            "period_months": times.period_months(F.col("period")),
            "period_micros": times.period_micros(F.col("period")),
        }
    )
    period = (F.col("period_months"), F.col("period_micros"))
    steps = F.when(
        F.col("_ok"), times.steps_until(F.col("next_run_time"), tick_end, *period)
    ).otherwise(0)
    attempted = lookup(
        times.with_steps(parsed, "next_run_time", steps, "_next").select(
            "pipeline_id",
            "_ok",
            "_next",
            "_gives_up",
            (F.col("_least") <= max_failures).alias("_counted"),
            "failure_count",
        )
    )

    result = attempted.select(F.col("pipeline_id").alias("id"), "_ok", "_next", "_gives_up")
    changed = {
        "next_run_time": F.when(F.col("_ok"), F.col("_next")).otherwise(F.col("next_run_time")),
        "is_active": F.when(F.col("_gives_up"), False).otherwise(F.col("is_active")),
    }
    next_pipelines = pipelines.join(result, "id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in pipelines.columns]
    )
    events = replayed.where(~F.col("ok")).select(
        "pipeline_id", "event", F.col("failure_number").cast("int"), "log"
    )
    replaced = attempted.where("_counted")
    counted_up = replaced.where("failure_count > 0").select(
        "pipeline_id", "failure_count", now.alias("updated_at")
    )
    next_counters = counters.join(
        replaced.select("pipeline_id"), "pipeline_id", "left_anti"
    ).unionByName(counted_up.select(*counters.columns))
    launched = attempted.where("_ok").select("pipeline_id")
    runs = append_rows(
        catalog["scheduled_pipelines"], new_runs.join(launched, "pipeline_id", "left_semi")
    )
    return DispatchResult(
        {
            **catalog,
            "pipelines": next_pipelines,
            "schedule_failure_counters": next_counters,
            "scheduled_pipelines": runs,
        },
        events,
        rejected,
    )
