"""Which pipelines are due, how many runs each owes, and what becomes of a dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.functions.texts import deployment_name
from fleetmill.operators.ordered import number_rows
from fleetmill.session import lookup, shuffle_partitions

#: Default number of pipelines taken per run.
MAX_PIPELINES = 60

#: A top-n up to this size is taken by one task from the tops of all tasks.
SMALL_TOP = 1_000

#: Run instants made from one row at a time.
INSTANTS_PER_CHUNK = 10_000


def parse_periods(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``period_months`` or ``period_micros``, rows whose period is no use)."""
    parsed = table.withColumns(
        {
            "period_months": times.period_months(F.col("period")),
            "period_micros": times.period_micros(F.col("period")),
        }
    )
    usable = F.coalesce(times.is_usable_period(F.col("period")), F.lit(False))
    return parsed.where(usable), table.where(~usable)


def run_counts(table: DataFrame, start: str, until: Column, out: str = "run_count") -> DataFrame:
    """Steps from ``start`` (included) to ``until`` (excluded); 0 if start is not before."""
    return table.withColumn(out, times.steps_until(F.col(start), until, *_period()))


def advance_next_run(
    table: DataFrame, start: str, until: Column, out: str = "advanced"
) -> DataFrame:
    """``start`` stepped forward until it is not before ``until``."""
    steps = times.steps_until(F.col(start), until, *_period())
    return times.with_steps(table, start, steps, out)


def previous_run(table: DataFrame, start: str, now: Column, out: str = "previous") -> DataFrame:
    """T4: ``start`` stepped backward until it is not after ``now``."""
    steps = times.steps_back(F.col(start), now, *_period())
    return times.with_steps(table, start, -steps, out)


def _period() -> tuple[Column, Column]:
    return F.col("period_months"), F.col("period_micros")


def is_due(tick_end: Column) -> Column:
    return (
        (F.col("next_run_time") < tick_end)
        & (F.col("end_time").isNull() | (F.col("end_time") > F.col("next_run_time")))
        & F.col("is_active")
    )


def due_pipelines(pipelines: DataFrame, tick_end: Column) -> DataFrame:
    """active pipelines whose next run lies before the tick's end and before their own."""
    return pipelines.where(is_due(tick_end))


def take_due(
    pipelines: DataFrame, tick_end: Column, max_pipelines: int | None = MAX_PIPELINES
) -> DataFrame:
    """O1: the due pipelines with the earliest next run; ties go by id. None takes all."""
    due = due_pipelines(pipelines, tick_end)
    if max_pipelines is None:
        return due
    if max_pipelines <= SMALL_TOP:
        return due.orderBy("next_run_time", "id").limit(max_pipelines)
    numbered = number_rows(due, ["next_run_time", "id"], "_n")
    return numbered.where(F.col("_n") < max_pipelines).drop("_n")


def jar_manifest(due: DataFrame, locations: DataFrame) -> DataFrame:
    """Each jar of the due pipelines once, with where it was resolved to (null: nowhere)."""
    return due.select("jar").distinct().join(locations, "jar", "left")


def deployment_names(due: DataFrame, now: Column, prefix: str) -> DataFrame:
    """Adds ``deployment_name``."""
    name = deployment_name(prefix, now, F.col("id"), F.col("class_name"))
    return due.withColumn("deployment_name", name)


def backfill_plan(due: DataFrame, tick_end: Column, now: Column, prefix: str) -> DataFrame:
    """T5: the launch of each due pipeline: name, first instant, number of runs, period.

    ``due`` has parsed periods. Without backfill one run is owed, with it all that were missed
    up to the tick's end or the pipeline's own, at least one.
    """
    until = F.least(tick_end, F.col("end_time"))
    owed = F.when(
        F.col("backfill"), times.steps_until(F.col("next_run_time"), until, *_period())
    ).otherwise(F.lit(1).cast("bigint"))
    return deployment_names(due, now, prefix).select(
        F.col("id").alias("pipeline_id"),
        "deployment_name",
        "class_name",
        "jar",
        F.col("next_run_time").alias("first_run"),
        until.alias("until"),
        F.greatest(F.lit(1).cast("bigint"), owed).alias("times"),
        F.col("period").alias("every"),
        "period_months",
        "period_micros",
    )


def expand_runs(plan: DataFrame) -> DataFrame:
    """One row per run instant of a backfill plan.

    A plan row may owe millions of runs, so it is first cut into chunks of run numbers. The
    chunks are spread over all tasks before they are expanded; no row ever holds a long array.
    Which months are too short for a series is found once per plan row, and only looked up per run.
    """
    size = F.lit(INSTANTS_PER_CHUNK).cast("bigint")
    one = F.lit(1).cast("bigint")
    ends = times.month_ends(F.col("first_run"), F.col("period_months"))
    chunks = plan.select(
        "pipeline_id",
        "first_run",
        "times",
        "period_months",
        "period_micros",
        ends.alias("month_ends"),
    ).select(
        "*",
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("times") - one, size))
        ).alias("chunk"),
    ).repartition(shuffle_partitions(plan.sparkSession), "pipeline_id", "chunk")
    first = F.col("chunk") * size
    numbers = F.sequence(first, F.least(first + size, F.col("times")) - one)
    run_time = times.step_at(
        F.col("first_run"), F.col("run_number"), *_period(), F.col("month_ends")
    )
    return chunks.select("*", F.explode(numbers).alias("run_number")).select(
        "pipeline_id", "run_number", run_time.alias("run_time")
    )


def tick_windows(table: DataFrame, ts: str) -> DataFrame:
    """The hour that holds ``ts`` (start and end) and the next whole hour after it."""
    hour = F.lit(times.MICROS_PER_HOUR).cast("bigint")
    start = times.floor_to(F.col(ts), times.MICROS_PER_HOUR)
    return table.withColumn("tick_start", start).withColumns(
        {
            "tick_end": times.plus_micros(F.col("tick_start"), hour),
            "next_whole_hour": times.floor_to(
                times.plus_micros(F.col(ts), hour), times.MICROS_PER_HOUR
            ),
        }
    )


def normalize_timestamps(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """ISO texts with an offset as UTC wall clock; (all parsed, rows with one that is not).

    Null stays null and is no reason to reject.
    """
    parsed = table.withColumns({f"{c}_utc": times.parse_offset(F.col(c)) for c in columns})
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & F.col(f"{c}_utc").isNull())
    good = parsed.where(~bad).withColumns(
        {f"{c}_text": times.format_utc(F.col(f"{c}_utc")) for c in columns}
    )
    return good, parsed.where(bad).select(*table.columns)


def with_failure_count(pipelines: DataFrame, counters: DataFrame) -> DataFrame:
    """Pipelines with their consecutive schedule failures, 0 where none are recorded."""
    counts = counters.select(F.col("pipeline_id").alias("id"), "failure_count")
    return pipelines.join(counts, "id", "left").withColumn(
        "failure_count", F.coalesce("failure_count", F.lit(0))
    )


def activated_runs(
    deployed: DataFrame,
    inventory_names: DataFrame,
    activations: DataFrame,
    scheduled_start: Column,
    actual_start: Column,
) -> tuple[DataFrame, DataFrame]:
    """(a run row per inventory id of each deployed name, names without any id).

    ``deployed(pipeline_id, pipeline_name, deployed_time)`` has one row per name,
    ``activations(pipeline_name, activated)`` likewise. A run that could not be activated still
    is a run, with status ``fail``.
    """
    launched = lookup(deployed.join(activations, "pipeline_name", "left"))
    runs = inventory_names.join(launched, "pipeline_name").select(
        "aws_id",
        "pipeline_id",
        "pipeline_name",
        scheduled_start.alias("scheduled_start"),
        actual_start.alias("actual_start"),
        "deployed_time",
        F.when(F.col("activated"), "success").otherwise("fail").alias("status"),
        F.lit(True).alias("in_console"),
    )
    # a name may have any number of ids: only its existence goes into the second join
    known_names = inventory_names.select("pipeline_name").distinct()
    errors = deployed.join(known_names, "pipeline_name", "left_anti").select(
        "pipeline_id",
        "pipeline_name",
        F.concat(F.lit("pipeline with name "), F.col("pipeline_name"), F.lit(" not found")).alias(
            "error"
        ),
    )
    return runs, errors
