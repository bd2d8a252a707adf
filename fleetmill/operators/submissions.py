"""Requests to submit, update, re-point, enable or disable pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import texts, times
from fleetmill.session import lookup

UPDATE = "update"
JAR_ONLY = "jar_only"
SWITCH = "switch"
INSERT = "insert"

#: Retention given by an insert or an update.
SUBMITTED_RETENTION = 2

# Exit code and message of each way a request can be refused.
REFUSALS: dict[str, tuple[int, str]] = {
    "exists": (2, "Pipeline already exists"),
    "missing": (3, "Pipeline does not exist"),
    "enable_and_disable": (4, "You cannot enable and disable a pipeline at the same time"),
    "owner_invalid": (1, "Option --owner must be a valid email address or SNS topic ARN"),
    "owner_required_update": (1, "Owner required for updates"),
    "owner_required_insert": (1, "Owner required for new pipelines"),
    "no_schedule": (1, "Neither the request nor the definition gives a usable schedule"),
}


def object_matches(pipelines: DataFrame) -> DataFrame:
    """Per name or class, how many pipelines carry it as one or the other."""
    carried = F.explode(F.array_distinct(F.array("name", "class_name")))
    return (
        pipelines.select(carried.alias("pipeline_object"))
        .groupBy("pipeline_object")
        .agg(F.count(F.lit(1)).alias("match_count"))
    )


def match_by_name_or_class(submissions: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Per request, how many pipelines have its object as name or class; 0 if none.

    Names and classes are counted before the join, so it is a plain equi-join with one row per
    object, however many pipelines or requests share it.
    """
    requests = submissions.select("request_id", "pipeline_object")
    asked = requests.select("pipeline_object").distinct()
    matches = lookup(asked.join(object_matches(pipelines), "pipeline_object", "left"))
    return requests.join(matches, "pipeline_object").select(
        "request_id",
        "pipeline_object",
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
    )


def resolve_schedules(submissions: DataFrame, definitions: DataFrame, now: Column) -> DataFrame:
    """Each request with ``start_time``, ``period`` and ``next_run_time``.

    A request's own schedule or frequency goes before the definition's. The next run is the last
    one not after ``now`` for requests that start now, else the first one not before it; it is
    null when there is no usable schedule.
    """
    defined = definitions.select(
        "pipeline_object",
        F.col("start_time").alias("_start"),
        F.col("period").alias("_period"),
    )
    resolved = submissions.join(defined, "pipeline_object", "left").withColumns(
        {
            "start_time": F.coalesce("schedule", "_start"),
            "period": F.coalesce("frequency", "_period"),
        }
    )
    parsed = resolved.withColumns(
        {
            "period_months": times.period_months(F.col("period")),
            "period_micros": times.period_micros(F.col("period")),
        }
    )
    period = (F.col("period_months"), F.col("period_micros"))
    steps = F.when(
        F.col("start_now"), -times.steps_back(F.col("start_time"), now, *period)
    ).otherwise(times.steps_until(F.col("start_time"), now, *period))
    return times.with_steps(parsed, "start_time", steps, "next_run_time").drop(
        "_start", "_period", "period_months", "period_micros"
    )


def request_kind() -> Column:
    """What a request asks for; the first that applies counts."""
    return (
        F.when(F.col("do_update"), UPDATE)
        .when(F.col("update_jar_only"), JAR_ONLY)
        .when(F.col("enable_flag") | F.col("disable_flag"), SWITCH)
        .otherwise(INSERT)
    )


def refused_unseen() -> Column:
    """Why a request is refused before the pipelines are looked at; null if it is not."""
    return (
        F.when(F.col("enable_flag") & F.col("disable_flag"), "enable_and_disable")
        .when(~texts.is_valid_owner(F.col("owner")), "owner_invalid")
        .when(F.col("next_run_time").isNull(), "no_schedule")
    )


def submission_errors(outcomes: DataFrame) -> DataFrame:
    """Refused requests with exit code and message."""
    code, message = F.lit(None).cast("int"), F.lit(None).cast("string")
    for refusal, (number, text) in REFUSALS.items():
        here = F.col("outcome") == refusal
        code = F.when(here, number).otherwise(code)
        message = F.when(here, text).otherwise(message)
    return outcomes.where(F.col("outcome").isin(*REFUSALS)).select(
        "request_id",
        "pipeline_object",
        "outcome",
        code.alias("exit_code"),
        message.alias("message"),
    )
