"""Inventory entries that no in-console run accounts for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.functions.texts import starts_with_any
from fleetmill.schema import PIPELINE_STATES

UNKNOWN = "Unknown"


def distinct_managed_ids(runs: DataFrame) -> DataFrame:
    """A2: the ids of in-console runs, each once."""
    return runs.where("in_console").select("aws_id").distinct()


def unmanaged_inventory(inventory: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Inventory ids without an in-console run; all of them with ``force``."""
    ids = inventory.select("aws_id")
    if force:
        return ids
    return ids.join(runs.where("in_console").select("aws_id"), "aws_id", "left_anti")


def id_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of ``left`` that ``right`` lacks, each once."""
    return left.select("aws_id").subtract(right.select("aws_id"))


def default_cutoff(now: Column) -> Column:
    """Start of the day two months before ``now``."""
    return times.start_of_day(times.plus_months(now, F.lit(-2)))


def deletable_unmanaged(
    status: DataFrame,
    exclude_prefixes: list[str],
    cutoff: Column,
    own_prefix: str,
    state: str = "FINISHED",
    force: bool = False,
) -> DataFrame:
    """entries in ``state``, created before the cutoff's day, whose name is not protected.

    A name is protected if it starts with an excluded prefix; ``force`` lifts that for names
    with the service's own prefix and changes nothing for others.
    """
    if any(not p.strip() for p in exclude_prefixes):
        raise ValueError("an excluded prefix must not be empty")
    if state not in PIPELINE_STATES:
        raise ValueError(f"unknown state: {state}")
    unprotected = ~starts_with_any(F.col("name"), exclude_prefixes)
    if force:
        unprotected = F.col("name").startswith(own_prefix) | unprotected
    created = times.parse_local(F.col("creation_time"))
    return status.where(
        (F.col("pipeline_state") == state)
        & unprotected
        & (created < times.start_of_day(cutoff))
    )


def runs_in_ids(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """In-console runs whose id is in ``ids``."""
    return runs.where("in_console").join(ids.select("aws_id"), "aws_id", "left_semi")


def state_of() -> Column:
    return F.coalesce("pipeline_state", F.lit(UNKNOWN)).alias("state")


def date_of() -> Column:
    date = F.substring_index("creation_time", "T", 1)
    return F.coalesce(date, F.lit(UNKNOWN)).alias("created_on")


def count_by_state(status: DataFrame) -> DataFrame:
    """A3: entries per state, most frequent first, ties by state."""
    return (
        status.groupBy(state_of())
        .agg(F.count(F.lit(1)).alias("entries"))
        .orderBy(F.desc("entries"), "state")
    )


def count_by_date(status: DataFrame) -> DataFrame:
    """A4: entries per creation date, latest first in text order."""
    return (
        status.groupBy(date_of())
        .agg(F.count(F.lit(1)).alias("entries"))
        .orderBy(F.desc("created_on"))
    )
