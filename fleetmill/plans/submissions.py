"""A batch of requests applied to the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.operators.constraints import assign_ids
from fleetmill.operators.ordered import HEAVY_GROUP_ROWS, per_group, running
from fleetmill.operators.submissions import (
    INSERT,
    JAR_ONLY,
    SUBMITTED_RETENTION,
    SWITCH,
    UPDATE,
    refused_unseen,
    request_kind,
)
from fleetmill.session import lookup, materialize


@dataclass(frozen=True)
class Submitted:
    """The pipelines after the batch and what became of each request."""

    pipelines: DataFrame
    outcomes: DataFrame


#: Later than every request: the name of a pipeline that is never renamed.
NEVER = (1 << 63) - 1

#: Which outcomes set a group of fields; the last such request decides them.
WRITES = {
    "_whole": ("updated", "inserted"),
    "_jar": ("updated", "inserted", "jar_updated"),
    "_active": ("updated", "inserted", "enabled", "disabled"),
}


def _renames(requests: DataFrame) -> DataFrame:
    """Per object its first live update that cannot be refused if some pipeline has it as class."""
    updates = requests.where(
        F.col("_refused").isNull()
        & (F.col("kind") == UPDATE)
        & F.col("owner").isNotNull()
        & ~F.col("dry_run")
    )
    return updates.groupBy(F.col("pipeline_object").alias("class_name")).agg(
        F.min("request_id").alias("_renamed_at")
    )


def _carriers(named: DataFrame) -> DataFrame:
    """Per name or class: pipelines that carry it before the batch, and until which request any does.

    A class is carried for good. A name that differs from the class is carried until the pipeline
    is updated through its class, which renames it.
    """
    always = F.struct(F.col("class_name").alias("pipeline_object"), F.lit(NEVER).alias("_until"))
    by_name = F.struct(F.col("name").alias("pipeline_object"), F.col("_renamed_at").alias("_until"))
    carried = F.when(F.col("name") == F.col("class_name"), F.array(always)).otherwise(
        F.array(by_name, always)
    )
    return (
        named.select(F.inline(carried))
        .groupBy("pipeline_object")
        .agg(F.count(F.lit(1)).alias("match_count"), F.max("_until").alias("_until"))
    )


def request_outcomes(resolved: DataFrame, pipelines: DataFrame) -> DataFrame:
    """What becomes of each request when the batch is applied in ``request_id`` order.

    No request has to wait for another, because existence follows from minima and maxima.
    Classes never change, and a live update through a class that exists is always accepted, so
    the first one tells when the pipelines of the class lose their other name. An object is there
    before the last of its carriers is renamed, and again after the first valid insert that
    follows.

    ``match_count`` counts the pipelines that carry the object before the batch.
    """
    requests = resolved.withColumns({"kind": request_kind(), "_refused": refused_unseen()})
    return _outcomes(requests, _renamed_at(pipelines, lookup(_renames(requests))))


def _renamed_at(pipelines: DataFrame, renames: DataFrame) -> DataFrame:
    """Pipelines with the request that renames each of them, or ``NEVER``."""
    other = F.when(F.col("name") != F.col("class_name"), F.col("_renamed_at"))
    return pipelines.join(renames, "class_name", "left").withColumn(
        "_renamed_at", F.coalesce(other, F.lit(NEVER))
    )


def _outcomes(requests: DataFrame, named: DataFrame) -> DataFrame:
    seen = F.col("_refused").isNull()
    insert, no_owner = F.col("kind") == INSERT, F.col("owner").isNull()
    asked = requests.groupBy("pipeline_object").agg(F.count(F.lit(1)).alias("_asked"))
    objects = lookup(
        asked.join(_carriers(named), "pipeline_object", "left").select(
            "pipeline_object",
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
            "_until",
        )
    )
    free = F.col("_until").isNull() | (F.col("request_id") > F.col("_until"))
    inserts = requests.where(seen & insert & ~no_owner & ~F.col("dry_run"))
    first_inserts = lookup(
        inserts.select("pipeline_object", "request_id")
        .join(objects, "pipeline_object")
        .where(free)
        .groupBy("pipeline_object")
        .agg(F.min("request_id").alias("_first_insert"))
    )
    exists = ~free | F.coalesce(F.col("request_id") > F.col("_first_insert"), F.lit(False))
    outcome = (
        F.when(~seen, F.col("_refused"))
        .when((F.col("kind") == UPDATE) & no_owner, "owner_required_update")
        .when(~insert & ~exists, "missing")
        .when(insert & exists, "exists")
        .when(insert & no_owner, "owner_required_insert")
        .when(F.col("kind") == UPDATE, "updated")
        .when(F.col("kind") == JAR_ONLY, "jar_updated")
        .when((F.col("kind") == SWITCH) & F.col("disable_flag"), "disabled")
        .when(F.col("kind") == SWITCH, "enabled")
        .otherwise("inserted")
    )
    return (
        requests.join(objects, "pipeline_object")
        .join(first_inserts, "pipeline_object", "left")
        .withColumn("outcome", outcome)
        .drop("_refused", "_until", "_first_insert")
    )


def _deciding() -> dict[str, Column]:
    """Per group of fields the number of a request that sets it."""
    return {
        field: F.when(F.col("outcome").isin(*outcomes), F.col("request_id"))
        for field, outcomes in WRITES.items()
    }


def _final_writes(writes: DataFrame) -> DataFrame:
    """Per object the requests that decide each group of fields in the end."""
    inserted = F.when(F.col("outcome") == "inserted", F.col("request_id"))
    return writes.groupBy("pipeline_object").agg(
        F.max(inserted).alias("_insert_id"),
        *[F.max(request).alias(field) for field, request in _deciding().items()],
    ).withColumn("_until", F.lit(NEVER))


def _writes_until(
    writes: DataFrame, named: DataFrame, heavy_rows: int = HEAVY_GROUP_ROWS
) -> DataFrame:
    """Per name and request that ends it, the last requests before that.

    The ends are put among the requests for the name, and running maxima of request numbers give
    what holds at each. No request is paired with a pipeline.
    """
    ends = lookup(
        named.where(F.col("_renamed_at") < NEVER)
        .select(F.col("name").alias("pipeline_object"), F.col("_renamed_at").alias("request_id"))
        .distinct()
    )
    keys, order = ["pipeline_object"], ["request_id"]
    ended = lookup(ends.select(*keys).distinct())
    marked = (
        writes.join(ended, "pipeline_object", "left_semi")
        .select(*keys, "request_id", "outcome")
        .unionByName(ends.withColumn("outcome", F.lit("")))
    )
    up_to_here = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def ordinary(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: F.max(r).over(up_to_here) for f, r in _deciding().items()})

    def sliced(rows: DataFrame) -> DataFrame:
        for field, request in _deciding().items():
            rows = running(rows, keys, order, request, field, how="max")
        return rows

    placed = per_group(marked, keys, order, ordinary, sliced, heavy_rows)
    return placed.where(F.col("outcome") == "").select(
        "pipeline_object",
        F.lit(None).cast("bigint").alias("_insert_id"),
        *WRITES,
        F.col("request_id").alias("_until"),
    )


def _with_values(decided: DataFrame, writes: DataFrame) -> DataFrame:
    """The values that the deciding requests carry, as structs that start with the request."""
    values = {
        "_whole": ("start_time", "period", "next_run_time", "owner", "no_backfill"),
        "_jar": ("jar",),
        "_active": ("disable_flag",),
    }
    for field, columns in values.items():
        given = writes.select(
            F.col("request_id").alias(field), F.struct("request_id", *columns).alias("_given")
        )
        decided = (
            decided.join(given, field, "left")
            .drop(field)
            .withColumnRenamed("_given", field)
        )
    return decided


def _later(field: str, member: str) -> Column:
    """``member`` of the later one of the requests for a pipeline's class and for its name."""
    by_name, by_class = F.col(f"_by_name.{field}"), F.col(f"_by_class.{field}")
    none = F.lit(-1).cast("bigint")
    named = F.coalesce(by_name["request_id"], none) > F.coalesce(by_class["request_id"], none)
    return F.when(named, by_name[member]).otherwise(by_class[member])


def apply_submissions(
    resolved: DataFrame, pipelines: DataFrame, heavy_rows: int = HEAVY_GROUP_ROWS
) -> Submitted:
    """Applies the requests one after the other, all at once.

    update > jar only > enable / disable > insert, by the first that a request asks for. Every
    pipeline with the object as name or class is changed. An update sets name, jar, activity,
    period, next run, owner and backfill, sets the retention to 2 and lifts the end; start and
    class stay. Dry runs are checked and reported and write nothing.

    A pipeline takes each field from the last accepted request for its class, or for its name
    before it is renamed. A pipeline that an insert makes has the object as both.
    """
    # read several times each: once here would mean joining definitions and pipelines again
    requests = materialize(
        resolved.withColumns({"kind": request_kind(), "_refused": refused_unseen()})
    )
    renames = lookup(_renames(requests))
    named = materialize(_renamed_at(pipelines.select("name", "class_name"), renames))
    outcomes = materialize(_outcomes(requests, named))
    writes = outcomes.where(
        F.col("outcome").isin(*set().union(*WRITES.values())) & ~F.col("dry_run")
    )
    decided = _final_writes(writes).unionByName(_writes_until(writes, named, heavy_rows))
    decided = lookup(_with_values(decided, writes))

    given = F.struct(*WRITES)
    by_class = decided.where(F.col("_until") == NEVER).select(
        F.col("pipeline_object").alias("class_name"), given.alias("_by_class")
    )
    by_name = decided.select(
        F.col("pipeline_object").alias("name"),
        F.col("_until").alias("_renamed_at"),
        given.alias("_by_name"),
    )
    touched = (
        _renamed_at(pipelines, renames)
        .join(by_class, "class_name", "left")
        .join(by_name, ["name", "_renamed_at"], "left")
    )
    whole = _later("_whole", "request_id").isNotNull()
    jar, disabled = _later("_jar", "jar"), _later("_active", "disable_flag")
    changed = {
        "name": F.when(F.col("_renamed_at") < NEVER, F.col("class_name")).otherwise(F.col("name")),
        "jar": F.when(_later("_jar", "request_id").isNotNull(), jar).otherwise(F.col("jar")),
        "is_active": F.coalesce(~disabled, F.col("is_active")),
        "retention": F.when(whole, SUBMITTED_RETENTION).otherwise(F.col("retention")),
        "end_time": F.when(~whole, F.col("end_time")),
        "backfill": F.when(whole, ~_later("_whole", "no_backfill")).otherwise(F.col("backfill")),
    } | {
        c: F.when(whole, _later("_whole", c)).otherwise(F.col(c))
        for c in ("period", "next_run_time", "owner")
    }
    kept = touched.select(*[changed.get(c, F.col(c)).alias(c) for c in pipelines.columns])

    inserted = decided.where(F.col("_insert_id").isNotNull()).join(
        writes.select(
            F.col("request_id").alias("_insert_id"), F.col("start_time").alias("_start")
        ),
        "_insert_id",
    ).select(
        F.col("pipeline_object").alias("name"),
        "_jar.jar",
        F.col("pipeline_object").alias("class_name"),
        (~F.col("_active.disable_flag")).alias("is_active"),
        F.lit(SUBMITTED_RETENTION).alias("retention"),
        F.col("_start").alias("start_time"),
        "_whole.period",
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        "_whole.next_run_time",
        (~F.col("_whole.no_backfill")).alias("backfill"),
        "_whole.owner",
        "_insert_id",
    )
    added = assign_ids(pipelines, inserted, ["_insert_id"]).select(*pipelines.columns)
    return Submitted(kept.unionByName(added), outcomes)
