"""Schemas and constraints of the five fleet tables.

``class``, ``start`` and ``end`` are reserved words in several SQL engines, so the columns
are called ``class_name``, ``start_time`` and ``end_time``. Timestamps are zone-free UTC wall
clock (``TIMESTAMP_NTZ``); results do not depend on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(*columns) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in columns])


PIPELINES = _schema(
    ("id", LongType(), False),
    ("name", StringType(), False),
    ("jar", StringType(), False),
    ("class_name", StringType(), False),
    ("is_active", BooleanType(), False),
    ("retention", IntegerType(), False),
    ("start_time", TimestampNTZType(), False),
    ("period", StringType(), False),
    ("end_time", TimestampNTZType(), True),
    ("next_run_time", TimestampNTZType(), True),
    ("backfill", BooleanType(), False),
    ("owner", StringType(), True),
)

SCHEDULED_PIPELINES = _schema(
    ("aws_id", StringType(), False),
    ("pipeline_id", LongType(), False),
    ("pipeline_name", StringType(), False),
    ("scheduled_start", TimestampNTZType(), False),
    ("actual_start", TimestampNTZType(), False),
    ("deployed_time", TimestampNTZType(), False),
    ("status", StringType(), False),
    ("in_console", BooleanType(), False),
)

FAILED_PIPELINES = _schema(
    ("aws_id", StringType(), False),
    ("pipeline_id", LongType(), False),
    ("resolved", BooleanType(), False),
    ("checked_time", TimestampNTZType(), False),
)

SCHEDULE_FAILURE_COUNTERS = _schema(
    ("pipeline_id", LongType(), False),
    ("failure_count", IntegerType(), False),
    ("updated_at", TimestampNTZType(), False),
)

SCHEDULER_METRICS = _schema(
    ("start_time", TimestampNTZType(), False),
    ("pipeline_count", IntegerType(), True),
    ("end_time", TimestampNTZType(), True),
)

#: Inventory description as delivered: a list of key / string-value fields per id.
INVENTORY_DESCRIPTION = StructType(
    [
        StructField("aws_id", StringType(), False),
        StructField("name", StringType(), False),
        StructField(
            "fields",
            ArrayType(
                StructType(
                    [
                        StructField("key", StringType(), False),
                        StructField("string_value", StringType(), True),
                    ]
                )
            ),
            False,
        ),
    ]
)

#: One page of an inventory listing.
INVENTORY_PAGE = StructType(
    [
        StructField("page", LongType(), False),
        StructField("ids", ArrayType(StringType()), False),
    ]
)


@dataclass(frozen=True)
class TableSpec:
    """Primary key, required columns and text limits of one table."""

    schema: StructType
    key: tuple[str, ...]
    max_length: dict[str, int] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


# The text limits of the catalog's columns.
TABLES: dict[str, TableSpec] = {
    "pipelines": TableSpec(
        PIPELINES,
        ("id",),
        {"name": 200, "jar": 200, "class_name": 200, "period": 50, "owner": 254},
    ),
    "scheduled_pipelines": TableSpec(
        SCHEDULED_PIPELINES, ("aws_id",), {"aws_id": 254, "pipeline_name": 500, "status": 40}
    ),
    "failed_pipelines": TableSpec(FAILED_PIPELINES, ("aws_id",), {"aws_id": 254}),
    "schedule_failure_counters": TableSpec(SCHEDULE_FAILURE_COUNTERS, ("pipeline_id",)),
    "scheduler_metrics": TableSpec(SCHEDULER_METRICS, ("start_time",)),
}

#: Tables that reference ``pipelines`` through ``pipeline_id``.
CHILD_TABLES = ("scheduled_pipelines", "failed_pipelines", "schedule_failure_counters")

# Every state an inventory entry can be in.
PIPELINE_STATES = (
    "ACTIVATING",
    "CANCELED",
    "CASCADE_FAILED",
    "DEACTIVATING",
    "DELETING",
    "FAILED",
    "FINISHED",
    "INACTIVE",
    "PAUSED",
    "PENDING",
    "RUNNING",
    "SCHEDULING",
    "SCHEDULED",
    "SHUTTING_DOWN",
    "SKIPPED",
    "TIMEDOUT",
    "VALIDATING",
    "WAITING_FOR_RUNNER",
    "WAITING_ON_DEPENDENCIES",
)
