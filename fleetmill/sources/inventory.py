"""The live inventory as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.schema import PIPELINE_STATES

# The description fields that carry the status of an entry.
HEALTH_KEY = "@healthStatus"
STATE_KEY = "@pipelineState"
CREATED_KEY = "@creationTime"


def load_inventory(pages: DataFrame) -> DataFrame:
    """The set of ids on all listing pages."""
    return pages.select(F.explode("ids").alias("aws_id")).distinct()


def _last_value(key: str) -> Column:
    same_key = F.filter("fields", lambda f: f["key"] == key)
    return F.try_element_at(same_key, F.lit(-1))["string_value"]


def flatten_status(descriptions: DataFrame) -> DataFrame:
    """S3: one flat row per description. Of a repeated key the last value counts."""
    return descriptions.select(
        "aws_id",
        "name",
        _last_value(HEALTH_KEY).alias("health_status"),
        _last_value(STATE_KEY).alias("pipeline_state"),
        _last_value(CREATED_KEY).alias("creation_time"),
    )


def validate_state(status: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows whose state is known or absent, rows with an unknown state).

    ``strict`` makes the valid part fail on the first unknown state instead of leaving it out.
    """
    known = F.coalesce(F.col("pipeline_state").isin(*PIPELINE_STATES), F.lit(True))
    rejected = status.where(~known)
    if not strict:
        return status.where(known), rejected
    message = F.concat(F.lit("unknown state: "), F.col("pipeline_state"))
    checked = F.when(known, F.col("pipeline_state")).otherwise(
        F.raise_error(message).cast("string")
    )
    return status.withColumn("pipeline_state", checked), rejected
