"""Text patterns and message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetmill.functions.times import format_utc

# What counts as an owner. A text must match from its first to its last character.
EMAIL_PATTERN = (
    r"^([a-zA-Z0-9.!#$%&’'*+/=?^_`{|}~-]+)@([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*)$"
)
TOPIC_PATTERN = r"^arn:aws:sns:([a-z0-9-*]+):([0-9*]+):([a-zA-Z0-9-_]+)$"


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def is_email(text: Column) -> Column:
    return full_match(text, EMAIL_PATTERN)


def is_topic(text: Column) -> Column:
    return full_match(text, TOPIC_PATTERN)


def is_valid_owner(text: Column) -> Column:
    return is_email(text) | is_topic(text)


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    """True when ``text`` starts with one of ``prefixes``: one set lookup per prefix length."""
    found = F.lit(False)
    for length in sorted({len(p) for p in prefixes}):
        same_length = sorted({p for p in prefixes if len(p) == length})
        found = found | F.substring(text, 1, length).isin(same_length)
    return found


def deployment_name(prefix: str, now: Column, pipeline_id: Column, class_name: Column) -> Column:
    """``<prefix><now>_<id or 0>_<class>``."""
    return F.concat(
        F.lit(prefix),
        format_utc(now),
        F.lit("_"),
        F.coalesce(pipeline_id, F.lit(0)).cast("string"),
        F.lit("_"),
        class_name,
    )
