"""Table changes as new table states.

A change is a join of the table with the changed keys and gives the whole next state; nothing
is updated in place. Keys are unique on the change side, so a row matches at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with ``new`` added; columns are matched by name."""
    return table.unionByName(new.select(*table.columns))


def upsert_by_key(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows with the same key, the others are added."""
    kept = table.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def update_where(
    table: DataFrame, changes: DataFrame, key: list[str], columns: list[str]
) -> DataFrame:
    """Sets ``columns`` on rows matched by ``key``. A change to null is a change."""
    given = changes.select(
        *key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched")
    )
    matched = F.col("_matched").isNotNull()
    return table.join(given, key, "left").select(
        *[
            F.when(matched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in table.columns
        ]
    )


def updated_count(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """One row with the number of table rows that ``update_where`` changes."""
    matched = table.select(*key).join(changes.select(*key), key, "left_semi")
    return matched.agg(F.count(F.lit(1)).alias("updated_rows"))


def delete_where(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The table without the rows whose key is in ``keys``."""
    return table.join(keys.select(*key), key, "left_anti")
