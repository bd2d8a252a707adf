"""K1 to K5: what the database checked on write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmill.operators.ordered import number_rows
from fleetmill.schema import CHILD_TABLES, TableSpec
from fleetmill.session import lookup
from fleetmill.sources.catalog import Catalog


def pk_violations(table: DataFrame, key: list[str]) -> DataFrame:
    """K1: keys that are null or occur more than once, with their row count."""
    has_null = F.lit(False)
    for name in key:
        has_null = has_null | F.col(name).isNull()
    return (
        table.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where((F.col("row_count") > 1) | has_null)
    )


def domain_violations(table: DataFrame, spec: TableSpec) -> DataFrame:
    """K2: one row per violated column rule: null where required, or longer than its limit.

    Rows that keep all rules, the usual ones, are filtered out before rules are listed.
    """
    rules = [(F.col(c).isNull(), c, "null") for c in spec.required] + [
        (F.length(c) > limit, c, "too long") for c, limit in spec.max_length.items()
    ]
    broken = F.lit(False)
    for violated, _, _ in rules:
        broken = broken | violated
    listed = [
        F.when(violated, F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule")))
        for violated, c, rule in rules
    ]
    return (
        table.where(broken)
        .select(*spec.key, F.explode(F.array_compact(F.array(*listed))).alias("v"))
        .select(*spec.key, "v.column_name", "v.rule")
    )


def orphan_rows(child: DataFrame, pipelines: DataFrame) -> DataFrame:
    """K3: child rows whose ``pipeline_id`` is not the id of a pipeline."""
    parents = pipelines.select(F.col("id").alias("pipeline_id"))
    return child.join(parents, "pipeline_id", "left_anti")


def added_pk_violations(table: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """K1 of ``table`` together with the rows ``added``, where ``table`` alone keeps the rule.

    Only keys that are added can break it, so the table is neither grouped nor shuffled as long as
    the added keys are few: its key columns are looked up among them.
    """
    keys = lookup(added.groupBy(*key).agg(F.count(F.lit(1)).alias("_added")))
    there = table.select(*key).join(keys.select(*key), key, "left_semi")
    has_null = F.lit(False)
    for name in key:
        has_null = has_null | F.col(name).isNull()
    rows = F.col("_added") + F.coalesce("_there", F.lit(0))
    return (
        keys.join(there.withColumn("_there", F.lit(1)), key, "left")
        .select(*key, rows.alias("row_count"))
        .where((F.col("row_count") > 1) | has_null)
    )


def changed_orphans(
    child: DataFrame, added: DataFrame, pipelines: DataFrame, deleted: DataFrame
) -> DataFrame:
    """K3 after a change: of the rows ``added``, and of those whose pipeline went.

    ``child`` are the rows before, which had their pipelines; ``pipelines`` is the table after the
    change and ``deleted (id)`` what it lost. An id that was deleted and is there again is no loss.
    """
    owners = lookup(added.select(F.col("pipeline_id").alias("id")).distinct())
    new = orphan_rows(added, lookup(_among(pipelines, owners)))
    lost = lookup(deleted.select("id").distinct())
    back = _among(pipelines, lost)
    gone = lookup(lost.join(back, "id", "left_anti").select(F.col("id").alias("pipeline_id")))
    left = child.join(gone, "pipeline_id", "left_semi")
    return left.unionByName(new)


def _among(pipelines: DataFrame, ids: DataFrame) -> DataFrame:
    return pipelines.select("id").join(ids, "id", "left_semi")


def cascade_delete(catalog: Catalog, ids: DataFrame) -> Catalog:
    """K4: the catalog without the pipelines in ``ids`` (column ``id``) and all their rows."""
    owners = ids.select(F.col("id").alias("pipeline_id"))
    kept = {"pipelines": catalog["pipelines"].join(ids.select("id"), "id", "left_anti")}
    for name in CHILD_TABLES:
        kept[name] = catalog[name].join(owners, "pipeline_id", "left_anti")
    return {**catalog, **kept}


def assign_ids(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """K5: gives the rows of ``new`` the ids that follow the largest existing one."""
    last = existing.select(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    numbered = number_rows(new, order, "_n")
    return numbered.withColumn("id", last + F.col("_n") + 1).drop("_n")
