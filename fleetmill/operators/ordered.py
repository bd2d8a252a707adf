"""Running values over ordered groups of any size.

A window keeps a whole group in one task. That is fine for the usual group and impossible for
one that holds a third of the table. ``heavy_groups`` finds the groups above a row limit with
one map-side-combined count. Their rows are cut into contiguous, evenly sized slices by range
partitioning on (group, order columns): one group then spans many slices. A running value is
the local one inside the slice combined with the total of the group's earlier slices, and the
table of slice totals has at most (heavy groups + slices) rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.session import lookup, materialize, shuffle_partitions

#: A group with more rows than this is not given to one task.
HEAVY_GROUP_ROWS = 4_000_000

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE_HERE = (Window.unboundedPreceding, -1)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def heavy_groups(
    df: DataFrame, keys: list[str], limit: int = HEAVY_GROUP_ROWS, sizes: DataFrame | None = None
) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. There are at most rows / limit of them.

    ``sizes(keys…, count)`` saves the count where it is known already.
    """
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    heavy = lookup(sizes.where(F.col("count") > limit).select(*keys))
    return None if heavy.isEmpty() else heavy


def split_heavy(
    df: DataFrame, keys: list[str], limit: int = HEAVY_GROUP_ROWS, sizes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of heavy groups or None when there are none)."""
    heavy = heavy_groups(df, keys, limit, sizes)
    if heavy is None:
        return df, None
    same = _same(df, heavy, keys)
    return df.join(heavy, same, "left_anti"), df.join(heavy, same, "left_semi")


def cut_slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_slice``: contiguous in (keys, order), about equal in rows whatever the skew.

    The rows are written once, so that every later reader sees the same slices even if the
    sampled range bounds would come out differently in a second evaluation.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys, *order)
    return materialize(ranged.withColumn("_slice", F.spark_partition_id()))


def _join_slice_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "_slice"]
    # at most (heavy groups + slices) rows
    renamed = lookup(totals.select(*[F.col(c).alias(f"_r_{c}") for c in columns], "_earlier"))
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return rows.join(renamed, condition, "left").drop(*[f"_r_{c}" for c in columns])


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    how: str = "sum",
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` over sliced rows, current row included."""
    fold = {"sum": F.sum, "max": F.max}[how]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(*_UP_TO_HERE)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*_BEFORE_HERE)
    rows = rows.withColumn("_value", value)
    totals = (
        rows.groupBy(*keys, "_slice")
        .agg(fold("_value").alias("_total"))
        .withColumn("_earlier", fold("_total").over(earlier))
    )
    local = rows.withColumn("_local", fold("_value").over(inside))
    joined = _join_slice_totals(local, totals, keys)
    if how == "sum":
        combined = F.coalesce("_local", F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    else:
        combined = F.greatest("_local", "_earlier")
    return joined.withColumn(out, combined).drop("_value", "_local", "_earlier")


def previous(
    rows: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Value of the row before, over sliced rows; null on the first row of a group."""
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_slice")
    totals = (
        rows.groupBy(*keys, "_slice")
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
        .withColumn("_earlier", F.lag("_last").over(earlier))
    )
    local = rows.withColumn("_local", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    joined = _join_slice_totals(local, totals, keys)
    return joined.withColumn(
        out, F.when(F.col("_first"), F.col("_earlier")).otherwise(F.col("_local"))
    ).drop("_local", "_first", "_earlier")


def per_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ordinary: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame], DataFrame],
    limit: int = HEAVY_GROUP_ROWS,
) -> DataFrame:
    """``ordinary`` over the groups one task can hold, ``sliced`` over the others."""
    light, heavy = split_heavy(df, keys, limit)
    result = ordinary(light)
    if heavy is None:
        return result
    return result.unionByName(sliced(cut_slices(heavy, keys, order)).drop("_slice"))


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers all rows 0, 1, 2, … in ``order`` without bringing them into one task.

    ``order`` must identify a row. Positions inside a range partition come from the sorted
    write; only one row count per partition is added up.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = materialize(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(*_BEFORE_HERE)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + position)
        .drop("_part", "_offset", "_at")
    )
