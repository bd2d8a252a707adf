"""S6 to S8 on stored tables: a change rewrites the key buckets it touches and no others.

``<path>/bucket=<k>`` holds the rows whose keys hash to ``k``. A change of a few keys reads and writes
the buckets of these keys; the files of all other buckets stay as they are. A bucket is replaced as a
whole, and every change says what a row is afterwards, so a change that failed half way is repeated.
The next state of the touched buckets is written apart before it replaces the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetmill.session import remove_folder, scratch_path
from fleetmill.sources import changes

_BUCKET = "bucket"

#: About so many rows of a bucket: a few seconds of work for one task.
ROWS_PER_BUCKET = 2_000_000


def buckets_for(rows: int) -> int:
    """How many buckets a table that grows to ``rows`` is created with."""
    return max(1, -(-rows // ROWS_PER_BUCKET))


@dataclass(frozen=True)
class KeyedStore:
    """A stored table with unique keys. ``buckets`` stays what it was when the table was created."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int
    schema: StructType

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def create(self, rows: DataFrame) -> KeyedStore:
        """Writes the first state to a new folder."""
        self._partitioned(rows).write.partitionBy(_BUCKET).parquet(self.path)
        return self

    def load(self) -> DataFrame:
        """The table as it is."""
        return self._stored().select(*self.schema.names)

    def upsert(self, given: DataFrame) -> int:
        """Rows of ``given`` replace rows with the same key, the others are added."""
        return self._change(given, lambda old, new: changes.upsert_by_key(old, new, [*self.key]))

    def update(self, given: DataFrame, columns: list[str]) -> int:
        """Sets ``columns`` on rows that are there; a change to null is a change."""
        return self._change(
            given, lambda old, new: changes.update_where(old, new, [*self.key], columns)
        )

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows with these keys."""
        return self._change(keys, lambda old, gone: changes.delete_where(old, gone, [*self.key]))

    def _stored(self) -> DataFrame:
        layout = StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])
        return self.spark.read.schema(layout).parquet(self.path)

    def _partitioned(self, rows: DataFrame) -> DataFrame:
        """One task per bucket, and so one file."""
        return rows.select(*self.schema.names, self._bucket()).repartition(self.buckets, _BUCKET)

    def _change(self, given: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Applies a change and returns the number of buckets it was applied to."""
        # At most as many numbers as there are buckets.
        found = given.select(self._bucket()).distinct().collect()
        touched = sorted(r[_BUCKET] for r in found)
        if not touched:
            return 0
        old = self._stored().where(F.col(_BUCKET).isin(touched)).select(*self.schema.names)
        aside = scratch_path(self.spark, "buckets")
        self._partitioned(apply(old, given)).write.partitionBy(_BUCKET).parquet(aside)
        layout = StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])
        new = self.spark.read.schema(layout).parquet(aside)
        left = {r[_BUCKET] for r in new.select(_BUCKET).distinct().collect()}
        rows = new.repartition(max(len(left), 1), _BUCKET)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(_BUCKET).parquet(self.path)
        for bucket in touched:  # an overwrite leaves alone what it has no rows for
            if bucket not in left:
                remove_folder(self.spark, f"{self.path}/{_BUCKET}={bucket}")
        remove_folder(self.spark, aside)
        return len(touched)
