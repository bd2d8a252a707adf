"""F1 on a stored table: pipelines in folders by the day, week or month of their next run.

A tick reads the folders up to its own day. Those of later days, and that of pipelines without a
next run, are left out when the query is planned; not even their footers are read. A day that holds
very many pipelines has several files; where days hold few, weeks or months make fewer files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from fleetmill.functions.times import as_timestamp
from fleetmill.operators.schedule import due_pipelines
from fleetmill.session import lookup, remove_folder, scratch_path

_DAY = "next_run_day"

# Fixed value: the folder Spark writes rows to that have no partition value.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class DueStore:
    """Pipelines stored by ``next_run_time``; ``id`` is unique.

    ``grain`` is ``day``, ``week``, ``month`` or ``year``. It stays what it was when the table was
    created.
    """

    spark: SparkSession
    path: str
    schema: StructType
    grain: str = "day"

    def create(self, pipelines: DataFrame) -> DueStore:
        """Writes the first state to a new folder."""
        self._by_day(pipelines).write.partitionBy(_DAY).parquet(self.path)
        return self

    def load(self) -> DataFrame:
        """All pipelines as they are."""
        return self._read(self.path).select(*self.schema.names)

    def due(self, tick_end: str | Column) -> DataFrame:
        """the due pipelines, from the folders of days up to that of ``tick_end``."""
        end = as_timestamp(tick_end)
        early = self._read(self.path).where(self._up_to(end)).select(*self.schema.names)
        return due_pipelines(early, end)

    def advance(self, changed: DataFrame, tick_end: str | Column) -> int:
        """Puts due pipelines where they belong after a tick; returns the number of days rewritten.

        ``changed`` has the whole new row of pipelines that were stored up to the day of
        ``tick_end``. The folders up to that day and of the days they move to are written anew,
        others keep their files. A call that failed half way is repeated with the same rows, which
        must then not be read from this store.
        """
        ids = lookup(changed.select("id").distinct())
        # At most one value per folder.
        days = [r[_DAY] for r in changed.select(self._day()).distinct().collect()]
        reached = self._up_to(as_timestamp(tick_end)) | F.col(_DAY).isin([d for d in days if d])
        if None in days:
            reached = reached | F.col(_DAY).isNull()
        old = self._read(self.path).where(reached)
        before = {r[_DAY] for r in old.select(_DAY).distinct().collect()}
        kept = old.select(*self.schema.names).join(ids, "id", "left_anti")
        aside = scratch_path(self.spark, "days")
        rows = kept.unionByName(changed.select(*self.schema.names))
        self._by_day(rows).write.partitionBy(_DAY).parquet(aside)
        new = self._read(aside)
        after = {r[_DAY] for r in new.select(_DAY).distinct().collect()}
        writer = self._by_day(new).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(_DAY).parquet(self.path)
        for day in before - after:  # an overwrite leaves alone what it has no rows for
            remove_folder(self.spark, f"{self.path}/{_DAY}={day or _NO_DAY}")
        remove_folder(self.spark, aside)
        return len(before | after)

    def _day(self) -> Column:
        """The first day of the folder's time."""
        day = F.col("next_run_time").cast("date")
        return (day if self.grain == "day" else F.trunc(day, self.grain)).alias(_DAY)

    def _up_to(self, end: Column) -> Column:
        return F.col(_DAY) <= end.cast("date")

    def _read(self, path: str) -> DataFrame:
        layout = StructType([*self.schema.fields, StructField(_DAY, DateType())])
        return self.spark.read.schema(layout).parquet(path)

    def _by_day(self, rows: DataFrame) -> DataFrame:
        """Ranges of days; a day with much of the table is cut by id."""
        placed = rows.select(*self.schema.names, self._day())
        return placed.repartitionByRange(_DAY, "id").sortWithinPartitions(_DAY, "next_run_time")
