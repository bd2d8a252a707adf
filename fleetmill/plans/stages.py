"""Stages of a job that is repeated after a failure: what a finished stage decided is read back.

A stage's tables are written to ``<work>/<stage>/<table>``, then a marker. Tables without their
marker are not read, and are replaced when the stage runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


def is_done(spark: SparkSession, work: str, stage: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/{stage}/finished/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def finished_once(
    spark: SparkSession, work: str, stage: str, names: list[str], make: Callable[[], Tables]
) -> Tables:
    """The tables ``names`` of ``stage``: made and written the first time, read back afterwards."""
    if not is_done(spark, work, stage):
        made = make()
        for name in names:
            made[name].write.mode("overwrite").parquet(f"{work}/{stage}/{name}")
        spark.range(1).write.mode("overwrite").parquet(f"{work}/{stage}/finished")
    return {name: spark.read.parquet(f"{work}/{stage}/{name}") for name in names}
