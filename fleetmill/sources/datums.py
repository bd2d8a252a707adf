"""Metric data points to a table partitioned by day, or to the console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_datums(datums: DataFrame, path: str, mode: str = "append") -> None:
    """Writes Parquet below ``<path>/report_date=…``.

    Rows are rebalanced by day: files come out about equal, small days share a task and a large
    one is split over several.
    """
    dated = datums.withColumn("report_date", F.col("ts").cast("date"))
    dated.hint("rebalance", "report_date").write.mode(mode).partitionBy("report_date").parquet(path)


def print_datums(datums: DataFrame, rows: int = 20) -> None:
    """Shows the first rows, for debugging."""
    datums.orderBy("metric", "datum_type").show(rows, truncate=False)
