"""The five catalog tables, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmill.schema import TABLES

Catalog = dict[str, DataFrame]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Selects and casts the columns of ``table`` in their declared order."""
    schema = TABLES[table].schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Reads ``<path>/<table>`` Parquet folders with their declared schemas (no inference)."""
    return {
        name: spark.read.schema(spec.schema).parquet(f"{path}/{name}")
        for name, spec in TABLES.items()
    }


def load_catalog_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    ranges: dict[str, tuple[str, str, str, int]] | None = None,
) -> Catalog:
    """Reads the tables of a database.

    ``ranges`` maps a table to (column, lower, upper, partitions): that table is then read by so
    many parallel queries over ranges of the column. Filters and needed columns are pushed into
    the database queries.
    """
    catalog = {}
    for name in TABLES:
        reader = (
            spark.read.format("jdbc")
            .options(url=url, dbtable=name, **properties)
            .option("preferTimestampNTZ", "true")
        )
        if ranges and name in ranges:
            column, lower, upper, partitions = ranges[name]
            reader = reader.options(
                partitionColumn=column,
                lowerBound=lower,
                upperBound=upper,
                numPartitions=str(partitions),
            )
        loaded = reader.load()
        for old, new in (("class", "class_name"), ("start", "start_time"), ("end", "end_time")):
            if name == "pipelines" and old in loaded.columns:
                loaded = loaded.withColumnRenamed(old, new)
        catalog[name] = conform(loaded, name)
    return catalog


def save_catalog(catalog: Catalog, path: str) -> None:
    """Writes each table to a new folder below ``path``; one version of the catalog per path."""
    for name, df in catalog.items():
        conform(df, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Saves a metastore table bucketed and sorted by ``key``.

    Run log, recorded failures and inventory status saved with the same number of buckets by
    ``aws_id`` are joined on it without a shuffle.
    """
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
