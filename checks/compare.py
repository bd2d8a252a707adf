"""Runs queries in Spark and their SQL in DuckDB and compares rows and column types.

``python -m checks.compare <sf_dir> [name prefix …]``
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import BASE_TABLES
from checks.queries import ORACLES, QUERIES

SAME_TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "double": {"DOUBLE"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between both results, or None."""
    relation = connection.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(relation.columns):
        return f"columns {columns} and {sorted(relation.columns)}"
    spark_types = dict(df.dtypes)
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    for c in columns:
        if duck_types[c] not in SAME_TYPES[spark_types[c]]:
            return f"type of {c}: {spark_types[c]} and {duck_types[c]}"
    ours = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(repr, r)) for r in relation.project(names).fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first different rows {a} and {b}"
    return None


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            if name in ORACLES:
                found = difference(df, connection, ORACLES[name])
            else:
                found = None if df.count() else "no rows"
            rows = df.count()
        except Exception as error:  # report and go on with the next query
            found, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += found is not None
        took = time.time() - began
        print(f"{name:32} {rows:9} rows {took:6.1f} s  {found or 'same'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
