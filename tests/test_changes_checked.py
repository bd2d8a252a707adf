"""Constraint checks of a change, against the full check of the table afterwards (K1, K3)."""

import random

import pytest
from pyspark.sql import functions as F

from fleetmill.operators import constraints
from fleetmill.sources.due_store import DueStore

RUN = "aws_id string, pipeline_id bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_changes(spark, seed):
    dice = random.Random(seed)
    ids = range(1, 60)
    before = spark.createDataFrame([(i,) for i in ids if dice.random() < 0.8], "id bigint")
    added = spark.createDataFrame(
        [(dice.choice([*range(50, 75), None]),) for _ in range(20)], "id bigint"
    )
    full = constraints.pk_violations(before.unionByName(added), ["id"])
    found = constraints.added_pk_violations(before, added, ["id"])
    assert rows(found.select("id", "row_count")) == rows(full.select("id", "row_count"))

    owners = [r.id for r in before.collect()]
    child = spark.createDataFrame([(f"r{n}", dice.choice(owners)) for n in range(80)], RUN)
    new = spark.createDataFrame(
        [(f"n{n}", dice.choice([*range(1, 70), None])) for n in range(30)], RUN
    )
    deleted = spark.createDataFrame([(i,) for i in owners if dice.random() < 0.3], "id bigint")
    back = deleted.where("id % 2 = 0")
    after = before.join(deleted, "id", "left_anti").unionByName(back)
    full = constraints.orphan_rows(child.unionByName(new), after)
    found = constraints.changed_orphans(child, new, after, deleted)
    assert rows(found.select("aws_id", "pipeline_id")) == rows(full.select("aws_id", "pipeline_id"))


def test_no_change_no_violation(spark):
    table = spark.createDataFrame([(1,), (2,)], "id bigint")
    runs = spark.createDataFrame([("a", 1)], RUN)
    assert constraints.added_pk_violations(table, table.limit(0), ["id"]).isEmpty()
    assert constraints.changed_orphans(runs, runs.limit(0), table, table.limit(0)).isEmpty()


PIPELINES = "id bigint, next_run_time timestamp_ntz, end_time timestamp_ntz, is_active boolean"


def stored(spark, folder, pipelines):
    given = spark.createDataFrame(pipelines, "id bigint, at string, is_active boolean").select(
        "id",
        F.col("at").cast("timestamp_ntz").alias("next_run_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        "is_active",
    )
    return DueStore(spark, str(folder / "pipelines"), given.schema).create(given)


FLEET = [
    (1, "2001-05-30 10:00:00", True),
    (2, "2001-05-31 23:59:59", True),
    (3, "2001-06-01 05:00:00", True),
    (4, "2001-06-03 00:00:00", True),
    (5, "2001-06-09 00:00:00", True),
    (6, None, True),
    (7, "2001-05-30 10:00:00", False),
]
END = "2001-06-01 04:00:00"


def files(folder):
    return {p.parent.name: p for p in (folder / "pipelines").glob("next_run_day=*/*.parquet")}


def test_due_reads_no_later_day(spark, tmp_path):
    store = stored(spark, tmp_path, FLEET)
    for day, path in files(tmp_path).items():
        if day[len("next_run_day=") :] > "2001-06-01":
            path.write_bytes(b"not a table")
    assert rows(store.due(END).select("id")) == [(1,), (2,)]


def test_advance_rewrites_days_it_reaches(spark, tmp_path):
    store = stored(spark, tmp_path, FLEET)
    before = files(tmp_path)
    moved = store.due(END).withColumn(
        "next_run_time",
        F.when(F.col("id") == 1, F.lit("2001-06-03 10:00:00").cast("timestamp_ntz")),
    )
    moved = spark.createDataFrame(moved.collect(), moved.schema)  # of its own, not read from the store
    store.advance(moved, END)
    store.advance(moved, END)  # a repeated call changes nothing
    after = files(tmp_path)
    assert after["next_run_day=2001-06-09"] == before["next_run_day=2001-06-09"]
    assert "next_run_day=2001-05-31" not in after
    assert rows(store.due("2001-06-04 00:00:00").select("id")) == [(1,), (3,), (4,)]
    assert rows(store.load().where("next_run_time IS NULL").select("id")) == [(2,), (6,)]
    assert store.load().count() == len(FLEET)


def test_a_hot_day_has_several_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored(spark, tmp_path, [(i, "2001-06-01 00:00:00", True) for i in range(2000)])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "pipelines").glob("next_run_day=*/*.parquet"))) > 4
