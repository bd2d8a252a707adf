"""Stored tables: changes equal those of whole tables and leave other buckets' files alone."""

import random
from pathlib import Path

import pytest

from fleetmill.session import shared_folder
from fleetmill.sources import changes
from fleetmill.sources.keyed_store import KeyedStore, buckets_for

ROWS = "id bigint, name string, size int"


def files(path):
    found = {}
    for file in Path(path).glob("bucket=*/*.parquet"):
        found.setdefault(file.parent.name, set()).add((file.name, file.stat().st_mtime_ns))
    return found


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    shared_folder(spark)
    rows = spark.createDataFrame([(k, f"n{k}", k % 7) for k in range(200)], ROWS)
    return KeyedStore(spark, str(tmp_path / "table"), ("id",), 16, rows.schema).create(rows)


@pytest.mark.parametrize("seed", range(3))
def test_changes_equal_those_of_whole_tables(spark, store, seed):
    rng = random.Random(seed)
    for _ in range(2):
        picked = rng.sample(range(400), 5)
        given = spark.createDataFrame([(k, rng.choice(["new", None]), None) for k in picked], ROWS)
        before = store.load().checkpoint()
        store.upsert(given)
        assert rows_of(store.load()) == rows_of(changes.upsert_by_key(before, given, ["id"]))
        before = store.load().checkpoint()
        store.update(given, ["size"])
        assert rows_of(store.load()) == rows_of(changes.update_where(before, given, ["id"], ["size"]))
        before = store.load().checkpoint()
        store.delete(given.select("id"))
        assert rows_of(store.load()) == rows_of(changes.delete_where(before, given, ["id"]))


def test_untouched_buckets_keep_their_files(spark, store):
    before = files(store.path)
    assert store.upsert(spark.createDataFrame([(3, "three", 3), (3000, "far", 1)], ROWS)) <= 2
    after = files(store.path)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2
    assert sum(map(len, after.values())) == len(after)  # a file each
    assert store.update(spark.createDataFrame([], ROWS), ["size"]) == 0
    assert files(store.path) == after


def test_a_bucket_that_loses_all_rows_is_gone(spark, store):
    everything = spark.createDataFrame([(k,) for k in range(199)], "id bigint")
    store.delete(everything)
    assert rows_of(store.load()) == [(199, "n199", 199 % 7)]
    assert len(files(store.path)) == 1
    store.upsert(spark.createDataFrame([(5, None, None)], ROWS))
    assert rows_of(store.load()) == [(199, "n199", 199 % 7), (5, None, None)]


def test_number_of_buckets_follows_the_rows():
    assert buckets_for(0) == 1 and buckets_for(10_000_000_000) == 5_000
