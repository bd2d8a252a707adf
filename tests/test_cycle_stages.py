"""A cycle that fails between its stages and is called again."""

from datetime import timedelta

import pytest

from fleetmill.functions.times import as_timestamp as ts
from fleetmill.plans import cycle
from tests.test_jobs import STATUS, T, catalog_of, pipeline, run


@pytest.fixture
def given(spark):
    old = [run(f"old{i}", 1, T - timedelta(days=i + 1)) for i in range(3)]
    catalog = catalog_of(spark, [pipeline(i) for i in (1, 2, 3)], old, counters=[(2, 3, T)])
    outcome = "pipeline_id bigint, ok boolean, log string"
    results = spark.createDataFrame([(1, True, None), (2, False, "boom"), (3, True, None)], outcome)
    name = "sp_2001-06-01T00:00:00Z_1_c1"
    names = spark.createDataFrame([("new1", name)], "aws_id string, pipeline_name string")
    activations = spark.createDataFrame([(name, True)], "pipeline_name string, activated boolean")
    status = [(f"old{i}", "n", None, "FINISHED", None) for i in range(3)]
    status = spark.createDataFrame([*status, ("new1", "n", None, "RUNNING", None)], STATUS)
    return catalog, [results, names, activations, status]


def called(catalog, rest, work=None):
    return cycle.hourly_cycle(catalog, ts(T - timedelta(hours=1)), ts(T), ts(T), "sp_", *rest, work=work)


def content(done):
    tables = {**done.catalog, **{n: getattr(done, n) for n in ("launches", "events", "actions", "unhandled")}}
    return {n: (df.columns, sorted(map(repr, map(tuple, df.collect())))) for n, df in tables.items()}


def refuse(*_, **__):
    raise RuntimeError("lost")


def test_a_repeated_call_goes_on_where_it_failed(spark, given, tmp_path, monkeypatch):
    catalog, rest = given
    plain = content(called(catalog, rest))
    work = str(tmp_path / "cycle")
    nobody = [df.limit(0) for df in rest[:3]] + rest[3:]
    with monkeypatch.context() as patch:
        patch.setattr(cycle, "launch_attempts", refuse)
        with pytest.raises(RuntimeError):
            called(catalog, rest, work)
    with monkeypatch.context() as patch:
        # Launches were decided: no pipeline is due any more in what the second call is given.
        patch.setattr(cycle, "schedule_tick", refuse)
        patch.setattr(cycle, "cleanup_existing", refuse)
        with pytest.raises(RuntimeError):
            called(catalog, rest, work)
    # How the launches went is kept too, though results and inventory are gone now.
    assert content(called(catalog, nobody, work)) == plain
    for name in ("schedule_tick", "apply_dispatch_results", "cleanup_existing"):
        monkeypatch.setattr(cycle, name, refuse)
    assert content(called(catalog, nobody, work)) == plain


def test_a_torn_stage_is_made_again(spark, given, tmp_path):
    catalog, rest = given
    work = tmp_path / "cycle"
    plain = content(called(catalog, rest, str(work)))
    (work / "cycle" / "finished" / "_SUCCESS").unlink()
    for file in (work / "cycle" / "events").rglob("*.parquet"):
        file.unlink()
    assert content(called(catalog, rest, str(work))) == plain
