"""Where intermediates go."""

from types import SimpleNamespace

import pytest

from fleetmill import session


def fake(setting, master, current=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current, set_to=[])
    context.setCheckpointDir = context.set_to.append
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context
    )


def test_the_named_folder_is_used():
    assert session.shared_folder(fake("s3a://shared/cp", "spark://m:7077")) == "s3a://shared/cp"
    assert session.shared_folder(fake(None, "yarn", "hdfs://cp")) == "hdfs://cp"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_folder(fake(None, "yarn"))


def test_own_folder_in_local_mode():
    local = fake(None, "local[2]")
    assert local.sparkContext.set_to == [] and session.shared_folder(local)
    assert len(local.sparkContext.set_to) == 1


def test_scratch_paths_differ(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_only_needed_columns_of_a_written_table_are_read(spark):
    written = session.materialize(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    plan = written.where("twice > 10").select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan and "GreaterThan(twice,10)" in plan


def test_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    def is_hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    rows = spark.range(10)
    assert is_hinted(session.lookup(rows))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10)
    assert not is_hinted(session.lookup(rows))
