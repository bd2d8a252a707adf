"""The stored run log: commits, folded months, expired states."""

import datetime
import shutil

import pytest

from fleetmill.schema import SCHEDULED_PIPELINES
from fleetmill.sources import run_log

T = datetime.datetime(2001, 1, 1)


def runs(spark, live, gone=()):
    rows = [(f"df-{i}", i, "n", T, T, T, "success", i not in gone) for i in live]
    return spark.createDataFrame(rows, SCHEDULED_PIPELINES)


def state(spark, path, tick):
    rows = run_log.load_runs(spark, path, tick).collect()
    assert len(rows) == len({r.aws_id for r in rows})
    return {r.pipeline_id for r in rows if r.in_console}, {
        r.pipeline_id for r in rows if not r.in_console
    }


@pytest.fixture
def log(spark, tmp_path):
    """Tick n starts run n; the run of two ticks before leaves."""
    path = str(tmp_path / "log")
    ticks = [f"2001-{m:02}-{d:02}" for m in (1, 2) for d in (1, 2, 3)] + ["2001-03-01"]
    for n, tick in enumerate(ticks):
        live = range(max(n - 2, 0), n + 1)
        run_log.save_tick(runs(spark, live, {n - 2}), path, tick)
    return path, ticks


def expected(n):
    return {i for i in (n - 1, n) if i >= 0}, set(range(max(n - 1, 0)))


def files(tmp_path, part):
    return sorted(p.parent.name for p in (tmp_path / "log" / part).rglob("*.parquet"))


def test_states_stay_the_same_through_folds_and_expiry(spark, log, tmp_path):
    path, ticks = log
    assert [state(spark, path, t) for t in ticks] == [expected(n) for n in range(7)]
    assert [run_log.fold_month(spark, path, f"2001-0{m}") for m in (1, 1, 2)] == [3, 0, 3]
    # The end of a folded month can be read, what lies within it cannot.
    assert state(spark, path, ticks[2]) == expected(2)
    with pytest.raises(ValueError, match="within"):
        run_log.load_runs(spark, path, ticks[1])
    run_log.expire(spark, path, keep=2)
    assert [state(spark, path, t) for t in ticks[5:]] == [expected(5), expected(6)]
    with pytest.raises(ValueError, match="no such state"):
        run_log.load_runs(spark, path, ticks[2])
    # Files follow months and kept states, not ticks.
    assert files(tmp_path, "closed") == ["month=2001-01", "month=2001-02"]
    assert set(files(tmp_path, "left")) == {"tick=2001-03-01"}
    assert set(files(tmp_path, "live")) == {"tick=2001-02-03", "tick=2001-03-01"}
    run_log.expire(spark, path, keep=2)
    assert state(spark, path, ticks[6]) == expected(6)
    run_log.save_tick(runs(spark, [5, 6, 7], {5}), path, "2001-03-02")
    assert state(spark, path, "2001-03-02") == expected(7)


def test_a_torn_tick_is_not_read_and_can_be_repeated(spark, log, tmp_path):
    path, ticks = log
    run_log.save_tick(runs(spark, [5, 6, 7], {5}), path, "2001-03-02")
    # As if the tick had ended before its commit: with all of its files, and with a part of them.
    shutil.rmtree(tmp_path / "log" / "ticks" / "tick=2001-03-02")
    assert run_log.committed_ticks(spark, path) == ticks
    assert state(spark, path, "2001-03-01") == expected(6)
    with pytest.raises(ValueError, match="no such state"):
        run_log.load_runs(spark, path, "2001-03-02")
    shutil.rmtree(tmp_path / "log" / "live" / "tick=2001-03-02")
    run_log.expire(spark, path, keep=9)  # may be a tick that is being written
    assert "tick=2001-03-02" in files(tmp_path, "left")
    # The next tick takes up what was lost; the torn one stays unread and then goes.
    run_log.save_tick(runs(spark, [5, 6, 7], {5}), path, "2001-03-03")
    assert state(spark, path, "2001-03-03") == expected(7)
    run_log.expire(spark, path, keep=9)
    assert "tick=2001-03-02" not in files(tmp_path, "left")
    assert state(spark, path, "2001-03-03") == expected(7)


def test_a_torn_fold_is_not_read_and_can_be_repeated(spark, log, tmp_path):
    path, ticks = log
    run_log.fold_month(spark, path, "2001-01")
    shutil.rmtree(tmp_path / "log" / "folds" / "month=2001-01")
    run_log.expire(spark, path, keep=1)
    assert state(spark, path, ticks[6]) == expected(6)
    assert run_log.fold_month(spark, path, "2001-01") == 3
    run_log.expire(spark, path, keep=1)
    assert state(spark, path, ticks[6]) == expected(6)


def test_what_is_refused(spark, log):
    path, _ = log
    with pytest.raises(ValueError, match="not over"):
        run_log.fold_month(spark, path, "2001-03")
    assert run_log.fold_month(spark, path, "1999-01") == 0
    run_log.fold_month(spark, path, "2001-01")
    with pytest.raises(ValueError, match="folded"):
        run_log.save_tick(runs(spark, [0]), path, "2001-01-02")
    with pytest.raises(ValueError, match="always kept"):
        run_log.expire(spark, path, keep=0)
