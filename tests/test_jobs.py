"""Scheduling, dispatch, clean-up and the whole cycle on small hand-made tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators import constraints, counts, notifications, retention, schedule, unmanaged
from fleetmill.plans import cleanup, cycle
from fleetmill.plans.schedule_tick import apply_dispatch_results, schedule_tick
from fleetmill.schema import TABLES
from fleetmill.sources import catalog as catalogs
from fleetmill.sources import changes, inventory, run_log

T = datetime(2001, 6, 1)
ts = times.as_timestamp


def catalog_of(spark, pipelines=(), runs=(), failed=(), counters=(), metrics=()):
    rows = dict(zip(TABLES, (pipelines, runs, failed, counters, metrics)))
    # written and read back as nullable: what storage delivers
    return {
        name: spark.createDataFrame(list(rows[name]), spec.schema.simpleString())
        for name, spec in TABLES.items()
    }


def pipeline(i, **given):
    row = dict(
        id=i, name=f"p{i}", jar="a.jar", class_name=f"c{i}", is_active=True, retention=2,
        start_time=datetime(2000, 1, 1), period="1 day", end_time=None,
        next_run_time=datetime(2001, 5, 30), backfill=True, owner=None,
    ) | given
    return tuple(row.values())


def run(aws_id, pipeline_id, start, in_console=True):
    return (aws_id, pipeline_id, "n", start, start, start, "success", in_console)


STATUS = (
    "aws_id string, name string, health_status string, pipeline_state string, creation_time string"
)


def test_tick(spark):
    catalog = catalog_of(
        spark,
        [
            pipeline(1),
            pipeline(2, backfill=False),
            pipeline(3, end_time=datetime(2001, 5, 31)),
            pipeline(4, next_run_time=T),
            pipeline(5, next_run_time=None),
            pipeline(6, is_active=False),
            pipeline(7, end_time=datetime(2001, 5, 30)),
            pipeline(8, period="0 days"),
            pipeline(9, period="1 month", next_run_time=datetime(2001, 1, 31)),
        ],
    )
    locations = spark.createDataFrame([("a.jar", "/cache/a.jar")], "jar string, location string")
    tick = schedule_tick(catalog, ts(T), ts(T), "sp_", jar_locations=locations, finished_at=ts(T))
    rows = {r.pipeline_id: r for r in tick.launches.collect()}
    assert {i: r.times for i, r in rows.items()} == {1: 2, 2: 1, 3: 1, 9: 5}
    assert rows[1].deployment_name == "sp_2001-06-01T00:00:00Z_1_c1"
    assert rows[1].location == "/cache/a.jar" and rows[3].until == datetime(2001, 5, 31)
    assert [r.id for r in tick.rejected.collect()] == [8]
    assert [tuple(r) for r in tick.metrics.collect()] == [(T, 5, T)]
    first = schedule_tick(catalog, ts(T), ts(T), "sp_", max_pipelines=2).launches
    assert {r.pipeline_id for r in first.collect()} == {1, 9}


def test_a_tick_reads_the_pipelines_once(spark, tmp_path):
    # Periods used to be parsed in the scans of whatever the pipeline table is made of.
    stored = catalog_of(spark, [pipeline(1), pipeline(2, period="3 moons"), pipeline(3, next_run_time=T)])
    stored["pipelines"].write.parquet(str(tmp_path / "pipelines"))
    stored["pipelines"] = spark.read.parquet(str(tmp_path / "pipelines"))
    tick = schedule_tick(stored, ts(T), ts(T), "sp_", max_pipelines=None)
    for made in (tick.launches, tick.rejected, tick.metrics):
        assert not set(made.inputFiles()) & set(stored["pipelines"].inputFiles())
    assert [r.pipeline_id for r in tick.launches.collect()] == [1]
    assert [r.id for r in tick.rejected.collect()] == [2]


def test_due_filter_reaches_the_scan(spark, tmp_path):
    catalogs.save_catalog(catalog_of(spark, [pipeline(1)]), str(tmp_path / "c"))
    stored = catalogs.load_catalog(spark, str(tmp_path / "c"))["pipelines"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = schedule.due_pipelines(stored, ts(T)).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(next_run_time" in text and "EqualTo(is_active,true)" in text
    assert "jar" not in text.split("ReadSchema")[1]


ATTEMPTS = "pipeline_id bigint, attempt_id bigint, ok boolean, log string"


def test_dispatch_results(spark):
    counters = [(2, 2, T), (3, 3, T), (4, 1, T), (6, 3, T)]
    ended = pipeline(5, end_time=datetime(2001, 5, 31))
    catalog = catalog_of(
        spark, [pipeline(i) for i in (1, 2, 3, 4, 6)] + [ended], counters=counters
    )
    attempts = spark.createDataFrame(
        [(1, 1, True, ""), (2, 2, False, "x"), (3, 3, False, "y"), (4, 4, True, ""),
         (5, 5, True, ""), (1, 9, False, "late"), (99, 10, True, ""),
         (None, 11, False, "")],
        ATTEMPTS,
    )
    new_runs = spark.createDataFrame(
        [run("df-1", 1, T), run("df-2", 2, T)], catalog["scheduled_pipelines"].schema
    )
    done = apply_dispatch_results(catalog, attempts, new_runs, ts(T), ts(T))
    after = {r.id: r for r in done.catalog["pipelines"].collect()}
    still = datetime(2001, 5, 30)
    assert {i: after[i].next_run_time for i in after} == {
        1: T, 2: still, 3: still, 4: T, 5: T, 6: still,
    }
    assert [i for i in after if not after[i].is_active] == [3]
    left = {r.pipeline_id: r.failure_count for r in
            done.catalog["schedule_failure_counters"].collect()}
    assert left == {1: 1, 2: 3, 3: 3, 6: 3}
    assert [r.aws_id for r in done.catalog["scheduled_pipelines"].collect()] == ["df-1"]
    events = {r.pipeline_id: (r.event, r.failure_number) for r in done.events.collect()}
    assert events == {
        1: ("failed_to_schedule", 1), 2: ("failed_to_schedule", 3), 3: ("deactivated", 4),
    }
    assert {r.attempt_id for r in done.rejected.collect()} == {10, 11}


def test_dispatch_equals_attempts_one_by_one(spark):
    """Many attempts a pipeline, two thirds of them failures, some without a result."""
    rng = random.Random(11)
    before = T - timedelta(days=9)
    recorded = {i: rng.randint(1, 4) for i in range(1, 20, 2)}
    catalog = catalog_of(
        spark,
        [pipeline(i) for i in range(1, 21)],
        counters=[(i, n, before) for i, n in recorded.items()],
    )
    rows = [(rng.choice([1, rng.randint(1, 24)]), a, rng.choice([True, False, None]), f"log {a}")
            for a in range(90)]
    counters = {i: (n, before) for i, n in recorded.items()}
    inactive, moved, told = set(), set(), []
    for i, a, ok, log in rows:
        if i > 20:
            continue
        if ok:
            counters.pop(i, None)
            moved.add(i)
            continue
        n = counters[i][0] if i in counters else 0
        told.append((i, "failed_to_schedule" if n < 3 else "deactivated", min(n + 1, 4), log))
        if n < 3:
            counters[i] = (n + 1, T)
        else:
            inactive.add(i)
    attempts = spark.createDataFrame(rows, ATTEMPTS).repartition(5)
    new_runs = spark.createDataFrame(
        [run(f"df-{i}", i, T) for i in range(1, 25)], catalog["scheduled_pipelines"].schema
    )
    done = apply_dispatch_results(catalog, attempts, new_runs, ts(T), ts(T))
    after = done.catalog["pipelines"].collect()
    assert {r.id for r in after if not r.is_active} == inactive
    assert {r.id for r in after if r.next_run_time == T} == moved
    left = done.catalog["schedule_failure_counters"].collect()
    assert {r.pipeline_id: (r.failure_count, r.updated_at) for r in left} == counters
    assert sorted(map(tuple, done.events.collect())) == sorted(told)
    kept = done.catalog["scheduled_pipelines"].collect()
    assert {r.pipeline_id for r in kept} == moved
    assert {r.attempt_id for r in done.rejected.collect()} == {a for i, a, _, _ in rows if i > 20}


def test_cleanup_quarantines_what_it_cannot_judge(spark):
    day = [T - timedelta(days=i) for i in range(6)]
    runs = [run(f"h{i}", 1, day[i]) for i in range(4)] + [run("h3b", 1, day[3])]
    runs += [run(f"e{i}", 1, day[i]) for i in range(4)]
    runs += [run("gone", 1, day[0]), run("hidden", 1, day[5], False), run("orphan", 9, day[0])]
    runs += [run("busy", 1, day[5]), run("x", 2, day[0])]
    catalog = catalog_of(
        spark, [pipeline(1), pipeline(2, retention=None)], runs, failed=[("e0", 1, True, T)]
    )
    listed = [(r[0], "n", "ERROR" if r[0][0] == "e" else None,
               "RUNNING" if r[0] == "busy" else "FINISHED", None) for r in runs if r[0] != "gone"]
    status = spark.createDataFrame(listed, STATUS)
    done = cleanup.cleanup_existing(catalog, status, ts(T))
    assert {r.aws_id: r.action for r in done.actions.collect()} == {
        "h2": "delete_healthy", "h3": "delete_healthy", "h3b": "delete_healthy",
        "e2": "delete_failed", "e3": "delete_failed", "e1": "record_failure",
        "gone": "mark_not_in_console",
    }
    assert {r.aws_id for r in done.quarantined.collect()} == {"orphan", "x"}
    left = {r.aws_id for r in done.catalog["scheduled_pipelines"].collect() if r.in_console}
    assert left == {"h0", "h1", "e0", "e1", "busy", "orphan", "x"}
    assert {r.aws_id: r.resolved for r in done.catalog["failed_pipelines"].collect()} == {
        "e0": True, "e1": False,
    }
    assert retention.deleted_count(done.actions).first().pipeline_deleted == 3


UNMANAGED_CASES = [
    ("own_old", "sp_1", "FINISHED", "1999-01-01T00:00:00"),
    ("dev_old", "dev_1", "FINISHED", "1999-01-01T00:00:00"),
    ("adhoc_old", "adhoc", "FINISHED", "1999-01-01T00:00:00"),
    ("adhoc_edge", "adhoc", "FINISHED", "1999-06-15T00:00:00"),
    ("adhoc_running", "adhoc", "RUNNING", "1999-01-01T00:00:00"),
    ("no_state", "adhoc", None, "1999-01-01T00:00:00"),
    ("no_time", "adhoc", "FINISHED", None),
    ("bad_time", "adhoc", "FINISHED", "yesterday"),
]


@pytest.mark.parametrize(
    "prefixes, force, expected",
    [
        (["sp_", "dev_"], False, {"adhoc_old"}),
        (["sp_", "dev_"], True, {"adhoc_old", "own_old"}),
        ([], False, {"adhoc_old", "own_old", "dev_old"}),
        (["a", "dev"], True, {"own_old"}),
    ],
)
def test_deletable_unmanaged(spark, zone, prefixes, force, expected):
    status = spark.createDataFrame(
        [(i, n, None, s, c) for i, n, s, c in UNMANAGED_CASES], STATUS
    )
    found = unmanaged.deletable_unmanaged(
        status, prefixes, ts("1999-06-15 12:00:00"), "sp_", force=force
    )
    assert {r.aws_id for r in found.collect()} == expected


def test_default_cutoff(spark):
    row = spark.range(1).select(
        unmanaged.default_cutoff(ts("2001-04-30 13:00:00")).alias("a"),
        unmanaged.default_cutoff(ts("2001-01-15 00:00:00")).alias("b"),
    ).first()
    assert (row.a, row.b) == (datetime(2001, 2, 28), datetime(2000, 11, 15))


@pytest.mark.parametrize("options", [{"exclude_prefixes": [" "]}, {"state": "PROMOTED"}])
def test_invalid_unmanaged_options(spark, options):
    status = spark.createDataFrame([], STATUS)
    given = {"exclude_prefixes": [], "cutoff": ts(T), "own_prefix": "sp_"} | options
    with pytest.raises(ValueError):
        unmanaged.deletable_unmanaged(status, **given)


def test_unmanaged_cleanup_respects_managed_runs_unless_forced(spark):
    status = spark.createDataFrame(
        [(i, "adhoc", None, "FINISHED", "1999-01-01T00:00:00") for i in "abc"], STATUS
    )
    listed = spark.createDataFrame([("a",), ("b",)], "aws_id string")
    runs = catalog_of(spark, runs=[run("a", 1, T), run("b", 1, T, False)])["scheduled_pipelines"]

    def clean(**options):
        return cleanup.cleanup_unmanaged(listed, status, runs, [], ts(T), "sp_", **options)

    assert {r.aws_id for r in clean().ids.collect()} == {"b"}
    forced = clean(force=True)
    assert {r.aws_id for r in forced.ids.collect()} == {"a", "b"}
    assert forced.affected.first().updated_runs == 1
    assert not any(r.in_console for r in forced.runs.collect())
    dry = clean(force=True, dry_run=True)
    assert dry.affected.first().updated_runs == 1
    assert {r.aws_id for r in dry.runs.collect() if r.in_console} == {"a"}


def test_states(spark):
    status = spark.createDataFrame(
        [("a", "n", None, "FINISHED", None), ("b", "n", None, "PROMOTED", None),
         ("c", "n", None, None, None)],
        STATUS,
    )
    valid, rejected = inventory.validate_state(status)
    assert {r.aws_id for r in valid.collect()} == {"a", "c"}
    assert {r.aws_id for r in rejected.collect()} == {"b"}
    with pytest.raises(PySparkException, match="PROMOTED"):
        inventory.validate_state(status, strict=True)[0].collect()


def test_changes(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, v string, w int")
    given = spark.createDataFrame([(1, None), (9, "z")], "k int, v string")
    updated = changes.update_where(table, given, ["k"], ["v"])
    assert sorted(map(tuple, updated.collect())) == [(1, None, 1), (2, "b", 2), (3, "c", 3)]
    assert changes.updated_count(table, given, ["k"]).first().updated_rows == 1
    upserted = changes.upsert_by_key(table, given.withColumn("w", F.lit(0)), ["k"])
    assert {r.k: (r.v, r.w) for r in upserted.collect()} == {
        1: (None, 0), 2: ("b", 2), 3: ("c", 3), 9: ("z", 0),
    }
    assert {r.k for r in changes.delete_where(table, given, ["k"]).collect()} == {2, 3}


def test_ids_continue_after_the_largest(spark):
    existing = spark.createDataFrame([(5,), (3,)], "id bigint")
    new = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    found = constraints.assign_ids(existing, new, ["name"]).collect()
    assert {r["name"]: r.id for r in found} == {"a": 6, "b": 7, "c": 8}
    empty = spark.createDataFrame([], "id bigint")
    assert {r.id for r in constraints.assign_ids(empty, new, ["name"]).collect()} == {1, 2, 3}


def test_owners(spark):
    owners = {
        None: "email", "a@b": "email", "a.b+c@d-e.org": "email", "a@b.": "invalid", "@b": "invalid",
        "a b@c": "invalid", "a@b\n": "invalid", "o’neil@x.org": "email",
        "arn:aws:sns:us-east-1:123:topic_a-1": "sns", "arn:aws:sns:*:*:t": "sns",
        "arn:aws:sns:us-east-1:12a:t": "invalid", "arn:aws:sqs:us-east-1:1:t": "invalid",
    }
    df = spark.createDataFrame(list(enumerate(owners)), "i int, owner string")
    medium, recipients = notifications.route(F.col("owner"), ["x@y", "z@y"])
    for r in df.select("owner", medium.alias("m"), recipients.alias("to")).collect():
        assert r.m == owners[r.owner], r.owner
        assert r.to == (None if r.m == "invalid" else r.owner or "x@y,z@y")


def test_chat_payload_leaves_out_what_is_not_given(spark):
    df = spark.createDataFrame([('say "hi"',)], "message string")
    row = notifications.chat_payloads(df, ["by me"], None, "#c").first()
    assert row.payload == '{"channel":"#c","text":"say \\"hi\\"\\nby me"}'


def test_fleet_counts_of_empty_tables(spark):
    ids = spark.createDataFrame([], "aws_id string")
    assert tuple(counts.fleet_counts(catalog_of(spark), ids, ts(T)).first()) == (0, 0, 0, 0)


def test_hourly_cycle(spark):
    """Pipeline 1 is launched, 2 fails to launch, 3 has no inventory entry; old runs go."""
    old = [run(f"old{i}", 1, T - timedelta(days=i + 1)) for i in range(3)]
    catalog = catalog_of(
        spark, [pipeline(i) for i in (1, 2, 3)] + [pipeline(4, next_run_time=None)], old,
        counters=[(2, 3, T)],
    )
    results = spark.createDataFrame([(1, True, None), (2, False, "boom"), (3, True, None)],
                                    "pipeline_id bigint, ok boolean, log string")
    name = "sp_2001-06-01T00:00:00Z_{0}_c{0}"
    names = spark.createDataFrame([("new1", name.format(1)), ("new2", name.format(2))],
                                  "aws_id string, pipeline_name string")
    activations = spark.createDataFrame([(name.format(1), False)],
                                        "pipeline_name string, activated boolean")
    status = spark.createDataFrame(
        [(f"old{i}", "n", None, "FINISHED", None) for i in range(3)]
        + [("new1", "n", None, "RUNNING", None)],
        STATUS,
    )
    done = cycle.hourly_cycle(
        catalog, ts(T - timedelta(hours=1)), ts(T), ts(T), "sp_", results, names, activations,
        status,
    )
    assert {r.pipeline_id: r.times for r in done.launches.collect()} == {1: 2, 2: 2, 3: 2}
    events = {r.pipeline_id: (r.event, r.log) for r in done.events.collect()}
    assert events[2] == ("deactivated", "boom")
    assert events[3] == ("failed_to_schedule", f"pipeline with name {name.format(3)} not found")
    after = {r.id: r for r in done.catalog["pipelines"].collect()}
    assert after[1].next_run_time == T and not after[2].is_active
    runs = {r.aws_id: r for r in done.catalog["scheduled_pipelines"].collect()}
    assert runs["new1"].status == "fail" and runs["new1"].in_console
    assert {a for a, r in runs.items() if not r.in_console} == {"old2"}
    assert {r.aws_id: r.action for r in done.actions.collect()} == {"old2": "delete_healthy"}
    counters = {r.pipeline_id: r.failure_count for r in
                done.catalog["schedule_failure_counters"].collect()}
    assert counters == {2: 3, 3: 1}
    assert done.catalog["scheduler_metrics"].first().pipeline_count == 3


def test_bucketed_tables_join_without_a_shuffle(spark):
    n = 400
    rows = [run(f"df-{i}", i % 7, T) for i in range(n)]
    runs = catalog_of(spark, runs=rows)["scheduled_pipelines"]
    status = spark.createDataFrame(
        [(f"df-{i}", "n", None, "FINISHED", None) for i in range(0, n, 2)], STATUS
    )
    tables = {"bucketed_runs": runs, "bucketed_status": status}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for name, df in tables.items():
            catalogs.save_bucketed(df, name, "aws_id", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = retention.runs_with_status(*[spark.table(name) for name in tables])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.where("in_inventory").count() == n // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_run_log_rewrites_live_runs_only(spark, tmp_path):
    path = str(tmp_path / "log")
    first = [run(f"df-{i}", 1, T, i % 2 == 0) for i in range(6)]
    schema = catalog_of(spark)["scheduled_pipelines"].schema
    run_log.save_tick(spark.createDataFrame(first, schema), path, "2001-06-01")
    before = run_log.load_runs(spark, path, "2001-06-01")
    assert sorted(map(tuple, before.collect())) == sorted(first)

    live = retention.in_console_runs(before)
    assert live.inputFiles() and all("/live/" in file for file in live.inputFiles())
    now = live.withColumn("in_console", F.col("aws_id") != "df-2").unionByName(
        spark.createDataFrame([run("df-9", 1, T)], schema)
    )
    for _ in range(2):  # a repeated tick changes nothing
        run_log.save_tick(now, path, "2001-06-02")
    second = run_log.load_runs(spark, path, "2001-06-02")
    assert {r.aws_id: r.in_console for r in second.collect()} == {"df-0": True, "df-1": False, "df-2": False, "df-3": False, "df-4": True,
                     "df-5": False, "df-9": True}
    assert second.count() == 7
    again = run_log.load_runs(spark, path, "2001-06-01")
    assert sorted(map(tuple, again.collect())) == sorted(first)
    with pytest.raises(ValueError):
        run_log.save_tick(now, path, "01:00")
