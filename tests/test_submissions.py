"""C6 to C8 and J10 against requests applied one after the other."""

import random
from datetime import datetime

import pytest

from fleetmill.functions import times
from fleetmill.operators import submissions as ops
from fleetmill.plans.submissions import apply_submissions

NOW = datetime(2001, 6, 1)
START = datetime(2001, 1, 31)
NEXT = datetime(2001, 6, 28)

REQUESTS = (
    "request_id bigint, pipeline_object string, jar string, start_now boolean, "
    "do_update boolean, update_jar_only boolean, no_backfill boolean, enable_flag boolean, "
    "disable_flag boolean, owner string, schedule timestamp_ntz, frequency string, dry_run boolean"
)
PIPELINES = (
    "id bigint, name string, jar string, class_name string, is_active boolean, retention int, "
    "start_time timestamp_ntz, period string, end_time timestamp_ntz, "
    "next_run_time timestamp_ntz, backfill boolean, owner string"
)
NAMES = [c.split()[0] for c in REQUESTS.split(", ")]


def request(i, obj, **given):
    base = dict(
        request_id=i, pipeline_object=obj, jar=f"v{i}.jar", start_now=False, do_update=False,
        update_jar_only=False, no_backfill=False, enable_flag=False, disable_flag=False,
        owner="o@example.com", schedule=START, frequency="1 month", dry_run=False,
    )
    return base | given


def pipeline(i, name, cls=None, **given):
    base = dict(
        id=i, name=name, jar="old.jar", class_name=cls or name, is_active=True, retention=7,
        start_time=datetime(2000, 1, 1), period="1 day", end_time=datetime(2002, 1, 1),
        next_run_time=datetime(2001, 5, 1), backfill=True, owner="a@example.com",
    )
    return base | given


def run(spark, requests, pipelines, *limits):
    submitted = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in requests], REQUESTS)
    fields = [c.split()[0] for c in PIPELINES.split(", ")]
    table = spark.createDataFrame([tuple(p[f] for f in fields) for p in pipelines], PIPELINES)
    none = spark.createDataFrame(
        [], "pipeline_object string, start_time timestamp_ntz, period string"
    )
    resolved = ops.resolve_schedules(submitted, none, times.as_timestamp(NOW))
    done = apply_submissions(resolved, table, *limits)
    outcomes = {r.request_id: r.outcome for r in done.outcomes.collect()}
    after = {r.id: r.asDict() for r in sorted(done.pipelines.collect())}
    return outcomes, after, done


def one_by_one(requests, pipelines):
    table = [dict(p) for p in pipelines]
    last = max([p["id"] for p in table], default=0)
    outcomes = {}

    def refuse(r, why):
        outcomes[r["request_id"]] = why

    for r in sorted(requests, key=lambda r: r["request_id"]):
        obj, owner, live = r["pipeline_object"], r["owner"], not r["dry_run"]
        hits = [p for p in table if obj in (p["name"], p["class_name"])]
        if r["enable_flag"] and r["disable_flag"]:
            refuse(r, "enable_and_disable")
        elif owner is not None and "@" not in owner:
            refuse(r, "owner_invalid")
        elif r["schedule"] is None:
            refuse(r, "no_schedule")
        elif r["do_update"]:
            if owner is None:
                refuse(r, "owner_required_update")
            elif not hits:
                refuse(r, "missing")
            else:
                outcomes[r["request_id"]] = "updated"
                for p in hits if live else []:
                    p.update(
                        name=obj, jar=r["jar"], is_active=not r["disable_flag"], retention=2,
                        period=r["frequency"], end_time=None, next_run_time=NEXT, owner=owner,
                        backfill=not r["no_backfill"],
                    )
        elif r["update_jar_only"]:
            if not hits:
                refuse(r, "missing")
            else:
                outcomes[r["request_id"]] = "jar_updated"
                for p in hits if live else []:
                    p["jar"] = r["jar"]
        elif r["enable_flag"] or r["disable_flag"]:
            if not hits:
                refuse(r, "missing")
            else:
                outcomes[r["request_id"]] = "enabled" if r["enable_flag"] else "disabled"
                for p in hits if live else []:
                    p["is_active"] = r["enable_flag"]
        elif hits:
            refuse(r, "exists")
        elif owner is None:
            refuse(r, "owner_required_insert")
        else:
            outcomes[r["request_id"]] = "inserted"
            if live:
                last += 1
                table.append(
                    pipeline(
                        last, obj, jar=r["jar"], retention=2, start_time=r["schedule"],
                        period=r["frequency"], end_time=None, next_run_time=NEXT,
                        backfill=not r["no_backfill"], owner=owner,
                    )
                )
    return outcomes, {p["id"]: p for p in table}


def test_random_batches_equal_one_by_one(spark):
    rng = random.Random(4)
    pipelines = [pipeline(i, f"n{i}") for i in range(1, 8)]
    pipelines += [pipeline(8, "shared", "c8"), pipeline(9, "shared", "c9")]
    objects = [f"n{i}" for i in range(1, 20)] + ["shared"]
    requests = []
    for i in range(1, 400):
        kind = rng.choice(["do_update", "update_jar_only", "enable_flag", "disable_flag", None])
        given = {kind: True} if kind else {}
        if rng.random() < 0.1:
            given |= {"enable_flag": True, "disable_flag": rng.random() < 0.5}
        given["owner"] = rng.choice(["o@example.com", "p@example.com", None, "nobody"])
        given["dry_run"] = rng.random() < 0.2
        given["no_backfill"] = rng.random() < 0.5
        if rng.random() < 0.05:
            given["schedule"] = None
        requests.append(request(i, rng.choice(objects), **given))
    outcomes, after, _ = run(spark, requests, pipelines)
    expected_outcomes, expected = one_by_one(requests, pipelines)
    assert outcomes == expected_outcomes
    assert after == expected


def random_requests(rng, objects, n):
    requests = []
    for i in range(1, n):
        kind = rng.choice(["do_update", "update_jar_only", "enable_flag", "disable_flag", None])
        given = {kind: True} if kind else {}
        if kind == "do_update" and rng.random() < 0.7:
            given = {"update_jar_only": True}  # renames come late, so that both ways are taken
        given["owner"] = rng.choice(["o@example.com", "p@example.com", None, "nobody"])
        given["dry_run"] = rng.random() < 0.2
        requests.append(request(i, rng.choice(objects), **given))
    return requests


@pytest.mark.parametrize("seed, heavy_rows", [(1, 10**6), (2, 10**6), (3, 5), (4, 1)])
def test_names_and_classes_in_one_batch_equal_one_by_one(spark, seed, heavy_rows):
    """Shared classes and names, names that are other pipelines' classes, inserts after renames.

    With a small row limit the requests for a name are cut into slices.
    """
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    pipelines = [pipeline(i, rng.choice(words), rng.choice(words)) for i in range(1, 16)]
    requests = random_requests(rng, words + ["x1", "x2", "x3"], 160)
    requests += [request(200 + i, words[0], update_jar_only=True) for i in range(80)]
    expected_outcomes, expected = one_by_one(requests, pipelines)
    outcomes, after, _ = run(spark, requests, pipelines, heavy_rows)
    assert outcomes == expected_outcomes
    assert after == expected


def test_name_and_class_are_both_served(spark):
    pipelines = [pipeline(1, "n", "c"), pipeline(2, "z", "c"), pipeline(3, "other")]
    requests = [
        request(1, "n", update_jar_only=True),
        request(2, "c", do_update=True, dry_run=True),
        request(3, "c", update_jar_only=True),
        request(4, "z", disable_flag=True),
        request(5, "c", do_update=True),
        request(6, "n", update_jar_only=True),
        request(7, "n"),
        request(8, "n", disable_flag=True),
    ]
    outcomes, after, _ = run(spark, requests, pipelines)
    assert outcomes == {
        1: "jar_updated", 2: "updated", 3: "jar_updated", 4: "disabled", 5: "updated",
        6: "missing", 7: "inserted", 8: "disabled",
    }
    assert [(after[i]["name"], after[i]["jar"]) for i in after] == [
        ("c", "v5.jar"), ("c", "v5.jar"), ("other", "old.jar"), ("n", "v7.jar")
    ]
    assert [after[i]["is_active"] for i in after] == [True, True, True, False]


def test_insert_then_change_in_one_batch(spark):
    requests = [
        request(1, "new", enable_flag=True),
        request(2, "new"),
        request(3, "new"),
        request(4, "new", update_jar_only=True),
        request(5, "new", disable_flag=True),
        request(6, "dry", dry_run=True),
        request(7, "dry", dry_run=True),
    ]
    outcomes, after, _ = run(spark, requests, [pipeline(41, "old")])
    assert outcomes == {
        1: "missing", 2: "inserted", 3: "exists", 4: "jar_updated", 5: "disabled",
        6: "inserted", 7: "inserted",
    }
    assert set(after) == {41, 42}
    assert (after[42]["name"], after[42]["jar"], after[42]["is_active"]) == ("new", "v4.jar", False)


def test_matches_are_counted_per_pipeline(spark):
    fields = "id bigint, name string, class_name string"
    table = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "c", "a")], fields)
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x")],
                                  "request_id bigint, pipeline_object string")
    found = ops.match_by_name_or_class(asked, table).collect()
    assert {r.request_id: r.match_count for r in found} == {1: 3, 2: 1, 3: 0}


def test_schedule_sources(spark):
    requests = [
        request(1, "d"), request(2, "d", schedule=None), request(3, "d", frequency=None),
        request(4, "d", schedule=None, frequency=None), request(5, "x", schedule=None),
        request(6, "x", frequency="soon"), request(7, "d", start_now=True),
    ]
    submitted = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in requests], REQUESTS)
    defined = spark.createDataFrame(
        [("d", datetime(2000, 1, 5), "1 week")],
        "pipeline_object string, start_time timestamp_ntz, period string",
    )
    found = ops.resolve_schedules(submitted, defined, times.as_timestamp(NOW)).collect()
    assert {r.request_id: r.next_run_time for r in found} == {
        1: NEXT, 2: datetime(2001, 6, 5), 3: datetime(2001, 6, 6), 4: datetime(2001, 6, 6),
        5: None, 6: None, 7: START,
    }
