"""Periods and iterated steps."""

import random
from calendar import monthrange
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetmill.functions import times
from fleetmill.operators import schedule

D = datetime

CASES = [
    ("previous", D(2016, 12, 25), "1 week", D(2016, 12, 19, 16, 20), D(2016, 12, 18)),
    ("previous", D(2016, 12, 18), "1 week", D(2016, 12, 19, 16, 20), D(2016, 12, 18)),
    ("previous", D(2016, 12, 18), "1 week", D(2016, 12, 26, 16, 20), D(2016, 12, 18)),
    ("previous", D(2016, 12, 18), "1 week", D(2016, 12, 11), D(2016, 12, 11)),
    ("previous", D(2016, 12, 18), "1 week", D(2016, 12, 6), D(2016, 12, 4)),
    ("previous", D(2016, 12, 18), "1 week", D(2016, 12, 18), D(2016, 12, 18)),
    ("next", D(2016, 12, 25), "1 week", D(2016, 12, 19, 16, 20), D(2016, 12, 25)),
    ("next", D(2016, 12, 18), "1 week", D(2016, 12, 19, 16, 20), D(2016, 12, 25)),
    ("next", D(2016, 12, 18), "1 week", D(2016, 12, 26, 16, 20), D(2017, 1, 1)),
    ("next", D(2016, 12, 18), "1 week", D(2016, 12, 25), D(2016, 12, 25)),
    ("next", D(2016, 12, 18), "1 week", D(2017, 1, 1), D(2017, 1, 1)),
    ("next", D(2016, 12, 18), "1 week", D(2016, 12, 18), D(2016, 12, 18)),
    ("times", D(2016, 12, 18), "1 day", D(2016, 12, 19), 1),
    ("times", D(2016, 12, 18), "1 hour", D(2016, 12, 19), 24),
    ("times", D(2016, 12, 18), "30 minutes", D(2016, 12, 19), 48),
    ("times", D(2016, 12, 18), "1 minute", D(2016, 12, 18, 1), 60),
    # iterated, not anchored
    ("next", D(2015, 1, 31), "1 month", D(2015, 3, 1), D(2015, 3, 28)),
    ("next", D(2015, 1, 31), "1 month", D(2015, 3, 29), D(2015, 4, 28)),
    ("times", D(2015, 1, 31), "1 month", D(2015, 3, 29), 3),
    ("next", D(2016, 2, 29), "1 year", D(2016, 3, 1), D(2017, 2, 28)),
    ("next", D(2016, 2, 29), "1 year", D(2020, 1, 1), D(2020, 2, 28)),
    ("next", D(2016, 2, 29), "4 years", D(2020, 1, 1), D(2020, 2, 29)),
    ("next", D(2016, 2, 29), "4 years", D(2101, 1, 1), D(2104, 2, 28)),
    ("next", D(1904, 2, 29), "16 months", D(2101, 1, 1), D(2101, 6, 28)),
    ("previous", D(2016, 3, 31), "1 month", D(2016, 1, 15), D(2015, 12, 29)),
    ("previous", D(2016, 2, 29), "1 year", D(2013, 1, 1), D(2012, 2, 28)),
]


def rows_of(spark, cases):
    rows = [(i, op, base, period, bound) for i, (op, base, period, bound, *_) in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "i int, op string, base timestamp_ntz, period string, bound timestamp_ntz"
    )
    return schedule.parse_periods(df)[0]


def compute(spark, cases):
    df = rows_of(spark, cases)
    bound = F.col("bound")
    df = schedule.run_counts(df, "base", bound)
    df = schedule.advance_next_run(df, "base", bound)
    df = schedule.previous_run(df, "base", bound)
    return {
        r.i: {"times": r.run_count, "next": r.advanced, "previous": r.previous}
        for r in df.collect()
    }


def test_cases(spark, zone):
    found = compute(spark, CASES)
    for i, (op, *_, expected) in enumerate(CASES):
        assert found[i][op] == expected, CASES[i]


def plus(ts, period, sign):
    n, unit = period.split()
    n = int(n) * sign
    if unit.startswith(("year", "month")):
        months = n * 12 if unit.startswith("year") else n
        at = ts.year * 12 + ts.month - 1 + months
        year, month = divmod(at, 12)
        return ts.replace(
            year=year, month=month + 1, day=min(ts.day, monthrange(year, month + 1)[1])
        )
    return ts + timedelta(**{(unit if unit.endswith("s") else unit + "s"): n})


def test_against_stepping_one_by_one(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(3000):
        unit = rng.choice(["year", "months", "week", "days", "hours", "minutes"])
        base = D(1996, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 366 * 8))
        if rng.random() < 0.5:
            base = base.replace(day=min(rng.choice([28, 29, 30, 31]), monthrange(base.year, base.month)[1]))
        span = {"year": 9000, "months": 3000, "week": 900, "days": 300, "hours": 30, "minutes": 1}
        bound = base + timedelta(
            days=rng.uniform(-1, 1) * span[unit] + 1 / 3, seconds=rng.randrange(3)
        )
        if rng.random() < 0.2:
            bound = base
        bound = bound.replace(microsecond=0)
        cases.append(("", base, f"{rng.randrange(1, 20)} {unit}", bound))
    found = compute(spark, cases)
    for i, (_, base, period, bound) in enumerate(cases):
        count, at = 0, base
        while at < bound:
            at, count = plus(at, period, 1), count + 1
        assert (found[i]["times"], found[i]["next"]) == (count, at), cases[i]
        at = base
        while at > bound:
            at = plus(at, period, -1)
        assert found[i]["previous"] == at, cases[i]


@pytest.mark.parametrize(
    "text, months, micros",
    [
        ("1 year", 12, None),
        ("2 Months", 2, None),
        ("1 week", None, 7 * times.MICROS_PER_DAY),
        (" 03  days ", None, 3 * times.MICROS_PER_DAY),
        ("12 hours", None, 12 * times.MICROS_PER_HOUR),
        ("90 minutes", None, 5400 * 10**6),
        ("10000 years", 120_000, None),
        ("280001 years", None, None),
        ("2000000 weeks", None, 14_000_000 * times.MICROS_PER_DAY),
        ("100000000 hours", None, 10**8 * times.MICROS_PER_HOUR),
        ("9999999999999 minutes", None, None),
        ("0 days", None, None),
        ("00 minutes", None, None),
        ("-1 day", None, None),
        ("1 fortnight", None, None),
        ("99999999999999999999 days", None, None),
        ("day", None, None),
        ("1.5 days", None, None),
        ("1 days 2", None, None),
        (None, None, None),
    ],
)
def test_period_texts(spark, text, months, micros):
    df = spark.createDataFrame([(text,)], "period string")
    usable, rejected = schedule.parse_periods(df)
    row = usable.first()
    if months is None and micros is None:
        assert row is None and rejected.first().period == text
    else:
        assert (row.period_months, row.period_micros) == (months, micros)
        assert rejected.first() is None


def test_steps_of_very_long_periods(spark):
    start, until = datetime(2001, 1, 31), datetime(9999, 12, 31)
    texts = ["280000 years", "10000 years", "14000000 weeks", "100000000 days", "2000000000 hours"]
    df = spark.createDataFrame([(x, start) for x in texts], "period string, s timestamp_ntz")
    usable, rejected = schedule.parse_periods(df)
    assert rejected.isEmpty()
    stepped = schedule.advance_next_run(
        schedule.run_counts(usable, "s", F.lit(until).cast("timestamp_ntz")),
        "s",
        F.lit(until).cast("timestamp_ntz"),
    )
    for row in stepped.select("run_count", F.year("advanced").alias("year")).collect():
        assert row.run_count == 1 and row.year > 9999


def test_expand_runs_in_chunks(spark):
    plan = spark.createDataFrame(
        [
            (1, D(2001, 1, 1), 25_001, None, 60 * 10**6),
            (2, D(2001, 1, 31), 15, 1, None),
            (3, D(2001, 1, 31), 1, 1, None),
        ],
        "pipeline_id bigint, first_run timestamp_ntz, times bigint, period_months int, "
        "period_micros bigint",
    )
    runs = schedule.expand_runs(plan).collect()
    minutes = sorted(r.run_time for r in runs if r.pipeline_id == 1)
    assert minutes == [D(2001, 1, 1) + timedelta(minutes=i) for i in range(25_001)]
    monthly = [r.run_time for r in sorted(runs) if r.pipeline_id == 2]
    at, expected = D(2001, 1, 31), []
    for _ in range(15):
        expected.append(at)
        at = plus(at, "1 month", 1)
    assert monthly == expected
    assert [r.run_time for r in runs if r.pipeline_id == 3] == [D(2001, 1, 31)]


def test_offsets(spark, zone):
    texts = [
        ("2016-03-01T04:00:01Z", D(2016, 3, 1, 4, 0, 1)),
        ("2016-03-01T04:00:01+02:00", D(2016, 3, 1, 2, 0, 1)),
        ("2021-03-14T02:30:00Z", D(2021, 3, 14, 2, 30)),
        ("9999-99-99T99:99:99Z", None),
        ("2016-03-01T04:00:01", None),
        ("soon", None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in texts], "stamp string")
    good, bad = schedule.normalize_timestamps(df, ["stamp"])
    expected = {t: e for t, e in texts if e is not None}
    rows = good.collect()
    assert {r.stamp: r.stamp_utc for r in rows} == expected
    assert {r.stamp_text for r in rows} == {e.isoformat() + "Z" for e in expected.values()}
    assert {r.stamp for r in bad.collect()} == {t for t, e in texts if e is None}


def test_tick_windows(spark, zone):
    df = spark.createDataFrame(
        [(D(2021, 3, 14, 2, 30, 5, 7),), (D(1969, 12, 31, 23, 59),), (D(2001, 1, 1),)],
        "ts timestamp_ntz",
    )
    found = {r.ts: (r.tick_start, r.tick_end, r.next_whole_hour) for r in
             schedule.tick_windows(df, "ts").collect()}
    for ts, (start, end, following) in found.items():
        hour = ts.replace(minute=0, second=0, microsecond=0)
        assert (start, end, following) == (hour, hour + timedelta(hours=1), hour + timedelta(hours=1))


def test_expand_runs_late_in_the_month(spark):
    """Days 29 to 31 against stepping one by one, and no list of months made per run."""
    dice = random.Random(5)
    plans = []
    for i in range(60):
        start = D(dice.choice([1896, 1999, 2000, 2096]), dice.choice([1, 3, 8, 12]), dice.choice([29, 30, 31]))
        plans.append((i, start, dice.randint(1, 200), dice.choice([1, 2, 3, 5, 11, 12, 16, 48]), None))
    plans.append((60, D(2000, 2, 29), 2, times.MAX_MONTHS // 2, None))
    plans.append((61, D(2000, 1, 31), 40, None, times.MICROS_PER_DAY))
    plan = spark.createDataFrame(
        plans,
        "pipeline_id bigint, first_run timestamp_ntz, times bigint, period_months int, "
        "period_micros bigint",
    )
    runs = schedule.expand_runs(plan)
    last_projection = runs._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "transform(" not in last_projection and "sequence(" not in last_projection
    found = {(r.pipeline_id, r.run_number): r.run_time for r in runs.where("pipeline_id <> 60").collect()}
    expected = {}
    for i, at, count, months, micros in plans:
        for k in range(count):
            if i != 60:
                expected[i, k] = at
            if micros:
                at += timedelta(microseconds=micros)
            elif i != 60:
                month = at.month - 1 + months
                year, month = at.year + month // 12, month % 12 + 1
                at = at.replace(year=year, month=month, day=min(at.day, monthrange(year, month)[1]))
    assert found == expected
    assert runs.where("pipeline_id = 60").count() == 2
