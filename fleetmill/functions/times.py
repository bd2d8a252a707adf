"""Zone-free timestamp arithmetic and iterated period steps.

A period is either a number of months (``year`` and ``month``) or of microseconds (everything
else); exactly one of the two is not null. Stepping is iterated, never anchored: 31 January
plus one month is 28 February and from there 28 March. The k-th iterate is still a closed
form. Its day of month is the smallest length among the months visited so far, and that
minimum cannot change after ``_SETTLED`` steps.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR

# What one of each unit is worth.
UNIT_MONTHS = {"year": 12, "month": 1}
UNIT_MICROS = {
    "week": 7 * MICROS_PER_DAY,
    "day": MICROS_PER_DAY,
    "hour": MICROS_PER_HOUR,
    "minute": 60 * MICROS_PER_SECOND,
}

# The month of the year repeats within 12 steps, and a series that only meets leap Februaries
# meets a century year that is not one within 400 years, i.e. within 50 visits 3 steps apart.
_SETTLED = 151

#: Lengths of months that can be too short for a day of the month, the longest first.
_SHORT = (30, 29, 28)


def as_timestamp(value: datetime | str | Column) -> Column:
    """A zone-free timestamp from a literal or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def packed_order(ts: Column, number: Column) -> Column:
    """A number that orders rows by ``ts``, then by ``number``.

    An aggregation that picks a value by a number can hash its groups; by a struct it has to sort
    all rows first.
    """
    micros = wall_micros(ts).cast("decimal(38,0)")
    return (micros * F.lit(str(1 << 64)).cast("decimal(20,0)") + number).cast("decimal(38,0)")


def wall_micros(ts: Column) -> Column:
    """Microseconds from 1970 to ``ts`` on the wall clock.

    Put together from the fields of ``ts``. ``timestamp_diff`` would take it to the session's
    time zone first, where a clock reading may not exist.
    """
    of_second = (F.date_part(F.lit("SECOND"), ts) * MICROS_PER_SECOND).cast("bigint")
    return (
        F.unix_date(ts.cast("date")) * F.lit(MICROS_PER_DAY).cast("bigint")
        + F.hour(ts) * F.lit(MICROS_PER_HOUR).cast("bigint")
        + F.minute(ts) * F.lit(60 * MICROS_PER_SECOND).cast("bigint")
        + of_second
    )


def micros_between(start: Column, end: Column) -> Column:
    return wall_micros(end) - wall_micros(start)


def plus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def plus_months(ts: Column, months: Column) -> Column:
    return ts + F.make_ym_interval(F.lit(0), months.cast("int"))


def floor_to(ts: Column, micros: int) -> Column:
    """Start of the ``micros``-long interval, counted from the epoch, that holds ``ts``."""
    epoch = as_timestamp("1970-01-01 00:00:00")
    since = wall_micros(ts)
    return plus_micros(epoch, since - F.pmod(since, F.lit(micros)))


def to_instant(ts: Column) -> Column:
    """The instant at which UTC clocks show ``ts``."""
    return F.timestamp_micros(wall_micros(ts))


def from_instant(instant: Column) -> Column:
    """What UTC clocks show at ``instant``."""
    return plus_micros(as_timestamp("1970-01-01 00:00:00"), F.unix_micros(instant))


def start_of_day(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def format_utc(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``."""
    text = F.substring(ts.cast("string"), 1, 19)
    return F.concat(F.translate(text, " ", "T"), F.lit("Z"))


def format_local(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``."""
    return F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T")


def parse_offset(text: Column) -> Column:
    """ISO date-time with an offset to UTC wall clock; null unless it is one."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    return from_instant(F.try_to_timestamp(F.when(iso, text)))


def parse_local(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` without a zone; null unless it is one."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    return F.when(iso, text).try_cast("timestamp_ntz")


# A step from any year of four digits stays in the timestamp range, which ends in the year 294247.
MAX_MONTHS = 280_000 * 12
MAX_MICROS = 280_000 * 365 * MICROS_PER_DAY

_PERIOD = rf"^ *(\d+) +({'|'.join([*UNIT_MONTHS, *UNIT_MICROS])})s? *$"


def is_usable_period(text: Column) -> Column:
    """True for an ``N unit`` or ``N units`` text with a positive N that steps stay in range with."""
    return F.coalesce(period_months(text), period_micros(text)).isNotNull()


def period_months(text: Column) -> Column:
    """Months of an ``N unit`` text, null for fixed-length or unusable ones."""
    return _period(text, UNIT_MONTHS, MAX_MONTHS).cast("int")


def period_micros(text: Column) -> Column:
    """Microseconds of an ``N unit`` text, null for calendar or unusable ones."""
    return _period(text, UNIT_MICROS, MAX_MICROS)


def _period(text: Column, units: dict[str, int], most: int) -> Column:
    amount = F.regexp_extract(F.lower(text), _PERIOD, 1).try_cast("bigint")
    unit = F.regexp_extract(F.lower(text), _PERIOD, 2)
    worth = F.lit(None).cast("bigint")
    for name, size in units.items():
        worth = F.when(unit == name, F.lit(size).cast("bigint")).otherwise(worth)
    length = F.try_multiply(amount, worth)
    return F.when((amount > 0) & (length <= most), length)


def _month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def month_ends(start: Column, months: Column) -> Column:
    """At which step a series first meets a month of 30, 29 and 28 days; 0 where it never does.

    These three numbers tell the least length among the months visited up to any step. Null where
    no month is too short for ``start``, or the period is not one of months.
    """
    first = (_month_number(start) - 1).cast("bigint")
    lengths = F.transform(
        F.sequence(F.lit(0), F.lit(_SETTLED)), lambda j: _month_length(first + j * months)
    )
    met = F.transform(
        F.array(lengths),
        lambda seen: F.struct(*[F.array_position(seen, F.lit(n)).alias(f"of_{n}") for n in _SHORT]),
    )
    return F.when((F.day(start) > 28) & months.isNotNull(), met[0])


def _month_length(number: Column) -> Column:
    """Days of a month, counted from January of the year 0."""
    month = F.pmod(number, F.lit(12)) + 1
    year = F.call_function("div", number - month + 1, F.lit(12).cast("bigint"))
    leap = (F.pmod(year, F.lit(4)) == 0) & (
        (F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0)
    )
    return (
        F.when(month == 2, F.when(leap, 29).otherwise(28))
        .when(month.isin(4, 6, 9, 11), 30)
        .otherwise(31)
    )


def calendar_step(
    start: Column, months: Column, k: Column, ends: Column | None = None
) -> Column:
    """The k-th iterate (k >= 0) of ``start`` by ``months``; ``months`` may be negative.

    ``ends`` are the :func:`month_ends` of the series, if a column has them; many steps of one
    series should share them. A single step looks at the months up to it by itself.
    """
    anchored = plus_months(start, k * months)
    if ends is None:
        lengths = F.transform(
            F.sequence(F.lit(0), F.least(k, F.lit(_SETTLED)).cast("int")),
            lambda j: F.day(F.last_day(plus_months(start, j * months))),
        )
        least = F.array_min(lengths)
    else:
        least = F.lit(31)
        for n in _SHORT:
            step = ends[f"of_{n}"]
            least = F.when((step > 0) & (step <= k + 1), n).otherwise(least)
    too_late = F.greatest(F.lit(0), F.day(anchored) - least)
    return F.when(F.day(start) <= 28, anchored).otherwise(
        anchored - F.make_dt_interval(days=too_late)
    )


def _exact_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def steps_until(start: Column, until: Column, months: Column, micros: Column) -> Column:
    """Number of iterates from ``start`` (included) that lie before ``until``."""
    distance = F.greatest(F.lit(0), micros_between(start, until))
    fixed = _exact_div(distance + micros - 1, micros)
    whole = _exact_div(
        F.greatest(F.lit(0), _month_number(until) - _month_number(start)).cast("bigint"), months
    )
    calendar = whole + (calendar_step(start, months, whole) < until).cast("bigint")
    steps = F.when(micros.isNotNull(), fixed).otherwise(calendar)
    return F.when(start < until, steps).when(start >= until, F.lit(0).cast("bigint"))


def steps_back(start: Column, now: Column, months: Column, micros: Column) -> Column:
    """Number of steps backward from ``start`` to the first iterate that is not after ``now``."""
    distance = F.greatest(F.lit(0), micros_between(now, start))
    fixed = _exact_div(distance + micros - 1, micros)
    whole = _exact_div(
        F.greatest(F.lit(0), _month_number(start) - _month_number(now)).cast("bigint"), months
    )
    calendar = whole + (calendar_step(start, -months, whole) > now).cast("bigint")
    steps = F.when(micros.isNotNull(), fixed).otherwise(calendar)
    return F.when(start > now, steps).when(start <= now, F.lit(0).cast("bigint"))


def step_at(
    start: Column, k: Column, months: Column, micros: Column, ends: Column | None = None
) -> Column:
    """``start`` after ``k`` steps, backward for a negative ``k``.

    ``ends``, if a column has them, are the :func:`month_ends` in the direction of the steps.
    """
    direction = F.when(k < 0, -months).otherwise(months)
    return F.when(micros.isNotNull(), plus_micros(start, k * micros)).otherwise(
        calendar_step(start, direction, F.abs(k), ends)
    )


def with_steps(table: DataFrame, start: str, steps: Column, out: str) -> DataFrame:
    """Adds ``start`` after ``steps`` steps of the row's ``period_months`` or ``period_micros``.

    The number of steps is a column of its own first, so that it is computed once per row.
    """
    period = (F.col("period_months"), F.col("period_micros"))
    counted = table.withColumn("_steps", steps)
    return counted.withColumn(out, step_at(F.col(start), F.col("_steps"), *period)).drop("_steps")
