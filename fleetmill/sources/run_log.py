"""The run log in storage: live runs apart from closed ones, with a life cycle.

Runs leave the console for good, and nearly all of a long run log has left it. A tick therefore
reads and rewrites live runs only. Below ``<path>``:

* ``live/tick=…`` holds all live runs as of a tick,
* ``left/tick=…`` the runs that left in it,
* ``closed/month=…`` the runs that left in the ticks of a whole month, once these are folded,
* ``ticks/tick=…`` and ``folds/month=…`` one small row each, written last.

A tick counts once its row in ``ticks`` is there, a month once its row in ``folds`` is; what was
written without is not read, and is replaced when the call is repeated. ``fold_month`` makes a few
large files of the many small ones of a month; ``expire`` removes live copies that no state needs any more
and what a fold has replaced. So the number of files follows months and kept states, not ticks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetmill.schema import SCHEDULED_PIPELINES
from fleetmill.session import remove_folder

_STORED = [f for f in SCHEDULED_PIPELINES.fieldNames() if f != "in_console"]
_RUNS = StructType([SCHEDULED_PIPELINES[f] for f in _STORED])
_NAME = r"\d{4}-\d{2}[\w.-]*"

#: About so many closed runs in a file of a month.
ROWS_PER_FILE = 5_000_000


def month_of(tick: str) -> str:
    return tick[:7]


def save_tick(runs: DataFrame, path: str, tick: str) -> None:
    """Writes a tick's live runs and the runs that left the console in it.

    ``runs`` are the live runs of the tick before, with ``in_console`` as it is now, and new
    ones; for the first tick they are the whole run log. ``tick`` begins with year and month, is part
    of a path and sorts as text, e.g. ``2001-06-01T05``. A tick can be written again until its month
    is folded.
    """
    if not re.fullmatch(_NAME, tick):
        raise ValueError(f"not usable as a tick: {tick}")
    spark = runs.sparkSession
    if month_of(tick) in _names(spark, path, "folds", "month"):
        raise ValueError(f"the month is folded: {tick}")
    remove_folder(spark, f"{path}/ticks/tick={tick}")
    for part, rows in (("live", runs.where("in_console")), ("left", runs.where("NOT in_console"))):
        rows.select(*_STORED).write.mode("overwrite").parquet(f"{path}/{part}/tick={tick}")
    _commit(spark, f"{path}/ticks/tick={tick}")


def committed_ticks(spark: SparkSession, path: str) -> list[str]:
    """The ticks that are there as a whole, in order. Folded and expired ones keep their row."""
    return _names(spark, path, "ticks", "tick")


def load_runs(spark: SparkSession, path: str, tick: str) -> DataFrame:
    """The run log as of ``tick``. A filter on ``in_console`` leaves one folder to be read.

    A tick that was not committed, or whose live copy has expired, is an error.
    """
    ticks = committed_ticks(spark, path)
    if tick not in ticks or not _exists(spark, f"{path}/live/tick={tick}"):
        raise ValueError(f"no such state: {tick}")
    folded = _names(spark, path, "folds", "month")
    current = month_of(tick)
    if current in folded and any(t > tick and month_of(t) == current for t in ticks):
        raise ValueError(f"within a folded month: {tick}")
    live = _read(spark, path, "live", "tick", [tick]).withColumn("in_console", F.lit(True))
    months = [m for m in folded if m <= current]
    open_ticks = [t for t in ticks if t <= tick and month_of(t) not in folded]
    closed = _read(spark, path, "closed", "month", months)
    closed = closed.unionByName(_read(spark, path, "left", "tick", open_ticks))
    return live.unionByName(closed.withColumn("in_console", F.lit(False)))


def fold_month(spark: SparkSession, path: str, month: str) -> int:
    """Makes few files of the runs that left in ``month`` and returns the number of ticks folded.

    The month is over: a later one has a committed tick. A folded month is left as it is.
    """
    ticks = committed_ticks(spark, path)
    own = [t for t in ticks if month_of(t) == month]
    if not own or month in _names(spark, path, "folds", "month"):
        return 0
    if month_of(ticks[-1]) <= month:
        raise ValueError(f"not over yet: {month}")
    rows = _read(spark, path, "left", "tick", own)
    files = max(1, -(-rows.count() // ROWS_PER_FILE))
    rows.repartition(files).write.mode("overwrite").parquet(f"{path}/closed/month={month}")
    _commit(spark, f"{path}/folds/month={month}")
    return len(own)


def expire(spark: SparkSession, path: str, keep: int) -> None:
    """Removes the live copies of all but the last ``keep`` committed ticks, and what is of no use.

    Of no use are files of ticks that were never committed and are older than the last one, and those
    that a fold has replaced. Readers of a removed state fail, so ``keep`` covers the longest job.
    """
    if keep < 1:
        raise ValueError("the last state is always kept")
    ticks = committed_ticks(spark, path)
    folded = set(_names(spark, path, "folds", "month"))
    kept = set(ticks[-keep:])
    for tick in _names(spark, path, "live", "tick"):
        if ticks and tick < ticks[-1] and tick not in kept:
            remove_folder(spark, f"{path}/live/tick={tick}")
    for tick in _names(spark, path, "left", "tick"):
        torn = ticks and tick < ticks[-1] and tick not in ticks
        if torn or month_of(tick) in folded:
            remove_folder(spark, f"{path}/left/tick={tick}")


def _read(spark: SparkSession, path: str, part: str, column: str, names: list[str]) -> DataFrame:
    """The runs in the folders of ``names``; only these are listed."""
    if not names:
        return spark.createDataFrame([], _RUNS)
    layout = StructType([*_RUNS.fields, StructField(column, StringType())])
    folders = [f"{path}/{part}/{column}={n}" for n in names]
    stored = spark.read.schema(layout).option("basePath", f"{path}/{part}").parquet(*folders)
    return stored.select(*_STORED)


def _commit(spark: SparkSession, folder: str) -> None:
    spark.range(1).write.mode("overwrite").parquet(folder)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _hadoop(spark, path)
    return system.exists(target)


def _names(spark: SparkSession, path: str, part: str, column: str) -> list[str]:
    """What the folders ``<path>/<part>/<column>=…`` are called; in ``ticks`` and ``folds``, those of
    which the write came to its end."""
    system, target = _hadoop(spark, f"{path}/{part}")
    if not system.exists(target):
        return []
    found = [f.getPath().getName() for f in system.listStatus(target)]
    names = sorted(n.split("=", 1)[1] for n in found if n.startswith(f"{column}="))
    if part in ("live", "left"):
        return names
    return [n for n in names if _exists(spark, f"{path}/{part}/{column}={n}/_SUCCESS")]
