"""ST1: failure streaks over a stream of attempts, with a counter per pipeline as keyed state.

The counters lie in map states of pipelines' buckets, so that a task is called once per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetmill.operators.streaks import CLEARED, DEACTIVATED, FAILED, MAX_FAILURES

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_COUNTER, _NO_PIPELINE = "counter", "none"
_STATE = "failure_count int, updated_at timestamp_ntz"
_RESULT = (
    "attempt_id bigint, pipeline string, attempt_time timestamp_ntz, ok boolean, log string, "
    "failure_number bigint, counter int, event string"
)
#: Pipelines are dealt to so many buckets, and a bucket's attempts are replayed together: a call per
#: pipeline costs some 30 ms, whatever it does. It is part of the stored state and must stay.
BUCKETS = 512


class StreakCounter(StatefulProcessor):
    """Replays the attempts of a bucket's pipelines in a micro-batch on top of their stored counters.

    A pipeline has its own entry in the bucket's state, while failures are open: a success removes it.
    """

    def __init__(self, max_failures: int, idle_ms: int | None):
        self._most, self._idle_ms = max_failures, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counters = handle.getMapState(_COUNTER, "pipeline string", _STATE, self._idle_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        columns = (initialState[c] for c in ("pipeline", "failure_count", "updated_at"))
        for pipeline, count, updated in zip(*columns, strict=True):
            self._counters.updateValue((pipeline,), (int(count), updated))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch's attempts of one bucket; the source's options bound a micro-batch.
        attempts = pd.concat(list(rows)).sort_values(["pipeline", "attempt_time", "attempt_id"])
        pipeline = attempts["pipeline"].to_numpy(object)
        first = np.append(True, pipeline[1:] != pipeline[:-1])
        begins = np.flatnonzero(first)
        known = [self._counters.getValue((p,)) for p in pipeline[begins]]
        prior = np.array([k[0] if k else 0 for k in known])
        ok = attempts["ok"].eq(True).to_numpy(bool, na_value=False)
        fails = np.cumsum(~ok)
        # Failures so far at the last success, or minus the stored ones where none came yet.
        start = fails.copy()
        start[begins] -= np.where(ok[begins], 0, 1 + prior)
        start = start[np.maximum.accumulate(np.where(ok | first, np.arange(len(ok)), 0))]
        number = np.minimum(fails - start, self._most + 1)
        counter = np.where(ok, 0, np.minimum(number, self._most))
        yield pd.DataFrame(
            {
                "attempt_id": attempts["attempt_id"].array,
                "pipeline": pipeline,
                "attempt_time": attempts["attempt_time"].array,
                "ok": ok,
                "log": attempts["log"].array,
                "failure_number": pd.array(np.where(ok, 0, number), "Int64"),
                "counter": counter.astype(np.int32),
                "event": np.where(ok, CLEARED, np.where(number > self._most, DEACTIVATED, FAILED)),
            }
        )
        ends = np.append(begins[1:], len(ok)) - 1
        times = (t.to_pydatetime() for t in attempts["attempt_time"].iloc[ends])
        for p, count, updated, before in zip(pipeline[ends], counter[ends], times, prior, strict=True):
            if count:
                self._counters.updateValue((p,), (int(count), updated))
            elif before:
                self._counters.removeKey((p,))

    def close(self) -> None:
        pass


def stream_failure_streaks(
    attempts: DataFrame,
    counters: DataFrame,
    max_failures: int = MAX_FAILURES,
    idle: int | None = None,
) -> DataFrame:
    """W4 over a stream: each attempt with its place in a run of failures and what follows.

    The counter of a pipeline is keyed state. ``counters`` is what the first start begins with; from
    then on the stream's own checkpoint has the counters, a restart goes on from it, and a micro-batch
    reads and writes only the pipelines that are in it. ``idle`` is the number of seconds after which
    a counter that no attempt touched is forgotten; by default none is.

    Attempts are taken in the order of their time, then their number, within a micro-batch and in
    arrival order across them. Attempts without a pipeline have a counter of their own. The state is
    kept in RocksDB, which this switches the session to: state grows with the pipelines that have
    open failures, and does not fit the default store's memory for a large fleet.
    """
    spark = attempts.sparkSession
    spark.conf.set(_PROVIDER, _ROCKSDB)
    # As text: a number column with nulls would come to Python as floating point.
    pipeline = F.coalesce(F.col("pipeline_id").cast("string"), F.lit(_NO_PIPELINE)).alias("pipeline")
    bucket = F.pmod(F.xxhash64("pipeline"), F.lit(BUCKETS)).cast("int").alias("bucket")
    known = counters.select(pipeline, "failure_count", "updated_at").where("failure_count > 0")
    known = known.select(bucket, "*")
    streaks = (
        attempts.select(pipeline, "attempt_id", "attempt_time", "ok", "log")
        .select(bucket, "*")
        .groupBy("bucket")
        .transformWithStateInPandas(
            StreakCounter(max_failures, None if idle is None else idle * 1000),
            outputStructType=_RESULT,
            outputMode="Append",
            timeMode="None" if idle is None else "ProcessingTime",
            initialState=known.groupBy("bucket"),
        )
    )
    return streaks.select(
        "attempt_id",
        F.col("pipeline").try_cast("bigint").alias("pipeline_id"),
        "attempt_time",
        "ok",
        "log",
        F.when(~F.col("ok"), F.col("failure_number")).alias("failure_number"),
        "counter",
        "event",
    )


def stored_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counter table as of the last finished micro-batch of the stream with this checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", _COUNTER).load(checkpoint)
    return state.select(
        F.col("user_map_key.pipeline").try_cast("bigint").alias("pipeline_id"),
        F.col("user_map_value.failure_count").alias("failure_count"),
        F.col("user_map_value.updated_at").alias("updated_at"),
    )
