"""Joins on a key that holds most rows are split at run time."""

import contextlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetmill import session
from fleetmill.operators import constraints, retention, schedule, submissions

T = datetime(2001, 6, 1)


@contextlib.contextmanager
def settings(spark, **given):
    given = {"spark.sql." + k.replace("_", "."): v for k, v in given.items()}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def runs(spark, n=60_000):
    return spark.range(n).select(
        F.concat(F.lit("df-"), "id").alias("aws_id"),
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 500).alias("pipeline_id"),
        F.lit(T).cast("timestamp_ntz").alias("actual_start"),
    ).repartition(8)


def runs_with_pipeline(spark):
    pipelines = spark.range(500).select(
        "id", F.lit(2).alias("retention"), F.lit(None).cast("string").alias("owner")
    )
    return retention.runs_with_pipeline(runs(spark), pipelines)


def orphans(spark):
    return constraints.orphan_rows(runs(spark), spark.range(100, 500))


def activated(spark):
    deployed = spark.range(500).select(
        F.col("id").alias("pipeline_id"),
        F.concat(F.lit("n"), "id").alias("pipeline_name"),
        F.lit(T).cast("timestamp_ntz").alias("deployed_time"),
    )
    names = runs(spark).select(
        "aws_id", F.concat(F.lit("n"), "pipeline_id").alias("pipeline_name")
    )
    activations = deployed.select("pipeline_name", F.lit(True).alias("activated"))
    now = F.lit(T).cast("timestamp_ntz")
    return schedule.activated_runs(deployed, names, activations, now, now)[0]


def judged(spark):
    pipelines = spark.range(500).select("id", F.lit(2).alias("retention"))
    healthy = runs(spark).withColumn("health_status", F.lit(None).cast("string"))
    return retention.judge_finished(healthy, pipelines)


def requested(spark):
    asked = runs(spark).select(
        F.col("aws_id").alias("request_id"), F.concat(F.lit("n"), "pipeline_id").alias("obj")
    )
    name = F.concat(F.lit("n"), "id")
    pipelines = spark.range(500).select("id", name.alias("name"), name.alias("class_name"))
    return submissions.match_by_name_or_class(
        asked.withColumnRenamed("obj", "pipeline_object"), pipelines
    )


def launched(spark):
    jars = runs(spark).withColumn("jar", F.concat(F.lit("j"), "pipeline_id"))
    known = spark.range(500).select(F.concat(F.lit("j"), "id").alias("jar")).distinct()
    return jars.join(session.lookup(known), "jar", "left")


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("build", [activated, judged, requested, launched])
def test_looked_up_side(spark, monkeypatch, build, small):
    """Broadcast when counted to be small, split at run time when not."""
    if not small:
        monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    found, plan = run(spark, build)
    assert ("BroadcastHashJoin" if small else "skew=true") in plan
    assert found == 60_000


@pytest.mark.parametrize("build", [runs_with_pipeline, orphans])
def test_hot_key_is_split(spark, build):
    found, plan = run(spark, build)
    assert "skew=true" in plan
    assert found > 40_000


def run(spark, build):
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive_skewJoin_skewedPartitionThresholdInBytes="20KB",
        adaptive_advisoryPartitionSizeInBytes="40KB",
    ):
        joined = build(spark)
        found = len(joined.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString()
    return found, plan.split("Initial Plan")[0]
