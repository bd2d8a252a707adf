"""One query per operator, with the SQL that must give the same rows.

Queries read whole tables. Limits appear only where a limit is the operator (top-n, per-pipeline
top-k, batches).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures
from fleetmill.functions import times
from fleetmill.operators import (
    constraints,
    counts,
    datums,
    metrics,
    notifications,
    retention,
    schedule,
    sketches,
    streaks,
    submissions,
    unmanaged,
)
from fleetmill.plans import cleanup, cycle, metric_report
from fleetmill.plans import schedule_tick as ticks
from fleetmill.plans import submissions as submitting
from fleetmill.schema import CHILD_TABLES, TABLES
from fleetmill.session import scratch_path
from fleetmill.sources import catalog as catalogs
from fleetmill.sources import changes, inventory, run_log
from fleetmill.sources import datums as datum_sink
from fleetmill.sources.due_store import DueStore
from fleetmill.sources.keyed_store import KeyedStore
from fleetmill.streaming import reports as stream_reports
from fleetmill.streaming.streaks import stored_counters, stream_failure_streaks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TICK_START = "2001-05-31 23:00:00"
TICK_END = "2001-06-01 00:00:00"
BACK_TO = "1996-03-15 10:20:00"
CUTOFF = "1999-06-15 12:00:00"
AS_OF = "2024-01-30 23:00:00"
PREFIX = "sp_"
EXCLUDED = ["sp_", "dev_"]
DEFAULT_MAILS = ["fleet@example.com", "night@example.com"]
SERVICE = "Fleet"
GLOBAL_DIMENSIONS = ("Environment=test", "Stack = main")
REPORT = replace(datums.SERVICE_SETTINGS, global_dimensions=GLOBAL_DIMENSIONS)
SPARSE_REPORT = replace(
    datums.ReportSettings(), statistic_set=True, arithmetic_mean=True, duration_factor=0.5
)
LATENESS = "1 hour"

# Figures are compared to this many digits. The test values have two, so no mean of fewer than
# 256 of them lies halfway between two rounded values.
DIGITS = 9


@dataclass(frozen=True)
class Inputs:
    """Test tables and views of one scale."""

    spark: SparkSession
    sf_dir: str

    def __getitem__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def catalog(self) -> dict[str, DataFrame]:
        return fixtures.catalog(self.spark, self.sf_dir)


def check(name: str, sql: str | None = None):
    """Registers a query, and the SQL to compare it with."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixtures.for_duckdb(sql)
        return build

    return register


def ts(text: str):
    return times.as_timestamp(text)


def tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables under each other, as (table_name, row_key)."""
    merged = None
    for name, df in frames.items():
        key = TABLES[name].key[0]
        part = df.select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key")
        )
        merged = part if merged is None else merged.unionByName(part)
    return merged


STEP = """CASE period WHEN '1 day' THEN INTERVAL 1 DAY WHEN '1 week' THEN INTERVAL 7 DAY
    WHEN '1 month' THEN INTERVAL 1 MONTH WHEN '12 hours' THEN INTERVAL 12 HOUR
    WHEN '1 year' THEN INTERVAL 1 YEAR WHEN '90 minutes' THEN INTERVAL 90 MINUTE END"""
NEXT_WHEN = "next_run_time < TIMESTAMP '{0}' AND (end_time IS NULL OR end_time > next_run_time)"
DUE = f"{NEXT_WHEN.format(TICK_END)} AND is_active"


def forward(start: str, until: str) -> str:
    return (
        f"CASE WHEN {start} < {until} THEN range({start}, {until}, {STEP})[-1] + {STEP} "
        f"ELSE {start} END"
    )


def backward(start: str, until: str) -> str:
    return (
        f"CASE WHEN {start} > {until} THEN range({start}, {until}, -({STEP}))[-1] - {STEP} "
        f"ELSE {start} END"
    )


# --- sources and sinks ---------------------------------------------------------------------

CATALOG_ROWS = """
    SELECT 'pipelines' AS table_name, CAST(id AS VARCHAR) AS row_key FROM {fx_pipelines}
    UNION ALL SELECT 'scheduled_pipelines', aws_id FROM {fx_runs}
    UNION ALL SELECT 'failed_pipelines', aws_id FROM {fx_failed}
    UNION ALL SELECT 'schedule_failure_counters', CAST(pipeline_id AS VARCHAR) FROM {fx_counters}
    UNION ALL SELECT 'scheduler_metrics', CAST(start_time AS VARCHAR) FROM {fx_scheduler_metrics}"""


@check("s1_load_catalog", CATALOG_ROWS)
def _(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "catalog")
    catalogs.save_catalog(t.catalog(), path)
    return tagged(catalogs.load_catalog(t.spark, path))


def listing_pages(t: Inputs) -> DataFrame:
    """Pages of about 100 ids; entries in error are listed a second time on another page."""
    numbered = t["fx_status"].select(
        "aws_id", "health_status", F.substring("aws_id", 4, 20).cast("bigint").alias("n")
    )
    first = numbered.select("aws_id", F.floor(F.col("n") / 100).alias("page"))
    again = numbered.where("health_status = 'ERROR'").select(
        "aws_id", (F.floor((F.col("n") + 37) / 100) + 1_000_000_000).alias("page")
    )
    return first.unionByName(again).groupBy("page").agg(F.collect_list("aws_id").alias("ids"))


@check("s2_load_inventory", "SELECT aws_id FROM {fx_status}")
def _(t: Inputs) -> DataFrame:
    return inventory.load_inventory(listing_pages(t))


def descriptions(t: Inputs) -> DataFrame:
    """Field lists with an outdated health value in front and absent fields left out."""

    def field(key: str, value) -> object:
        return F.when(
            value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("string_value"))
        )

    health = F.col("health_status")
    return t["fx_status"].select(
        "aws_id",
        "name",
        F.array_compact(
            F.array(
                field(inventory.HEALTH_KEY, F.when(health.isNotNull(), "OUTDATED")),
                field("@sphere", F.lit("PIPELINE")),
                field(inventory.STATE_KEY, F.col("pipeline_state")),
                field(inventory.HEALTH_KEY, health),
                field(inventory.CREATED_KEY, F.col("creation_time")),
            )
        ).alias("fields"),
    )


@check("s3_flatten_status", "SELECT * FROM {fx_status}")
def _(t: Inputs) -> DataFrame:
    return inventory.flatten_status(descriptions(t))


@check(
    "s4_validate_state",
    """SELECT aws_id, pipeline_state,
              COALESCE(pipeline_state NOT IN ('PROMOTED'), TRUE) AS valid
       FROM {fx_status_dirty}""",
)
def _(t: Inputs) -> DataFrame:
    valid, rejected = inventory.validate_state(t["fx_status_dirty"])
    shown = ["aws_id", "pipeline_state"]
    return valid.select(*shown, F.lit(True).alias("valid")).unionByName(
        rejected.select(*shown, F.lit(False).alias("valid"))
    )


@check(
    "s5_append_rows",
    "SELECT * FROM {fx_runs} UNION ALL SELECT * FROM {fx_new_runs}",
)
def _(t: Inputs) -> DataFrame:
    return changes.append_rows(t["fx_runs"], t["fx_new_runs"])


LOGGED_COLUMNS = [f for f in TABLES["scheduled_pipelines"].schema.fieldNames() if f != "in_console"]
LOGGED = ", ".join(LOGGED_COLUMNS)


@check(
    "s5_run_log_states",
    f"""WITH first AS (
            SELECT r.*, s.aws_id IS NOT NULL AS finished
            FROM {{fx_runs}} r LEFT JOIN (
                SELECT aws_id FROM {{fx_status}} WHERE pipeline_state = 'FINISHED') s
            ON s.aws_id = r.aws_id),
        second AS (
            SELECT {LOGGED}, in_console AND NOT finished AS in_console FROM first
            UNION ALL SELECT {LOGGED}, in_console FROM {{fx_new_runs}})
        SELECT '2024-02-01T00' AS tick, {LOGGED}, in_console FROM second
        UNION ALL
        SELECT '2024-02-01T01' AS tick, {LOGGED}, in_console AND status <> 'fail' AS in_console
        FROM second""",
)
def _(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "run_log")
    names = ["2024-01-31T23", "2024-02-01T00", "2024-02-01T01"]

    def live(tick: str) -> DataFrame:
        return run_log.load_runs(t.spark, path, tick).where("in_console")

    run_log.save_tick(t["fx_runs"], path, names[0])
    finished = t["fx_status"].where("pipeline_state = 'FINISHED'").select("aws_id")
    still = live(names[0]).join(finished, "aws_id", "left_anti")
    left = live(names[0]).join(finished, "aws_id", "left_semi").withColumn("in_console", F.lit(False))
    run_log.save_tick(still.unionByName(left).unionByName(t["fx_new_runs"]), path, names[1])
    failed = F.col("status") != "fail"
    run_log.save_tick(live(names[1]).withColumn("in_console", failed), path, names[2])
    run_log.fold_month(t.spark, path, "2024-01")
    run_log.expire(t.spark, path, keep=2)
    states = [run_log.load_runs(t.spark, path, n).withColumn("tick", F.lit(n)) for n in names[1:]]
    return states[0].unionByName(states[1]).select("tick", *LOGGED_COLUMNS, "in_console")


CHANGED_COUNTERS = """
    SELECT pipeline_id, CAST(count(*) AS INT) AS failure_count, max(attempt_time) AS updated_at
    FROM {fx_attempts} WHERE NOT ok GROUP BY pipeline_id"""


def changed_counters(t: Inputs) -> DataFrame:
    return (
        t["fx_attempts"]
        .where("NOT ok")
        .groupBy("pipeline_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("failure_count"),
            F.max("attempt_time").alias("updated_at"),
        )
    )


UPSERTED = f"""WITH changed AS ({CHANGED_COUNTERS})
        SELECT * FROM changed
        UNION ALL SELECT * FROM {{fx_counters}}
        WHERE pipeline_id NOT IN (SELECT pipeline_id FROM changed)"""


@check("s6_upsert_by_key", UPSERTED)
def _(t: Inputs) -> DataFrame:
    return changes.upsert_by_key(t["fx_counters"], changed_counters(t), ["pipeline_id"])


DELETED = """
    SELECT * FROM {fx_counters} WHERE pipeline_id NOT IN (
        SELECT pipeline_id FROM {fx_attempts}
        WHERE ok AND attempt_time > TIMESTAMP '2024-01-29 00:00:00')"""


def late_successes(t: Inputs) -> DataFrame:
    late = F.col("attempt_time") > ts("2024-01-29 00:00:00")
    return t["fx_attempts"].where(F.col("ok") & late).select("pipeline_id").distinct()


UPDATED = """SELECT p.id, p.name, p.is_active,
              CASE WHEN c.pipeline_id IS NOT NULL THEN NULL ELSE p.end_time END AS end_time,
              CASE WHEN c.pipeline_id IS NOT NULL THEN c.updated_at ELSE p.next_run_time END
                  AS next_run_time
       FROM {fx_pipelines} p LEFT JOIN {fx_counters} c ON c.pipeline_id = p.id"""


def given_times(t: Inputs) -> DataFrame:
    return t["fx_counters"].select(
        F.col("pipeline_id").alias("id"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.col("updated_at").alias("next_run_time"),
    )


@check("s7_update_where", UPDATED)
def _(t: Inputs) -> DataFrame:
    updated = changes.update_where(
        t["fx_pipelines"], given_times(t), ["id"], ["end_time", "next_run_time"]
    )
    return updated.select("id", "name", "is_active", "end_time", "next_run_time")


def stored(t: Inputs, view: str, key: str) -> KeyedStore:
    """``view`` as a stored table in key buckets."""
    store = KeyedStore(t.spark, scratch_path(t.spark, view), (key,), 8, t[view].schema)
    return store.create(t[view])


@check("s6_stored_upsert", UPSERTED)
def _(t: Inputs) -> DataFrame:
    store = stored(t, "fx_counters", "pipeline_id")
    store.upsert(changed_counters(t))
    return store.load()


@check("s7_stored_update", UPDATED)
def _(t: Inputs) -> DataFrame:
    store = stored(t, "fx_pipelines", "id")
    store.update(given_times(t), ["end_time", "next_run_time"])
    return store.load().select("id", "name", "is_active", "end_time", "next_run_time")


@check("s8_stored_delete", DELETED)
def _(t: Inputs) -> DataFrame:
    store = stored(t, "fx_counters", "pipeline_id")
    store.delete(late_successes(t))
    return store.load()


@check(
    "s7_updated_count",
    """SELECT count(*) AS updated_rows FROM {fx_pipelines}
       WHERE id IN (SELECT pipeline_id FROM {fx_counters})""",
)
def _(t: Inputs) -> DataFrame:
    given = t["fx_counters"].select(F.col("pipeline_id").alias("id"))
    return changes.updated_count(t["fx_pipelines"], given, ["id"])


@check("s8_delete_where", DELETED)
def _(t: Inputs) -> DataFrame:
    return changes.delete_where(t["fx_counters"], late_successes(t), ["pipeline_id"])


# --- constraints ---------------------------------------------------------------------------


@check(
    "k1_pk_violations",
    """SELECT pipeline_id, count(*) AS row_count FROM (
           SELECT pipeline_id FROM {fx_counters}
           UNION ALL SELECT CASE WHEN user_id <> 0 THEN user_id END FROM {events}
           WHERE event_type = 'signup') AS u
       GROUP BY pipeline_id HAVING count(*) > 1 OR pipeline_id IS NULL""",
)
def _(t: Inputs) -> DataFrame:
    extra = t["events"].where("event_type = 'signup'").select(
        F.when(F.col("user_id") != 0, F.col("user_id")).alias("pipeline_id")
    )
    keys = t["fx_counters"].select("pipeline_id").unionByName(extra)
    return constraints.pk_violations(keys, ["pipeline_id"])


@check(
    "k2_domain_violations",
    """WITH rows AS (
           SELECT id, name, jar, class_name, is_active, retention, start_time, period, backfill,
                  owner FROM {fx_pipelines}
           UNION ALL SELECT doc_id, text, source, lang, TRUE, NULL, NULL, substr(text, 1, 60),
                  TRUE, NULL FROM {documents})
       SELECT id, 'name' AS column_name, 'null' AS rule FROM rows WHERE name IS NULL
       UNION ALL SELECT id, 'name', 'too long' FROM rows WHERE length(name) > 200
       UNION ALL SELECT id, 'jar', 'null' FROM rows WHERE jar IS NULL
       UNION ALL SELECT id, 'jar', 'too long' FROM rows WHERE length(jar) > 200
       UNION ALL SELECT id, 'class_name', 'null' FROM rows WHERE class_name IS NULL
       UNION ALL SELECT id, 'class_name', 'too long' FROM rows WHERE length(class_name) > 200
       UNION ALL SELECT id, 'retention', 'null' FROM rows WHERE retention IS NULL
       UNION ALL SELECT id, 'start_time', 'null' FROM rows WHERE start_time IS NULL
       UNION ALL SELECT id, 'period', 'null' FROM rows WHERE period IS NULL
       UNION ALL SELECT id, 'period', 'too long' FROM rows WHERE length(period) > 50
       UNION ALL SELECT id, 'owner', 'too long' FROM rows WHERE length(owner) > 254""",
)
def _(t: Inputs) -> DataFrame:
    pipelines = t["fx_pipelines"]
    texts = t["documents"].select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("name"),
        F.col("source").alias("jar"),
        F.col("lang").alias("class_name"),
        F.lit(True).alias("is_active"),
        F.substring("text", 1, 60).alias("period"),
        F.lit(True).alias("backfill"),
    )
    return constraints.domain_violations(
        pipelines.unionByName(texts, allowMissingColumns=True), TABLES["pipelines"]
    )


@check(
    "k3_orphan_rows",
    """WITH parents AS (SELECT id FROM {fx_pipelines} WHERE is_active)
       SELECT 'scheduled_pipelines' AS table_name, aws_id AS row_key FROM {fx_runs}
       WHERE pipeline_id NOT IN (SELECT id FROM parents)
       UNION ALL SELECT 'failed_pipelines', aws_id FROM {fx_failed}
       WHERE pipeline_id NOT IN (SELECT id FROM parents)
       UNION ALL SELECT 'schedule_failure_counters', CAST(pipeline_id AS VARCHAR)
       FROM {fx_counters} WHERE pipeline_id NOT IN (SELECT id FROM parents)""",
)
def _(t: Inputs) -> DataFrame:
    catalog = t.catalog()
    parents = retention.active_pipelines(catalog["pipelines"])
    return tagged(
        {name: constraints.orphan_rows(catalog[name], parents) for name in CHILD_TABLES}
    )


@check(
    "k1_added_keys",
    """SELECT pipeline_id, count(*) AS row_count FROM (
           SELECT pipeline_id FROM {fx_counters}
           UNION ALL SELECT CASE WHEN user_id % 31 <> 0 THEN user_id END FROM {events}
           WHERE event_type = 'signup' AND value >= 100)
       GROUP BY pipeline_id HAVING count(*) > 1 OR pipeline_id IS NULL""",
)
def _(t: Inputs) -> DataFrame:
    signups = t["events"].where("event_type = 'signup' AND value >= 100")
    owner = F.when(F.col("user_id") % 31 != 0, F.col("user_id"))
    added = signups.select(owner.alias("pipeline_id"))
    return constraints.added_pk_violations(t["fx_counters"], added, ["pipeline_id"])


@check(
    "k3_changed_orphans",
    """WITH parents AS (SELECT id FROM {fx_pipelines} WHERE end_time IS NULL)
       SELECT aws_id, pipeline_id FROM {fx_runs}
       WHERE pipeline_id NOT IN (SELECT id FROM parents)
       UNION ALL SELECT aws_id, owner FROM (
           SELECT aws_id, CASE WHEN pipeline_id % 7 = 0 THEN -pipeline_id ELSE pipeline_id END
                  AS owner FROM {fx_new_runs}) AS n
       WHERE owner NOT IN (SELECT id FROM parents)""",
)
def _(t: Inputs) -> DataFrame:
    pipelines = t["fx_pipelines"]
    owner = F.col("pipeline_id")
    added = t["fx_new_runs"].withColumn("pipeline_id", F.when(owner % 7 == 0, -owner).otherwise(owner))
    orphans = constraints.changed_orphans(
        t["fx_runs"],
        added,
        pipelines.where("end_time IS NULL"),
        pipelines.where("end_time IS NOT NULL").select("id"),
    )
    return orphans.select("aws_id", "pipeline_id")


@check(
    "k4_cascade_delete",
    f"""WITH rows AS ({CATALOG_ROWS}), gone AS (
            SELECT id FROM {{fx_pipelines}} WHERE end_time IS NOT NULL)
        SELECT * FROM rows WHERE (table_name, row_key) NOT IN (
            SELECT ('pipelines', CAST(id AS VARCHAR)) FROM gone
            UNION ALL SELECT ('scheduled_pipelines', aws_id) FROM {{fx_runs}}
                      WHERE pipeline_id IN (SELECT id FROM gone)
            UNION ALL SELECT ('failed_pipelines', aws_id) FROM {{fx_failed}}
                      WHERE pipeline_id IN (SELECT id FROM gone)
            UNION ALL SELECT ('schedule_failure_counters', CAST(pipeline_id AS VARCHAR))
                      FROM {{fx_counters}} WHERE pipeline_id IN (SELECT id FROM gone))""",
)
def _(t: Inputs) -> DataFrame:
    catalog = t.catalog()
    ended = catalog["pipelines"].where("end_time IS NOT NULL").select("id")
    return tagged(constraints.cascade_delete(catalog, ended))


@check(
    "k5_assign_ids",
    """SELECT request_id, pipeline_object AS name,
              (SELECT max(id) FROM {fx_pipelines})
                  + row_number() OVER (ORDER BY pipeline_object, request_id) AS id
       FROM {fx_submissions}""",
)
def _(t: Inputs) -> DataFrame:
    new = t["fx_submissions"].select("request_id", F.col("pipeline_object").alias("name"))
    return constraints.assign_ids(t["fx_pipelines"], new, ["name", "request_id"])


# --- filters -------------------------------------------------------------------------------


@check("f1_due", f"SELECT id, next_run_time, end_time FROM {{fx_pipelines}} WHERE {DUE}")
def _(t: Inputs) -> DataFrame:
    due = schedule.due_pipelines(t["fx_pipelines"], ts(TICK_END))
    return due.select("id", "next_run_time", "end_time")


def stored_by_month(t: Inputs) -> DueStore:
    pipelines = t["fx_pipelines"]
    path = scratch_path(t.spark, "by_month")
    return DueStore(t.spark, path, pipelines.schema, "month").create(pipelines)


@check("f1_due_stored", f"SELECT id, next_run_time, end_time FROM {{fx_pipelines}} WHERE {DUE}")
def _(t: Inputs) -> DataFrame:
    return stored_by_month(t).due(TICK_END).select("id", "next_run_time", "end_time")


LATER = "2002-06-20 00:00:00"


@check(
    "f1_due_after_a_tick",
    f"""WITH moved AS (
            SELECT id, is_active, end_time,
                   CASE WHEN NOT ({DUE}) OR ({DUE}) IS NULL THEN next_run_time
                        WHEN id % 3 <> 0 THEN next_run_time + INTERVAL 400 DAY END AS next_run_time
            FROM {{fx_pipelines}})
        SELECT id, next_run_time FROM moved
        WHERE {NEXT_WHEN.format(LATER)} AND is_active""",
)
def _(t: Inputs) -> DataFrame:
    store = stored_by_month(t)
    later = F.when(F.col("id") % 3 != 0, F.col("next_run_time") + F.expr("INTERVAL '400' DAY"))
    store.advance(store.due(TICK_END).withColumn("next_run_time", later), TICK_END)
    return store.due(LATER).select("id", "next_run_time")


@check("f2_active", "SELECT id, name FROM {fx_pipelines} WHERE is_active")
def _(t: Inputs) -> DataFrame:
    return retention.active_pipelines(t["fx_pipelines"]).select("id", "name")


@check("f3_in_console", "SELECT * FROM {fx_runs} WHERE in_console")
def _(t: Inputs) -> DataFrame:
    return retention.in_console_runs(t["fx_runs"])


@check(
    "f4_finished_runs",
    """SELECT r.aws_id, r.pipeline_id FROM {fx_runs} r JOIN {fx_status} s ON s.aws_id = r.aws_id
       WHERE s.pipeline_state = 'FINISHED'""",
)
def _(t: Inputs) -> DataFrame:
    found = retention.runs_with_status(t["fx_runs"], t["fx_status"])
    return retention.finished_runs(found).select("aws_id", "pipeline_id")


@check(
    "f5_split_by_health",
    """SELECT r.aws_id, COALESCE(s.health_status = 'ERROR', FALSE) AS failed
       FROM {fx_runs} r JOIN {fx_status} s ON s.aws_id = r.aws_id
       WHERE s.pipeline_state = 'FINISHED'""",
)
def _(t: Inputs) -> DataFrame:
    found = retention.runs_with_status(t["fx_runs"], t["fx_status"])
    failed, healthy = retention.split_by_health(retention.finished_runs(found))
    return failed.select("aws_id", F.lit(True).alias("failed")).unionByName(
        healthy.select("aws_id", F.lit(False).alias("failed"))
    )


OLD_AND_FINISHED = """pipeline_state = 'FINISHED'
    AND CAST(creation_time AS TIMESTAMP) < TIMESTAMP '1999-06-15 00:00:00'"""
UNPROTECTED = "NOT (name LIKE 'sp\\_%' ESCAPE '\\' OR name LIKE 'dev\\_%' ESCAPE '\\')"
OWN = "name LIKE 'sp\\_%' ESCAPE '\\'"


@check(
    "f6_deletable_unmanaged",
    f"SELECT aws_id, name FROM {{fx_status}} WHERE {UNPROTECTED} AND {OLD_AND_FINISHED}",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged.deletable_unmanaged(
        t["fx_status"], EXCLUDED, ts(CUTOFF), PREFIX
    ).select("aws_id", "name")


@check(
    "f6_deletable_forced",
    f"""SELECT aws_id, name FROM {{fx_status}}
        WHERE ({OWN} OR {UNPROTECTED}) AND {OLD_AND_FINISHED}""",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged.deletable_unmanaged(
        t["fx_status"], EXCLUDED, ts(CUTOFF), PREFIX, force=True
    ).select("aws_id", "name")


# --- joins ---------------------------------------------------------------------------------


@check(
    "j1_runs_with_settings",
    """SELECT r.aws_id, r.pipeline_id, p.retention, p.owner
       FROM {fx_runs} r JOIN {fx_pipelines} p ON p.id = r.pipeline_id""",
)
def _(t: Inputs) -> DataFrame:
    joined = retention.runs_with_pipeline(t["fx_runs"], t["fx_pipelines"])
    return joined.select("aws_id", "pipeline_id", "retention", "owner")


@check(
    "j2_runs_with_status",
    """SELECT r.aws_id, s.health_status, s.pipeline_state, s.aws_id IS NOT NULL AS in_inventory
       FROM {fx_runs} r LEFT JOIN {fx_status} s ON s.aws_id = r.aws_id""",
)
def _(t: Inputs) -> DataFrame:
    return retention.runs_with_status(t["fx_runs"], t["fx_status"]).select(
        "aws_id", "health_status", "pipeline_state", "in_inventory"
    )


@check(
    "j3_vanished_runs",
    """SELECT aws_id, pipeline_id FROM {fx_runs}
       WHERE in_console AND aws_id NOT IN (SELECT aws_id FROM {fx_status})""",
)
def _(t: Inputs) -> DataFrame:
    return retention.vanished_runs(t["fx_runs"], t["fx_status"]).select("aws_id", "pipeline_id")


UNMANAGED = """aws_id NOT IN (SELECT aws_id FROM {fx_runs} WHERE in_console)"""


@check("j4_unmanaged", f"SELECT aws_id FROM {{fx_status}} WHERE {UNMANAGED}")
def _(t: Inputs) -> DataFrame:
    ids = inventory.load_inventory(listing_pages(t))
    return unmanaged.unmanaged_inventory(ids, t["fx_runs"])


@check(
    "j5_new_failures",
    """SELECT r.aws_id, r.pipeline_id FROM {fx_runs} r JOIN {fx_status} s ON s.aws_id = r.aws_id
       WHERE s.pipeline_state = 'FINISHED' AND s.health_status = 'ERROR'
         AND NOT EXISTS (SELECT 1 FROM {fx_failed} f WHERE f.aws_id = r.aws_id)""",
)
def _(t: Inputs) -> DataFrame:
    found = retention.runs_with_status(t["fx_runs"], t["fx_status"])
    failed, _ = retention.split_by_health(retention.finished_runs(found))
    return retention.new_failures(failed, t["fx_failed"]).select("aws_id", "pipeline_id")


@check(
    "j6_runs_in_ids",
    """SELECT aws_id, pipeline_id FROM {fx_runs}
       WHERE in_console AND aws_id IN (SELECT aws_id FROM {fx_failed})""",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged.runs_in_ids(t["fx_runs"], t["fx_failed"]).select("aws_id", "pipeline_id")


@check(
    "j7_with_failure_count",
    """SELECT p.id, COALESCE(c.failure_count, 0) AS failure_count
       FROM {fx_pipelines} p LEFT JOIN {fx_counters} c ON c.pipeline_id = p.id""",
)
def _(t: Inputs) -> DataFrame:
    counted = schedule.with_failure_count(t["fx_pipelines"], t["fx_counters"])
    return counted.select("id", "failure_count")


def activated(t: Inputs) -> tuple[DataFrame, DataFrame]:
    return schedule.activated_runs(
        t["fx_deployed"], t["fx_names"], t["fx_activations"], ts(TICK_START), ts(TICK_END)
    )


@check(
    "j8_activated_runs",
    f"""SELECT n.aws_id, d.pipeline_id, d.pipeline_name,
               TIMESTAMP '{TICK_START}' AS scheduled_start, TIMESTAMP '{TICK_END}' AS actual_start,
               d.deployed_time, CASE WHEN a.activated THEN 'success' ELSE 'fail' END AS status,
               TRUE AS in_console
        FROM {{fx_deployed}} d JOIN {{fx_names}} n ON n.pipeline_name = d.pipeline_name
        LEFT JOIN {{fx_activations}} a ON a.pipeline_name = d.pipeline_name""",
)
def _(t: Inputs) -> DataFrame:
    return activated(t)[0]


@check(
    "j8_names_not_found",
    """SELECT pipeline_id, pipeline_name,
              'pipeline with name ' || pipeline_name || ' not found' AS error
       FROM {fx_deployed} WHERE pipeline_name NOT IN (SELECT pipeline_name FROM {fx_names})""",
)
def _(t: Inputs) -> DataFrame:
    return activated(t)[1]


@check(
    "j9_jar_manifest",
    f"""SELECT d.jar, l.location FROM (SELECT DISTINCT jar FROM {{fx_pipelines}} WHERE {DUE}) d
        LEFT JOIN {{fx_locations}} l ON l.jar = d.jar""",
)
def _(t: Inputs) -> DataFrame:
    due = schedule.due_pipelines(t["fx_pipelines"], ts(TICK_END))
    return schedule.jar_manifest(due, t["fx_locations"])


@check(
    "j10_match_by_name_or_class",
    """SELECT s.request_id, s.pipeline_object, count(p.id) AS match_count
       FROM {fx_submissions} s LEFT JOIN (
           SELECT id, name AS obj FROM {fx_pipelines}
           UNION SELECT id, class_name AS obj FROM {fx_pipelines}) p
         ON p.obj = s.pipeline_object
       GROUP BY s.request_id, s.pipeline_object""",
)
def _(t: Inputs) -> DataFrame:
    return submissions.match_by_name_or_class(t["fx_submissions"], t["fx_pipelines"])


# --- aggregations --------------------------------------------------------------------------


@check(
    "a1_fleet_counts",
    f"""SELECT (SELECT count(*) FROM {{fx_pipelines}} WHERE is_active) AS active_pipelines,
               (SELECT count(*) FROM {{fx_pipelines}} WHERE {DUE}) AS due_pipelines,
               (SELECT count(*) FROM {{fx_runs}} WHERE in_console) AS in_console_runs,
               (SELECT count(*) FROM {{fx_status}}) AS total_inventory""",
)
def _(t: Inputs) -> DataFrame:
    ids = inventory.load_inventory(listing_pages(t))
    return counts.fleet_counts(t.catalog(), ids, ts(TICK_END))


@check("a2_distinct_managed_ids", "SELECT DISTINCT aws_id FROM {fx_runs} WHERE in_console")
def _(t: Inputs) -> DataFrame:
    return unmanaged.distinct_managed_ids(t["fx_runs"])


BY_STATE = """SELECT COALESCE(pipeline_state, 'Unknown') AS state, count(*) AS entries
    FROM {{fx_status}} {0} GROUP BY 1 ORDER BY entries DESC, state"""
BY_DATE = """SELECT COALESCE(split_part(creation_time, 'T', 1), 'Unknown') AS created_on,
    count(*) AS entries FROM {{fx_status}} {0} GROUP BY 1 ORDER BY created_on DESC"""


@check("a3_count_by_state", BY_STATE.format(""))
def _(t: Inputs) -> DataFrame:
    return unmanaged.count_by_state(t["fx_status"])


@check("a4_count_by_date", BY_DATE.format(""))
def _(t: Inputs) -> DataFrame:
    return unmanaged.count_by_date(t["fx_status"])


@check(
    "a5_cleanup_report",
    """SELECT r.pipeline_id, count(*) AS in_console, count(s.aws_id) AS in_inventory,
              count(*) FILTER (s.aws_id IS NULL) AS vanished,
              count(*) FILTER (s.pipeline_state = 'FINISHED') AS finished,
              count(*) FILTER (s.pipeline_state = 'FINISHED' AND s.health_status = 'ERROR')
                  AS failed,
              count(*) FILTER (s.pipeline_state = 'FINISHED'
                               AND s.health_status IS DISTINCT FROM 'ERROR') AS healthy
       FROM {fx_runs} r LEFT JOIN {fx_status} s ON s.aws_id = r.aws_id
       WHERE r.in_console GROUP BY r.pipeline_id""",
)
def _(t: Inputs) -> DataFrame:
    return retention.cleanup_report(t["fx_runs"], t["fx_status"])


RANKED = """
    SELECT r.aws_id, r.pipeline_id, p.retention, s.health_status IS NOT DISTINCT FROM 'ERROR'
               AS failed,
           dense_rank() OVER (
               PARTITION BY r.pipeline_id, s.health_status IS NOT DISTINCT FROM 'ERROR'
               ORDER BY r.actual_start DESC) AS rnk
    FROM {{fx_runs}} r JOIN {{fx_status}} s ON s.aws_id = r.aws_id
    JOIN {{fx_pipelines}} p ON p.id = r.pipeline_id
    WHERE s.pipeline_state = 'FINISHED' {0}"""


@check(
    "a6_deleted_count",
    f"""WITH ranked AS ({RANKED.format("AND r.in_console")})
        SELECT count(*) AS pipeline_deleted FROM ranked WHERE NOT failed AND rnk > retention""",
)
def _(t: Inputs) -> DataFrame:
    found = retention.runs_with_status(
        retention.in_console_runs(t["fx_runs"]), t["fx_status"]
    )
    actions = retention.judge_finished(retention.finished_runs(found), t["fx_pipelines"])
    return retention.deleted_count(actions)


@check(
    "a7_scheduler_run_times",
    """SELECT start_time, pipeline_count, end_time,
              CAST(date_diff('microsecond', start_time, end_time) AS DOUBLE) / 1000000
                  AS duration_seconds
       FROM {fx_scheduler_metrics}""",
)
def _(t: Inputs) -> DataFrame:
    return counts.scheduler_run_times(t["fx_scheduler_metrics"])


@check(
    "a7_scheduler_run_stats",
    """SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS run_date, count(*) AS runs,
              count(end_time) AS finished_runs, CAST(sum(pipeline_count) AS BIGINT) AS pipelines,
              min(d) AS shortest_seconds, round(avg(d), 9) AS average_seconds,
              max(d) AS longest_seconds
       FROM (SELECT *, CAST(date_diff('microsecond', start_time, end_time) AS DOUBLE) / 1000000
                 AS d FROM {fx_scheduler_metrics}) AS timed
       GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    stats = counts.scheduler_run_stats(t["fx_scheduler_metrics"])
    return stats.withColumns(
        {
            "run_date": F.col("run_date").cast("string"),
            "average_seconds": F.round("average_seconds", DIGITS),
        }
    )


@check(
    "a8_metric_gauges",
    """SELECT kind, metric, TRY_CAST(last AS DOUBLE) AS value
       FROM (SELECT kind, metric, arg_max(reading, (ts, event_id)) AS last
             FROM {fx_samples} WHERE kind = 'gauge' GROUP BY kind, metric) AS g
       WHERE TRY_CAST(last AS DOUBLE) IS NOT NULL""",
)
def _(t: Inputs) -> DataFrame:
    return metrics.metric_gauges(t["fx_samples"], "reading")


@check(
    "a9_metric_counts",
    "SELECT kind, metric, count(*) AS count FROM {fx_samples} GROUP BY kind, metric",
)
def _(t: Inputs) -> DataFrame:
    return metrics.metric_counts(t["fx_samples"])


@check(
    "a9_metric_counts_since",
    """SELECT s.kind, s.metric, count(*) - COALESCE(max(r.count), 0) AS count
       FROM {fx_samples} s LEFT JOIN {fx_reported} r ON r.kind = s.kind AND r.metric = s.metric
       GROUP BY s.kind, s.metric""",
)
def _(t: Inputs) -> DataFrame:
    return metrics.metric_counts(t["fx_samples"], t["fx_reported"])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


@check(
    "a10_metric_statistic_set",
    """SELECT kind, metric, round(sum(value) * 0.001, 9) AS sum,
              CAST(count(value) AS DOUBLE) AS sample_count,
              round(min(value) * 0.001, 9) AS minimum, round(max(value) * 0.001, 9) AS maximum
       FROM {fx_samples} GROUP BY kind, metric""",
)
def _(t: Inputs) -> DataFrame:
    stats = metrics.metric_statistic_set(t["fx_samples"], 0.001)
    return rounded(stats, "sum", "minimum", "maximum")


@check(
    "a11_metric_moments",
    """SELECT kind, metric, round(avg(value), 9) AS mean,
              round(COALESCE(stddev_samp(value), 0), 9) AS std_dev
       FROM {fx_samples} GROUP BY kind, metric""",
)
def _(t: Inputs) -> DataFrame:
    return rounded(metrics.metric_moments(t["fx_samples"]), "mean", "std_dev")


ALL_PERCENTILES = tuple(metrics.PERCENTILES)


@check(
    "a12_metric_percentiles",
    "\nUNION ALL\n".join(
        f"""SELECT kind, metric, '{label}' AS percentile,
                   round(quantile_cont(value, {q}), 9) AS value
            FROM {{fx_samples}} GROUP BY kind, metric"""
        for q, label in metrics.PERCENTILES.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    return rounded(metrics.metric_percentiles(t["fx_samples"], ALL_PERCENTILES), "value")


@check(
    "a12_sketch_percentiles",
    "\nUNION ALL\n".join(
        f"""SELECT kind, metric, '{label}' AS percentile, count(*) AS n, TRUE AS within_bound
            FROM {{fx_samples}} WHERE value IS NOT NULL GROUP BY kind, metric"""
        for label in metrics.PERCENTILES.values()
    ),
)
def _(t: Inputs) -> DataFrame:
    """Stored sketches of hours, merged over all days: ranks of what they tell, by the samples."""
    path = scratch_path(t.spark, "sketches")
    sketches.save_sketches(sketches.interval_sketches(t["fx_samples"]), path)
    stored = sketches.load_sketches(t.spark, path, "0001-01-01", "9999-12-31")
    told = sketches.sketch_percentiles(stored, ALL_PERCENTILES).withColumnRenamed("value", "told")
    known = t["fx_samples"].where("value IS NOT NULL").select(*metrics.METRIC, "value")
    share = F.element_at(
        F.create_map(*[F.lit(x) for q, p in metrics.PERCENTILES.items() for x in (p, q)]), F.col("percentile")
    )
    ranks = known.join(told, metrics.METRIC).groupBy(*metrics.METRIC, "percentile").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("value") < F.col("told")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("told")).cast("int")).alias("upto"),
    )
    error = sketches.RANK_ERROR
    within = (share >= F.col("below") - error) & (share <= F.col("upto") + error)
    return ranks.select(*metrics.METRIC, "percentile", "n", within.alias("within_bound"))


@check(
    "a13_metric_mean_rate",
    f"""SELECT kind, metric, round(count(*) * 1000000.0 * 60
              / date_diff('microsecond', min(ts), TIMESTAMP '{AS_OF}'), 9) AS mean_rate
        FROM {{fx_samples}} WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY kind, metric""",
)
def _(t: Inputs) -> DataFrame:
    return rounded(metrics.metric_mean_rate(t["fx_samples"], ts(AS_OF), 60), "mean_rate")


EWMA_TICKS = f"""
    SELECT kind, metric, tick, count(*) AS n, min(tick) OVER (PARTITION BY kind, metric) AS first,
           CAST(floor(epoch(TIMESTAMP '{AS_OF}') / 5) AS BIGINT) - 1 - tick AS age
    FROM (SELECT kind, metric, CAST(floor(epoch(ts) / 5) AS BIGINT) AS tick FROM {{fx_samples}}
          WHERE ts <= TIMESTAMP '{AS_OF}') AS placed
    GROUP BY kind, metric, tick"""


def ewma_sql(minutes: int, unit_seconds: float) -> str:
    keep = f"exp(-5.0 / (60 * {minutes}))"
    return f"""COALESCE(sum(CASE WHEN age >= 0 THEN
        (CASE WHEN tick = first THEN 1 ELSE 1 - {keep} END) * pow({keep}, age) * n END), 0)
        * {unit_seconds} / 5"""


@check(
    "a14_metric_ewma_rates",
    f"""SELECT kind, metric, round({ewma_sql(1, 60)}, 9) AS rate_1m,
               round({ewma_sql(5, 60)}, 9) AS rate_5m, round({ewma_sql(15, 60)}, 9) AS rate_15m
        FROM ({EWMA_TICKS}) AS ticks GROUP BY kind, metric""",
)
def _(t: Inputs) -> DataFrame:
    rates = metrics.metric_ewma_rates(t["fx_samples"], ts(AS_OF), unit_seconds=60)
    return rounded(rates, "rate_1m", "rate_5m", "rate_15m")


# --- windows, top-k, sets ------------------------------------------------------------------


@check(
    "w1_retention_healthy",
    f"""WITH ranked AS ({RANKED.format("")})
        SELECT aws_id, pipeline_id, 'delete_healthy' AS action FROM ranked
        WHERE NOT failed AND rnk > retention""",
)
def _(t: Inputs) -> DataFrame:
    found = retention.runs_with_status(t["fx_runs"], t["fx_status"])
    _, healthy = retention.split_by_health(retention.finished_runs(found))
    return retention.retention_healthy(healthy, t["fx_pipelines"])


@check(
    "w2_retention_failed",
    f"""WITH ranked AS ({RANKED.format("")})
        SELECT aws_id, pipeline_id,
               CASE WHEN rnk > retention THEN 'delete_failed' ELSE 'keep_failed' END AS action
        FROM ranked WHERE failed""",
)
def _(t: Inputs) -> DataFrame:
    found = retention.runs_with_status(t["fx_runs"], t["fx_status"])
    failed, _ = retention.split_by_health(retention.finished_runs(found))
    return retention.retention_failed(failed, t["fx_pipelines"])


@check(
    "w3_counter_deltas",
    """SELECT kind, metric, report_time, value, value - COALESCE(
              lag(value) OVER (PARTITION BY kind, metric ORDER BY report_time), 0) AS delta
       FROM {fx_reports}""",
)
def _(t: Inputs) -> DataFrame:
    return metrics.counter_deltas(t["fx_reports"])


STREAKS = """
    WITH numbered AS (
        SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END)
                      OVER (PARTITION BY pipeline_id ORDER BY attempt_time, attempt_id) AS streak
        FROM {fx_attempts}), placed AS (
        SELECT n.*, sum(CASE WHEN ok THEN 0 ELSE 1 END)
                        OVER (PARTITION BY n.pipeline_id, streak ORDER BY attempt_time, attempt_id)
                    + CASE WHEN streak = 0 THEN COALESCE(c.failure_count, 0) ELSE 0 END AS f
        FROM numbered n LEFT JOIN {fx_counters} c ON c.pipeline_id = n.pipeline_id)
    SELECT attempt_id, pipeline_id, attempt_time, ok, log,
           CASE WHEN NOT ok THEN CAST(least(f, 4) AS BIGINT) END AS failure_number,
           CAST(CASE WHEN ok THEN 0 ELSE least(f, 3) END AS INT) AS counter,
           CASE WHEN ok THEN 'cleared' WHEN f > 3 THEN 'deactivated'
                ELSE 'failed_to_schedule' END AS event
    FROM placed"""


@check("w4_failure_streaks", STREAKS)
def _(t: Inputs) -> DataFrame:
    return streaks.failure_streaks(t["fx_attempts"], t["fx_counters"])


@check(
    "o1_take_due",
    f"""SELECT id, next_run_time FROM {{fx_pipelines}} WHERE {DUE}
        ORDER BY next_run_time, id LIMIT 60""",
)
def _(t: Inputs) -> DataFrame:
    return schedule.take_due(t["fx_pipelines"], ts(TICK_END)).select("id", "next_run_time")


@check(
    "o1_take_due_many",
    f"""SELECT id, next_run_time FROM {{fx_pipelines}} WHERE {DUE}
        ORDER BY next_run_time, id LIMIT 1200""",
)
def _(t: Inputs) -> DataFrame:
    taken = schedule.take_due(t["fx_pipelines"], ts(TICK_END), max_pipelines=1200)
    return taken.select("id", "next_run_time")


@check(
    "o1_take_due_cut",
    """SELECT o_orderkey AS id, o_orderdate AS next_run_time FROM {orders}
       ORDER BY o_orderdate, o_orderkey LIMIT 1200""",
)
def _(t: Inputs) -> DataFrame:
    waiting = t["orders"].select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("next_run_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit(True).alias("is_active"),
    )
    taken = schedule.take_due(waiting, ts(AS_OF), max_pipelines=1200)
    return taken.select("id", "next_run_time")


@check(
    "o2_latest_starts",
    """SELECT pipeline_id, actual_start, run_count, start_rank FROM (
           SELECT pipeline_id, actual_start, count(*) AS run_count,
                  row_number() OVER (PARTITION BY pipeline_id ORDER BY actual_start DESC)
                       AS start_rank
           FROM {fx_runs} GROUP BY pipeline_id, actual_start) AS ranked
       WHERE start_rank <= 3""",
)
def _(t: Inputs) -> DataFrame:
    return retention.latest_starts(t["fx_runs"], 3)


@check(
    "u2_id_difference",
    "SELECT aws_id FROM {fx_status} EXCEPT SELECT aws_id FROM {fx_runs} WHERE in_console",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged.id_difference(t["fx_status"], retention.in_console_runs(t["fx_runs"]))


# --- dates and times -----------------------------------------------------------------------


@check(
    "t1_parse_periods",
    r"""WITH parts AS (
            SELECT id, period,
                   TRY_CAST(regexp_extract(lower(period),
                       '^ *(\d+) +(year|month|week|day|hour|minute)s? *$', 1) AS HUGEINT) AS n,
                   regexp_extract(lower(period),
                       '^ *(\d+) +(year|month|week|day|hour|minute)s? *$', 2) AS unit
            FROM {fx_periods})
        SELECT id, period, CAST(months AS INT) AS period_months,
               CAST(micros AS BIGINT) AS period_micros,
               months IS NOT NULL OR micros IS NOT NULL AS usable
        FROM (SELECT id, period, CASE WHEN m <= 3360000 THEN m END AS months,
                     CASE WHEN u <= 280000 * 365 * 86400000000::HUGEINT THEN u END AS micros
              FROM (SELECT *, CASE WHEN n > 0 THEN CASE unit WHEN 'year' THEN n * 12
                               WHEN 'month' THEN n END END AS m,
                           CASE WHEN n > 0 THEN CASE unit WHEN 'week' THEN n * 604800000000
                               WHEN 'day' THEN n * 86400000000 WHEN 'hour' THEN n * 3600000000
                               WHEN 'minute' THEN n * 60000000 END END AS u
                    FROM parts))""",
)
def _(t: Inputs) -> DataFrame:
    usable, rejected = schedule.parse_periods(t["fx_periods"])
    return usable.withColumn("usable", F.lit(True)).unionByName(
        rejected.withColumn("usable", F.lit(False)), allowMissingColumns=True
    )


def parsed(t: Inputs) -> DataFrame:
    return schedule.parse_periods(t["fx_pipelines"])[0]


@check(
    "t2_run_counts",
    f"""SELECT id, CASE WHEN start_time < TIMESTAMP '{TICK_END}'
                        THEN len(range(start_time, TIMESTAMP '{TICK_END}', {STEP}))
                        WHEN start_time >= TIMESTAMP '{TICK_END}' THEN 0 END AS run_count
        FROM {{fx_pipelines}}""",
)
def _(t: Inputs) -> DataFrame:
    return schedule.run_counts(parsed(t), "start_time", ts(TICK_END)).select("id", "run_count")


@check(
    "t3_advance_next_run",
    f"""SELECT id, {forward("next_run_time", f"TIMESTAMP '{TICK_END}'")} AS advanced
        FROM {{fx_pipelines}}""",
)
def _(t: Inputs) -> DataFrame:
    return schedule.advance_next_run(parsed(t), "next_run_time", ts(TICK_END)).select(
        "id", "advanced"
    )


@check(
    "t4_previous_run",
    f"""SELECT id, {backward("next_run_time", f"TIMESTAMP '{BACK_TO}'")} AS previous
        FROM {{fx_pipelines}}""",
)
def _(t: Inputs) -> DataFrame:
    return schedule.previous_run(parsed(t), "next_run_time", ts(BACK_TO)).select("id", "previous")


def plan(t: Inputs) -> DataFrame:
    due = schedule.due_pipelines(parsed(t), ts(TICK_END))
    return schedule.backfill_plan(due, ts(TICK_END), ts(TICK_END), PREFIX)


PLAN = f"""
    SELECT id AS pipeline_id,
           '{PREFIX}' || strftime(TIMESTAMP '{TICK_END}', '%Y-%m-%dT%H:%M:%SZ') || '_' || id
               || '_' || class_name AS deployment_name,
           class_name, jar, next_run_time AS first_run,
           least(TIMESTAMP '{TICK_END}', end_time) AS until,
           greatest(1, CASE WHEN backfill THEN len(range(next_run_time,
               least(TIMESTAMP '{TICK_END}', end_time), {STEP})) ELSE 1 END) AS times,
           period AS every
    FROM ({{0}}) AS due"""
ALL_DUE = f"SELECT * FROM {{fx_pipelines}} WHERE {DUE}"
PLAN_COLUMNS = (
    "pipeline_id deployment_name class_name jar first_run until times every".split()
)


@check("t5_backfill_plan", PLAN.replace("{0}", ALL_DUE))
def _(t: Inputs) -> DataFrame:
    return plan(t).select(*PLAN_COLUMNS)


@check(
    "t6_expand_runs",
    f"""WITH plan AS ({PLAN.replace("{0}", ALL_DUE)}), listed AS (
            SELECT pipeline_id, CASE WHEN times > 1 THEN range(first_run, until, iv)
                                     ELSE [first_run] END AS instants
            FROM (SELECT *, {STEP.replace("period", "every")} AS iv FROM plan) AS p)
        SELECT pipeline_id, CAST(unnest(generate_series(0, len(instants) - 1)) AS BIGINT)
                   AS run_number,
               unnest(instants) AS run_time
        FROM listed""",
)
def _(t: Inputs) -> DataFrame:
    return schedule.expand_runs(plan(t))


@check(
    "t7_tick_windows",
    """SELECT event_id, ts, date_trunc('hour', ts) AS tick_start,
              date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick_end,
              date_trunc('hour', ts + INTERVAL 1 HOUR) AS next_whole_hour
       FROM {events}""",
)
def _(t: Inputs) -> DataFrame:
    return schedule.tick_windows(t["events"].select("event_id", "ts"), "ts")


OFFSET_TEXT = """
    SELECT event_id,
           concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 'T', lpad(CAST(extract(HOUR FROM ts)
                  AS VARCHAR(2)), 2, '0'), ':15:30',
                  CASE user_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-05:30'
                       WHEN 3 THEN '' ELSE 'Q' END) AS stamp
    FROM {events}"""


def offset_texts(t: Inputs) -> DataFrame:
    return t.spark.sql(OFFSET_TEXT, events=t["events"])


@check(
    "t8_normalize_timestamps",
    f"""WITH stamps AS ({OFFSET_TEXT}), read AS (
            SELECT event_id, stamp, CASE right(stamp, 1) WHEN 'Z' THEN 0 ELSE
                       CASE substr(stamp, 20) WHEN '+02:00' THEN -120
                            WHEN '-05:30' THEN 330 END END AS shift,
                   CAST(substr(stamp, 1, 19) AS TIMESTAMP) AS local
            FROM stamps)
        SELECT event_id, stamp, local + INTERVAL 1 MINUTE * shift AS stamp_utc,
               strftime(local + INTERVAL 1 MINUTE * shift, '%Y-%m-%dT%H:%M:%SZ') AS stamp_text
        FROM read""",
)
def _(t: Inputs) -> DataFrame:
    good, bad = schedule.normalize_timestamps(offset_texts(t), ["stamp"])
    return good.unionByName(bad, allowMissingColumns=True)


# --- texts and data points -----------------------------------------------------------------


@check(
    "n1_deployment_names",
    f"""SELECT id, '{PREFIX}' || strftime(TIMESTAMP '{TICK_END}', '%Y-%m-%dT%H:%M:%SZ') || '_'
                   || id || '_' || class_name AS deployment_name
        FROM {{fx_pipelines}}""",
)
def _(t: Inputs) -> DataFrame:
    named = schedule.deployment_names(t["fx_pipelines"], ts(TICK_END), PREFIX)
    return named.select("id", "deployment_name")


# Each pipeline's last attempt as an event to be told about.
EVENTS = f"""
    SELECT pipeline_id, arg_max(event, (attempt_time, attempt_id)) AS event,
           CAST(arg_max(failure_number, (attempt_time, attempt_id)) AS BIGINT) AS failure_number,
           arg_max(log, (attempt_time, attempt_id)) AS log
    FROM ({STREAKS}) AS s WHERE NOT ok GROUP BY pipeline_id
    UNION ALL SELECT id, 'cleanup_failed', NULL, name FROM {{fx_pipelines}}"""
ROUTED = f"""
    SELECT e.*, p.name AS pipeline_name, p.owner,
           CASE WHEN p.owner IS NULL OR p.owner LIKE '%@%' THEN 'email'
                WHEN p.owner LIKE 'arn:aws:sns:%' THEN 'sns' ELSE 'invalid' END AS medium,
           CASE WHEN p.owner IS NULL THEN 'fleet@example.com,night@example.com'
                WHEN p.owner LIKE '%@%' OR p.owner LIKE 'arn:aws:sns:%' THEN p.owner END
               AS recipients
    FROM ({EVENTS}) AS e JOIN {{fx_pipelines}} p ON p.id = e.pipeline_id"""


def events_to_route(t: Inputs) -> DataFrame:
    placed = streaks.failure_streaks(t["fx_attempts"], t["fx_counters"]).where("NOT ok")
    last = F.struct("attempt_time", "attempt_id")
    events = placed.groupBy("pipeline_id").agg(
        *[F.max_by(c, last).alias(c) for c in ("event", "failure_number", "log")]
    )
    cleanups = t["fx_pipelines"].select(
        F.col("id").alias("pipeline_id"),
        F.lit(notifications.CLEANUP_FAILED).alias("event"),
        F.lit(None).cast("bigint").alias("failure_number"),
        F.col("name").alias("log"),
    )
    return events.unionByName(cleanups)


def routed(t: Inputs, events: DataFrame | None = None) -> DataFrame:
    events = events_to_route(t) if events is None else events
    return notifications.route_notifications(events, t["fx_pipelines"], DEFAULT_MAILS)


@check(
    "n2_route_notifications",
    f"""WITH known AS ({ROUTED})
        SELECT * FROM known UNION ALL
        SELECT * REPLACE (-1 - pipeline_id AS pipeline_id, NULL AS pipeline_name, NULL AS owner,
                          'invalid' AS medium, NULL AS recipients) FROM known""",
)
def _(t: Inputs) -> DataFrame:
    """Every event a second time, of a pipeline that is not in the table."""
    events = events_to_route(t)
    unknown = events.withColumn("pipeline_id", -1 - F.col("pipeline_id"))
    return routed(t, events.unionByName(unknown))


@check(
    "n3_notification_messages",
    f"""WITH told AS (
            SELECT pipeline_id, event, medium,
                   CASE event WHEN 'failed_to_schedule' THEN
                            '[ACTION NEEDED] (sp_) Pipeline ' || pipeline_name
                            || ' failed to schedule (' || failure_number || '/3)'
                        WHEN 'deactivated' THEN '[ACTION NEEDED] (sp_) Pipeline '
                            || pipeline_name
                            || ' has been deactivated due to scheduling failure'
                        ELSE '[Fleet Cleanup Failure] (sp_) cleanup activity failed for '
                            || pipeline_name END AS subject,
                   CASE event WHEN 'failed_to_schedule' THEN
                       'It will be deactivated after the number of schedule failures reach 3'
                       || chr(10) || chr(10) || log ELSE log END AS body
            FROM ({ROUTED}) AS r)
        SELECT *, CASE WHEN medium = 'sns' THEN subject || ' - ' || body END AS topic_text
        FROM told""",
)
def _(t: Inputs) -> DataFrame:
    messages = notifications.notification_messages(routed(t), PREFIX, SERVICE)
    return messages.select("pipeline_id", "event", "medium", "subject", "body", "topic_text")


METRIC_NAMES = """
    SELECT event_id,
           CASE WHEN value > 100 THEN concat('old ', event_type, '.x[a: b , c:', user_id,
                                             ',a:', user_id, ':9,d]')
                WHEN value < 5 THEN event_type
                ELSE concat(event_type, '[user:', user_id, ',src:test]') END AS metric
    FROM {events}"""


def dimensions_text(column: str = "dimensions"):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@check(
    "n5_decode_dimensions",
    rf"""WITH names AS ({METRIC_NAMES}), parts AS (
             SELECT event_id, p, generate_subscripts(list, 1) AS i FROM (
                 SELECT event_id, unnest(list) AS p, list FROM (
                     SELECT event_id, string_split(regexp_extract(metric, '\[(.+)\]', 1), ',')
                         AS list FROM names WHERE metric LIKE '%[%') AS s) AS u),
         numbered AS (
             SELECT event_id, trim(split_part(p, ':', 1)) AS k, trim(split_part(p, ':', 2)) AS v,
                    row_number() OVER () AS i
             FROM (SELECT event_id, unnest(string_split(
                       regexp_extract(metric, '\[(.+)\]', 1), ',')) AS p
                   FROM names WHERE metric LIKE '%[%') AS u
             WHERE p LIKE '%:%'),
         kept AS (
             SELECT event_id, k, arg_max(v, i) AS v FROM numbered GROUP BY event_id, k)
         SELECT n.event_id, n.metric,
                CASE WHEN n.metric LIKE '%[%'
                     THEN regexp_extract(n.metric, '([A-Za-z0-9_.-]+)\[', 1)
                     ELSE n.metric END AS metric_name,
                COALESCE((SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM kept
                          WHERE kept.event_id = n.event_id), '') AS dimension_text
         FROM names n""",
)
def _(t: Inputs) -> DataFrame:
    names = t.spark.sql(METRIC_NAMES, events=t["events"])
    decoded = datums.decode_dimensions(names)
    return decoded.withColumn("dimension_text", dimensions_text()).drop("dimensions")


@check(
    "n6_global_dimensions",
    r"""SELECT event_id, kind AS datum_type, 'Environment=test,Stack=main,Type=' || kind
               || ',src=test,user=' || regexp_extract(metric, 'user:(\d+)', 1) AS dimension_text
        FROM {fx_samples}""",
)
def _(t: Inputs) -> DataFrame:
    typed = t["fx_samples"].select("event_id", "metric", F.col("kind").alias("datum_type"))
    merged = datums.global_dimensions(datums.decode_dimensions(typed), GLOBAL_DIMENSIONS)
    return merged.select("event_id", "datum_type", dimensions_text().alias("dimension_text"))


EXTREMES = """
    SELECT event_id, CASE event_type WHEN 'view' THEN value * 1e-120 WHEN 'click' THEN value * 1e110
                          WHEN 'error' THEN -value * 1e-115
                          WHEN 'signup' THEN CASE WHEN value > 50 THEN -value * 1e120
                                                  WHEN value > 20 THEN CAST('NaN' AS DOUBLE)
                                                  WHEN value > 10 THEN CAST('Infinity' AS DOUBLE)
                                                  ELSE 0.0 END
                          ELSE value END AS value
    FROM {events}"""


@check(
    "n7_clean_values",
    f"""SELECT event_id, CASE WHEN value = 0 THEN 0.0 ELSE sign(value) *
                   greatest(8.515920e-109, least(1.174271e108, abs(value))) END AS value
        FROM ({EXTREMES}) AS e WHERE NOT isnan(value) AND NOT isinf(value)""",
)
def _(t: Inputs) -> DataFrame:
    return datums.clean_values(t.spark.sql(EXTREMES, events=t["events"]))


def figures_sql(factor: float) -> str:
    scale = f"(CASE kind WHEN 'timer' THEN {factor} ELSE 1.0 END)"
    return f"""
        known AS (SELECT * FROM {{fx_samples}} WHERE ts <= TIMESTAMP '{AS_OF}'),
        base AS (
            SELECT kind, metric, arg_max(value, (ts, event_id)) AS gauge,
                   CAST(count(*) AS DOUBLE) AS n, sum(value) * {scale} AS total,
                   min(value) * {scale} AS low, max(value) * {scale} AS high,
                   avg(value) * {scale} AS mean,
                   COALESCE(stddev_samp(value), 0) * {scale} AS deviation,
                   quantile_cont(value, 0.75) * {scale} AS p75,
                   quantile_cont(value, 0.95) * {scale} AS p95,
                   quantile_cont(value, 0.99) * {scale} AS p99,
                   quantile_cont(value, 0.999) * {scale} AS p999,
                   count(*) * 1000000.0
                       / date_diff('microsecond', min(ts), TIMESTAMP '{AS_OF}') AS mean_rate
            FROM known GROUP BY kind, metric),
        rates AS (
            SELECT kind, metric, {ewma_sql(1, 1)} AS r1, {ewma_sql(5, 1)} AS r5,
                   {ewma_sql(15, 1)} AS r15
            FROM ({EWMA_TICKS}) AS ticks GROUP BY kind, metric),
        figures AS (
            SELECT b.*, r.r1, r.r5, r.r15,
                   CASE b.kind WHEN 'gauge' THEN 1 WHEN 'counter' THEN 2 WHEN 'histogram' THEN 3
                        WHEN 'meter' THEN 4 ELSE 5 END AS kind_rank,
                   CASE b.kind WHEN 'timer' THEN 'Milliseconds' ELSE 'None' END AS value_unit,
                   CASE b.kind WHEN 'timer' THEN ' [in-milliseconds]' ELSE '' END AS suffix
            FROM base b LEFT JOIN rates r ON r.kind = b.kind AND r.metric = b.metric)"""


def point_sql(rank: int, where: str, label: str, value: str, unit: str) -> str:
    return f"""SELECT kind_rank, kind, metric, {rank} AS datum_rank, {label} AS datum_type,
        {value} AS value, CAST(NULL AS DOUBLE) AS stat_sum, CAST(NULL AS DOUBLE) AS stat_count,
        CAST(NULL AS DOUBLE) AS stat_min, CAST(NULL AS DOUBLE) AS stat_max, {unit} AS unit
        FROM figures WHERE {where}"""


def summary_sql(rank: int) -> str:
    return f"""SELECT kind_rank, kind, metric, {rank}, 'snapshot-summary', NULL, total, n, low,
        high, value_unit FROM figures WHERE {SAMPLED}"""


SAMPLED = "kind IN ('histogram', 'timer')"
RATED = "kind IN ('meter', 'timer')"
SPARSE_POINTS = "\nUNION ALL\n".join(
    [
        point_sql(0, "kind = 'gauge' AND gauge > 0", "'gauge'", "gauge", "'None'"),
        point_sql(1, f"{SAMPLED} AND p75 > 0", "'75%'", "p75", "value_unit"),
        point_sql(2, f"{SAMPLED} AND p95 > 0", "'95%'", "p95", "value_unit"),
        point_sql(3, f"{SAMPLED} AND p999 > 0", "'99.9%'", "p999", "value_unit"),
        point_sql(4, f"{SAMPLED} AND mean > 0", "'snapshot-mean' || suffix", "mean", "value_unit"),
        summary_sql(5),
        point_sql(6, "kind <> 'gauge' AND since > 0", "'count'", "since", "'Count'"),
    ]
)
SERVICE_POINTS = "\nUNION ALL\n".join(
    [
        point_sql(0, "kind = 'gauge'", "'gauge'", "gauge", "'None'"),
        point_sql(1, SAMPLED, "'75%'", "p75", "value_unit"),
        point_sql(2, SAMPLED, "'99%'", "p99", "value_unit"),
        point_sql(3, SAMPLED, "'snapshot-mean' || suffix", "mean", "value_unit"),
        point_sql(4, SAMPLED, "'snapshot-std-dev' || suffix", "deviation", "value_unit"),
        summary_sql(5),
        point_sql(6, RATED, "'1-min-mean-rate [per-second]'", "r1", "'Bytes'"),
        point_sql(7, RATED, "'5-min-mean-rate [per-second]'", "r5", "'Bytes'"),
        point_sql(8, RATED, "'15-min-mean-rate [per-second]'", "r15", "'Bytes'"),
        point_sql(9, RATED, "'mean-rate [per-second]'", "mean_rate", "'Bytes'"),
        point_sql(10, "kind <> 'gauge'", "'count'", "n", "'Count'"),
    ]
)
POINT_VALUES = """round(value, 9) AS value, round(stat_sum, 9) AS stat_sum, stat_count,
    round(stat_min, 9) AS stat_min, round(stat_max, 9) AS stat_max"""


def point_values(df: DataFrame) -> DataFrame:
    stat = F.col("statistics")
    return df.withColumns(
        {
            "value": F.round("value", DIGITS),
            "stat_sum": F.round(stat["sum"], DIGITS),
            "stat_count": stat["sample_count"],
            "stat_min": F.round(stat["minimum"], DIGITS),
            "stat_max": F.round(stat["maximum"], DIGITS),
        }
    ).drop("statistics")


@check(
    "n8_stage_datums",
    f"""WITH {figures_sql(0.5).replace("figures AS (", "complete AS (")},
             figures AS (
                 SELECT c.*, c.n - COALESCE(p.count, 0) AS since FROM complete c
                 LEFT JOIN {{fx_reported}} p ON p.kind = c.kind AND p.metric = c.metric),
             points AS ({SPARSE_POINTS})
        SELECT kind, metric, datum_type, {POINT_VALUES}, unit, 60 AS resolution FROM points""",
)
def _(t: Inputs) -> DataFrame:
    figures = metric_report.metric_figures(
        t["fx_samples"], ts(AS_OF), SPARSE_REPORT, t["fx_reported"]
    )
    staged = datums.stage_datums(figures, SPARSE_REPORT, ts(AS_OF))
    return point_values(staged).drop("ts", "kind_rank", "datum_rank")


def service_datums(t: Inputs) -> DataFrame:
    figures = metric_report.metric_figures(t["fx_samples"], ts(AS_OF), REPORT)
    return datums.stage_datums(figures, REPORT, ts(AS_OF))


NUMBERED = "row_number() OVER (ORDER BY kind_rank, metric, datum_rank) - 1"


@check(
    "n9_batch_datums",
    f"""WITH {figures_sql(1.0)}, points AS ({SERVICE_POINTS}), numbered AS (
            SELECT kind, metric, datum_type, {NUMBERED} AS datum_number FROM points)
        SELECT *, datum_number // 20 AS batch FROM numbered""",
)
def _(t: Inputs) -> DataFrame:
    batched = datums.batch_datums(service_datums(t))
    return batched.select("kind", "metric", "datum_type", "datum_number", "batch")


@check(
    "s9_write_datums",
    f"""WITH {figures_sql(1.0)}, points AS ({SERVICE_POINTS})
        SELECT kind, metric, datum_type, {POINT_VALUES}, unit, '2024-01-30' AS report_date
        FROM points""",
)
def _(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "datums")
    datum_sink.write_datums(service_datums(t), path)
    stored = point_values(t.spark.read.parquet(path))
    stored = stored.withColumn("report_date", F.col("report_date").cast("string"))
    return stored.drop("ts", "kind_rank", "datum_rank", "resolution")


# --- state changes -------------------------------------------------------------------------

LAUNCHED = "SELECT p.*, l.location FROM ({0}) AS p LEFT JOIN {fx_locations} l ON l.jar = p.jar"


def tick(t: Inputs, max_pipelines: int | None) -> ticks.TickPlan:
    return ticks.schedule_tick(
        {"pipelines": t["fx_pipelines"]},
        ts(TICK_END),
        ts(TICK_END),
        PREFIX,
        max_pipelines,
        t["fx_locations"],
        finished_at=ts("2001-06-01 00:12:00"),
    )


@check("c1_schedule_tick", LAUNCHED.replace("{0}", PLAN.replace("{0}", ALL_DUE)))
def c1_schedule_tick(t: Inputs) -> DataFrame:
    return tick(t, None).launches.select(*PLAN_COLUMNS, "location")


@check(
    "c1_schedule_tick_capped",
    LAUNCHED.replace(
        "{0}", PLAN.replace("{0}", f"{ALL_DUE} ORDER BY next_run_time, id LIMIT 60")
    ),
)
def _(t: Inputs) -> DataFrame:
    return tick(t, 60).launches.select(*PLAN_COLUMNS, "location")


@check(
    "c1_scheduler_metrics",
    f"""SELECT TIMESTAMP '{TICK_END}' AS start_time, CAST(count(*) AS INT) AS pipeline_count,
               TIMESTAMP '2001-06-01 00:12:00' AS end_time FROM {{fx_pipelines}} WHERE {DUE}""",
)
def _(t: Inputs) -> DataFrame:
    return tick(t, None).metrics


# A success starts a new run of failures; the counter is what the last attempt leaves.
TAKEN = """
    known AS (
        SELECT a.attempt_id, a.pipeline_id, COALESCE(a.ok, FALSE) AS ok, a.log,
               COALESCE(c.failure_count, 0) AS n
        FROM {fx_dispatch} a JOIN {fx_pipelines} p ON p.id = a.pipeline_id
        LEFT JOIN {fx_counters} c ON c.pipeline_id = a.pipeline_id),
    in_streaks AS (
        SELECT *, count(*) FILTER (ok) OVER (PARTITION BY pipeline_id ORDER BY attempt_id)
                      AS streak
        FROM known),
    placed AS (
        SELECT *, count(*) FILTER (NOT ok)
                      OVER (PARTITION BY pipeline_id, streak ORDER BY attempt_id)
                  + CASE WHEN streak = 0 THEN n ELSE 0 END AS f
        FROM in_streaks),
    ended AS (
        SELECT pipeline_id, bool_or(ok) AS ok, bool_or(NOT ok AND f > 3) AS gone,
               bool_or(ok OR f <= 3) AS counted,
               arg_max(CASE WHEN ok THEN 0 ELSE least(f, 3) END, attempt_id) AS left_over
        FROM placed GROUP BY pipeline_id)"""


def dispatched(t: Inputs) -> ticks.DispatchResult:
    return ticks.apply_dispatch_results(
        t.catalog(), t["fx_dispatch"], t["fx_new_runs"], ts(TICK_END), ts(TICK_END)
    )


@check(
    "c2_dispatch_next_state",
    f"""WITH {TAKEN}
        SELECT id, name, CASE WHEN ok THEN {forward("next_run_time", f"TIMESTAMP '{TICK_END}'")}
                              ELSE next_run_time END AS next_run_time,
               is_active AND NOT COALESCE(gone, FALSE) AS is_active
        FROM {{fx_pipelines}} p LEFT JOIN ended ON ended.pipeline_id = p.id""",
)
def _(t: Inputs) -> DataFrame:
    return dispatched(t).catalog["pipelines"].select("id", "name", "next_run_time", "is_active")


@check(
    "c2_dispatch_counters",
    f"""WITH {TAKEN}
        SELECT pipeline_id, failure_count, updated_at FROM {{fx_counters}}
        WHERE pipeline_id NOT IN (SELECT pipeline_id FROM ended WHERE counted)
        UNION ALL SELECT pipeline_id, CAST(left_over AS INT), TIMESTAMP '{TICK_END}' FROM ended
        WHERE counted AND left_over > 0""",
)
def _(t: Inputs) -> DataFrame:
    return dispatched(t).catalog["schedule_failure_counters"]


@check(
    "c2_dispatch_runs",
    f"""WITH {TAKEN}
        SELECT * FROM {{fx_runs}} UNION ALL SELECT * FROM {{fx_new_runs}}
        WHERE pipeline_id IN (SELECT pipeline_id FROM ended WHERE ok)""",
)
def _(t: Inputs) -> DataFrame:
    return dispatched(t).catalog["scheduled_pipelines"]


@check(
    "c2_dispatch_events",
    f"""WITH {TAKEN}
        SELECT pipeline_id, CASE WHEN f > 3 THEN 'deactivated' ELSE 'failed_to_schedule' END
                   AS event,
               CAST(least(f, 4) AS INT) AS failure_number, log
        FROM placed WHERE NOT ok""",
)
def _(t: Inputs) -> DataFrame:
    return dispatched(t).events


@check(
    "c2_dispatch_rejected",
    """SELECT * FROM {fx_dispatch}
       WHERE pipeline_id NOT IN (SELECT id FROM {fx_pipelines})""",
)
def _(t: Inputs) -> DataFrame:
    return dispatched(t).rejected


CLEANUP = f"""
    ranked AS ({RANKED.format("AND r.in_console")}),
    actions AS (
        SELECT r.aws_id, r.pipeline_id, 'mark_not_in_console' AS action FROM {{fx_runs}} r
        WHERE r.in_console AND r.aws_id NOT IN (SELECT aws_id FROM {{fx_status}})
        UNION ALL SELECT aws_id, pipeline_id,
            CASE WHEN failed THEN 'delete_failed' ELSE 'delete_healthy' END
        FROM ranked WHERE rnk > retention
        UNION ALL SELECT aws_id, pipeline_id, 'record_failure' FROM ranked
        WHERE failed AND rnk <= retention AND aws_id NOT IN (SELECT aws_id FROM {{fx_failed}}))"""


def cleaned(t: Inputs) -> cleanup.Cleanup:
    return cleanup.cleanup_existing(t.catalog(), t["fx_status"], ts(TICK_END))


@check("c3_cleanup_actions", f"WITH {CLEANUP} SELECT * FROM actions")
def c3_cleanup_actions(t: Inputs) -> DataFrame:
    return cleaned(t).actions


@check(
    "c3_cleanup_runs",
    f"""WITH {CLEANUP}
        SELECT * REPLACE (in_console AND aws_id NOT IN (
            SELECT aws_id FROM actions WHERE action <> 'record_failure') AS in_console)
        FROM {{fx_runs}}""",
)
def _(t: Inputs) -> DataFrame:
    return cleaned(t).catalog["scheduled_pipelines"]


@check(
    "c3_cleanup_failed",
    f"""WITH {CLEANUP}
        SELECT * FROM {{fx_failed}} UNION ALL
        SELECT aws_id, pipeline_id, FALSE, TIMESTAMP '{TICK_END}' FROM actions
        WHERE action = 'record_failure'""",
)
def _(t: Inputs) -> DataFrame:
    return cleaned(t).catalog["failed_pipelines"]


@check(
    "c3_cleanup_quarantined",
    """SELECT aws_id, pipeline_id FROM {fx_runs} WHERE in_console AND pipeline_id NOT IN (
           SELECT id FROM {fx_pipelines} WHERE is_active)""",
)
def _(t: Inputs) -> DataFrame:
    catalog = t.catalog()
    catalog["pipelines"] = retention.active_pipelines(catalog["pipelines"])
    return cleanup.cleanup_existing(catalog, t["fx_status"], ts(TICK_END)).quarantined


def unmanaged_cleanup(t: Inputs, **options) -> cleanup.UnmanagedCleanup:
    ids = inventory.load_inventory(listing_pages(t))
    return cleanup.cleanup_unmanaged(
        ids, t["fx_status"], t["fx_runs"], EXCLUDED, ts(CUTOFF), PREFIX, **options
    )


@check(
    "c4_cleanup_unmanaged_ids",
    f"""SELECT aws_id FROM {{fx_status}}
        WHERE {UNPROTECTED} AND {OLD_AND_FINISHED} AND {UNMANAGED}""",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged_cleanup(t).ids


FORCED = f"""SELECT aws_id FROM {{fx_status}}
    WHERE ({OWN} OR {UNPROTECTED}) AND {OLD_AND_FINISHED}"""


@check(
    "c4_cleanup_forced_dry_run",
    f"""SELECT count(*) AS updated_runs FROM {{fx_runs}}
        WHERE in_console AND aws_id IN ({FORCED})""",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged_cleanup(t, force=True, dry_run=True).affected


@check(
    "c4_cleanup_forced_runs",
    f"SELECT * REPLACE (in_console AND aws_id NOT IN ({FORCED}) AS in_console) FROM {{fx_runs}}",
)
def _(t: Inputs) -> DataFrame:
    return unmanaged_cleanup(t, force=True).runs


def unmanaged_summary(t: Inputs) -> tuple[DataFrame, DataFrame]:
    ids = inventory.load_inventory(listing_pages(t))
    return cleanup.summarize_unmanaged(ids, t["fx_status"], t["fx_runs"])


@check("c5_summary_by_state", BY_STATE.format(f"WHERE {UNMANAGED}"))
def _(t: Inputs) -> DataFrame:
    return unmanaged_summary(t)[0]


@check("c5_summary_by_date", BY_DATE.format(f"WHERE {UNMANAGED}"))
def _(t: Inputs) -> DataFrame:
    return unmanaged_summary(t)[1]


NOW = f"TIMESTAMP '{TICK_END}'"
RESOLVED = f"""
    SELECT * EXCLUDE (schedule, frequency),
           CASE WHEN period IS NULL THEN NULL
                WHEN start_now THEN {backward("start_time", NOW)}
                ELSE {forward("start_time", NOW)} END AS next_run_time
    FROM (SELECT s.*, COALESCE(s.schedule, d.start_time) AS start_time,
                 COALESCE(s.frequency, d.period) AS period
          FROM {{fx_submissions}} s
          LEFT JOIN {{fx_definitions}} d ON d.pipeline_object = s.pipeline_object) AS r"""


def resolved(t: Inputs) -> DataFrame:
    return submissions.resolve_schedules(t["fx_submissions"], t["fx_definitions"], ts(TICK_END))


@check("c6_resolve_schedules", RESOLVED)
def _(t: Inputs) -> DataFrame:
    return resolved(t).drop("schedule", "frequency")


# Existence is looked up request by request here: a name goes with the first update of its class.
OUTCOMES = f"""
    requests AS (
        SELECT *, CASE WHEN do_update THEN 'update' WHEN update_jar_only THEN 'jar_only'
                       WHEN enable_flag OR disable_flag THEN 'switch' ELSE 'insert' END AS kind,
               CASE WHEN enable_flag AND disable_flag THEN 'enable_and_disable'
                    WHEN owner NOT LIKE '%@%' AND owner NOT LIKE 'arn:aws:sns:%'
                    THEN 'owner_invalid'
                    WHEN next_run_time IS NULL THEN 'no_schedule' END AS refused
        FROM ({RESOLVED}) AS resolved),
    renames AS (
        SELECT pipeline_object AS obj, min(request_id) AS at FROM requests
        WHERE kind = 'update' AND refused IS NULL AND owner IS NOT NULL AND NOT dry_run
        GROUP BY pipeline_object),
    named AS (
        SELECT p.*, CASE WHEN p.name <> p.class_name THEN u.at END AS renamed_at
        FROM {{fx_pipelines}} p LEFT JOIN renames u ON u.obj = p.class_name),
    matched AS (
        SELECT r.*, EXISTS (SELECT 1 FROM named p WHERE p.class_name = r.pipeline_object)
                    OR EXISTS (SELECT 1 FROM named p WHERE p.name = r.pipeline_object
                               AND r.request_id < COALESCE(p.renamed_at, r.request_id + 1))
                    AS known
        FROM requests r),
    followed AS (
        SELECT *, known OR COALESCE(bool_or(kind = 'insert' AND refused IS NULL
                          AND owner IS NOT NULL AND NOT dry_run AND NOT known) OVER (
                              PARTITION BY pipeline_object ORDER BY request_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS there
        FROM matched),
    outcomes AS (
        SELECT * EXCLUDE (known, there, refused),
               CASE WHEN refused IS NOT NULL THEN refused
                    WHEN kind = 'update' AND owner IS NULL THEN 'owner_required_update'
                    WHEN kind <> 'insert' AND NOT there THEN 'missing'
                    WHEN kind = 'insert' AND there THEN 'exists'
                    WHEN kind = 'insert' AND owner IS NULL THEN 'owner_required_insert'
                    WHEN kind = 'update' THEN 'updated' WHEN kind = 'jar_only' THEN 'jar_updated'
                    WHEN kind = 'switch' AND disable_flag THEN 'disabled'
                    WHEN kind = 'switch' THEN 'enabled' ELSE 'inserted' END AS outcome
        FROM followed)"""


def submitted(t: Inputs) -> submitting.Submitted:
    return submitting.apply_submissions(resolved(t), t["fx_pipelines"])


@check(
    "c7_submission_outcomes",
    f"WITH {OUTCOMES} SELECT request_id, pipeline_object, kind, outcome, dry_run FROM outcomes",
)
def _(t: Inputs) -> DataFrame:
    return submitted(t).outcomes.select(
        "request_id", "pipeline_object", "kind", "outcome", "dry_run"
    )


def last_sql(value: str, outcomes: str) -> str:
    return f"arg_max({value}, request_id) FILTER (outcome IN ({outcomes}))"


WHOLE = "'updated', 'inserted'"
LAST_WRITES = f"""
    count(*) FILTER (outcome IN ({WHOLE})) > 0 AS whole,
    {last_sql("period", WHOLE)} AS w_period, {last_sql("next_run_time", WHOLE)} AS w_next,
    {last_sql("owner", WHOLE)} AS w_owner, {last_sql("NOT no_backfill", WHOLE)} AS w_backfill,
    {last_sql("jar", WHOLE + ", 'jar_updated'")} AS w_jar,
    {last_sql("NOT disable_flag", WHOLE + ", 'enabled', 'disabled'")} AS active"""


@check(
    "c7_submission_next_state",
    f"""WITH {OUTCOMES},
        live AS (
            SELECT * FROM outcomes WHERE NOT dry_run AND outcome IN (
                'updated', 'jar_updated', 'enabled', 'disabled', 'inserted')),
        hits AS (
            SELECT p.id, o.* FROM named p
            JOIN live o ON o.pipeline_object = p.class_name
            UNION ALL
            SELECT p.id, o.* FROM named p JOIN live o ON o.pipeline_object = p.name
            WHERE p.name <> p.class_name AND (p.renamed_at IS NULL OR o.request_id < p.renamed_at)),
        changed AS (SELECT id, {LAST_WRITES} FROM hits GROUP BY id),
        made AS (
            SELECT pipeline_object AS obj, max(request_id) FILTER (outcome = 'inserted') AS ins,
                   {last_sql("start_time", "'inserted'")} AS start_time, {LAST_WRITES}
            FROM live GROUP BY pipeline_object)
        SELECT id, CASE WHEN renamed_at IS NOT NULL THEN class_name ELSE name END AS name,
               COALESCE(w_jar, jar) AS jar, class_name, COALESCE(active, is_active) AS is_active,
               CASE WHEN whole THEN 2 ELSE retention END AS retention, start_time,
               CASE WHEN whole THEN w_period ELSE period END AS period,
               CASE WHEN whole THEN NULL ELSE end_time END AS end_time,
               CASE WHEN whole THEN w_next ELSE next_run_time END AS next_run_time,
               CASE WHEN whole THEN w_backfill ELSE backfill END AS backfill,
               CASE WHEN whole THEN w_owner ELSE owner END AS owner
        FROM named LEFT JOIN changed USING (id)
        UNION ALL
        SELECT (SELECT max(id) FROM {{fx_pipelines}}) + row_number() OVER (ORDER BY ins), obj,
               w_jar, obj, active, 2, start_time, w_period, NULL, w_next, w_backfill, w_owner
        FROM made WHERE ins IS NOT NULL""",
)
def c7_submission_next_state(t: Inputs) -> DataFrame:
    return submitted(t).pipelines


@check(
    "c8_submission_errors",
    f"""WITH {OUTCOMES}
        SELECT request_id, pipeline_object, outcome,
               CAST(CASE outcome WHEN 'exists' THEN 2 WHEN 'missing' THEN 3
                    WHEN 'enable_and_disable' THEN 4 ELSE 1 END AS INT) AS exit_code
        FROM outcomes WHERE outcome NOT IN (
            'updated', 'jar_updated', 'enabled', 'disabled', 'inserted')""",
)
def _(t: Inputs) -> DataFrame:
    return submissions.submission_errors(submitted(t).outcomes).drop("message")


SAID = f"""
    SELECT request_id, 'Pipeline ' || pipeline_object || CASE outcome
               WHEN 'updated' THEN ' Schedule updated...next run '
                    || strftime(next_run_time, '%Y-%m-%dT%H:%M:%S')
               WHEN 'jar_updated' THEN ' Jar updated to version ' || jar
               WHEN 'enabled' THEN ' Enabled.' WHEN 'disabled' THEN ' Disabled.'
               WHEN 'inserted' THEN ' Scheduled. Next Run - '
                    || strftime(next_run_time, '%Y-%m-%dT%H:%M:%S') END AS message
    FROM outcomes WHERE outcome IN ('updated', 'jar_updated', 'enabled', 'disabled', 'inserted')"""


@check("n3_submission_messages", f"WITH {OUTCOMES} {SAID}")
def _(t: Inputs) -> DataFrame:
    said = notifications.submission_messages(submitted(t).outcomes)
    return said.select("request_id", "message")


@check(
    "n4_chat_payloads",
    f"""WITH {OUTCOMES}, said AS ({SAID})
        SELECT request_id, CAST(json_object('channel', '#robots', 'username', 'fleet', 'text',
                   message || chr(10) || 'Requested By: nobody') AS VARCHAR) AS payload
        FROM said""",
)
def _(t: Inputs) -> DataFrame:
    said = notifications.submission_messages(submitted(t).outcomes)
    return notifications.chat_payloads(
        said, ["Requested By: nobody"], "fleet", "#robots"
    ).select("request_id", "payload")


def described(catalog: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables under each other, each with what a cycle can change about it."""

    def text(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit("-"))

    states = {
        "pipelines": F.concat_ws(" ", text("next_run_time"), text("is_active")),
        "scheduled_pipelines": F.concat_ws(" ", text("status"), text("in_console")),
        "failed_pipelines": text("resolved"),
        "schedule_failure_counters": text("failure_count"),
        "scheduler_metrics": text("pipeline_count"),
    }
    merged = None
    for name, state in states.items():
        part = catalog[name].select(
            F.lit(name).alias("table_name"),
            F.col(TABLES[name].key[0]).cast("string").alias("row_key"),
            state.alias("row_state"),
        )
        merged = part if merged is None else merged.unionByName(part)
    return merged


MOVED_ON = forward("p.next_run_time", f"TIMESTAMP '{TICK_END}'").replace("period", "p.period")

# Launches fail for some nations' pipelines, and furniture launches leave no inventory entry. Of
# the entries that came up, those of pipelines with retention 1 are gone again at clean-up.
CYCLE = f"""
    due AS (SELECT p.*, c.c_nationkey <> 7 AND p.jar <> 's3://jars/furniture.jar' AS came_up
            FROM {{fx_pipelines}} p JOIN {{customer}} c ON c.c_custkey = p.id WHERE {DUE}),
    tried AS (SELECT d.*, COALESCE(k.failure_count, 0) AS n FROM due d
              LEFT JOIN {{fx_counters}} k ON k.pipeline_id = d.id),
    {CLEANUP}"""


@check(
    "c9_hourly_cycle",
    f"""WITH {CYCLE}
        SELECT 'pipelines' AS table_name, CAST(p.id AS VARCHAR) AS row_key,
               COALESCE(CAST(CASE WHEN t.came_up THEN {MOVED_ON} ELSE p.next_run_time END
                             AS VARCHAR), '-') || ' '
                   || CASE WHEN NOT t.came_up AND t.n >= 3 THEN FALSE ELSE p.is_active END
                   AS row_state
        FROM {{fx_pipelines}} p LEFT JOIN tried t ON t.id = p.id
        UNION ALL
        SELECT 'scheduled_pipelines', aws_id, status || ' ' || (in_console AND aws_id NOT IN (
            SELECT aws_id FROM actions WHERE action <> 'record_failure')) FROM {{fx_runs}}
        UNION ALL
        SELECT 'scheduled_pipelines', 'df-new-' || id, 'success ' || (retention <> 1)
        FROM due WHERE came_up
        UNION ALL SELECT 'failed_pipelines', aws_id, 'false' FROM {{fx_failed}}
        UNION ALL SELECT 'failed_pipelines', aws_id, 'false' FROM actions
                  WHERE action = 'record_failure'
        UNION ALL
        SELECT 'schedule_failure_counters', CAST(pipeline_id AS VARCHAR),
               CAST(failure_count AS VARCHAR) FROM {{fx_counters}}
        WHERE pipeline_id NOT IN (SELECT id FROM tried WHERE came_up OR n < 3)
        UNION ALL
        SELECT 'schedule_failure_counters', CAST(id AS VARCHAR), CAST(n + 1 AS VARCHAR)
        FROM tried WHERE NOT came_up AND n < 3
        UNION ALL
        SELECT 'scheduler_metrics', CAST(start_time AS VARCHAR),
               COALESCE(CAST(pipeline_count AS VARCHAR), '-') FROM {{fx_scheduler_metrics}}
        UNION ALL
        SELECT 'scheduler_metrics', '{TICK_END}', CAST(count(*) AS VARCHAR) FROM due""",
)
def _(t: Inputs) -> DataFrame:
    return described(cycled(t, t.catalog()).catalog)


def cycled(t: Inputs, catalog: dict[str, DataFrame]) -> cycle.Cycle:
    named = schedule.deployment_names(t["fx_pipelines"], ts(TICK_END), PREFIX).where(
        "jar <> 's3://jars/furniture.jar'"
    )
    new_id = F.concat(F.lit("df-new-"), "id").alias("aws_id")
    names = named.select(new_id, F.col("deployment_name").alias("pipeline_name"))
    results = t["customer"].select(
        F.col("c_custkey").alias("pipeline_id"),
        (F.col("c_nationkey") != 7).alias("ok"),
        F.col("c_name").alias("log"),
    )
    came_up = named.where("retention <> 1").select(
        new_id,
        F.col("deployment_name").alias("name"),
        F.lit(None).cast("string").alias("health_status"),
        F.lit("RUNNING").alias("pipeline_state"),
        F.lit(None).cast("string").alias("creation_time"),
    )
    return cycle.hourly_cycle(
        catalog,
        ts(TICK_START),
        ts(TICK_END),
        ts(TICK_END),
        PREFIX,
        results,
        names,
        names.select("pipeline_name", F.lit(True).alias("activated")),
        t["fx_status"].unionByName(came_up),
        max_pipelines=None,
    )


# Some periods are no use, and some of the run log's pipelines are no longer there.
LOST_WHEN = "retention = 2 AND next_run_time IS NULL"
BAD_PERIOD = "retention = 3 AND owner IS NULL"


@check(
    "c9_cycle_unhandled",
    f"""SELECT 'rejected_launch' AS reason, CAST(id AS VARCHAR) AS row_key FROM {{fx_pipelines}}
        WHERE {DUE} AND {BAD_PERIOD}
        UNION ALL
        SELECT 'quarantined_run', aws_id FROM {{fx_runs}} WHERE in_console AND pipeline_id IN (
            SELECT id FROM {{fx_pipelines}} WHERE {LOST_WHEN})""",
)
def _(t: Inputs) -> DataFrame:
    bad = F.when(F.expr(BAD_PERIOD), "3 moons").otherwise(F.col("period"))
    kept = t["fx_pipelines"].where(F.coalesce(~F.expr(LOST_WHEN), F.lit(True)))
    done = cycled(t, {**t.catalog(), "pipelines": kept.withColumn("period", bad)})
    return done.unhandled


def report_columns(df: DataFrame) -> DataFrame:
    return (
        point_values(df)
        .withColumn("dimension_text", dimensions_text())
        .select(
            "kind",
            "metric_name",
            "datum_type",
            "value",
            "stat_sum",
            "stat_count",
            "stat_min",
            "stat_max",
            "unit",
            "resolution",
            "dimension_text",
            "datum_number",
            "batch",
        )
    )


@check(
    "c10_metric_report",
    rf"""WITH {figures_sql(1.0)}, points AS ({SERVICE_POINTS}), numbered AS (
             SELECT *, {NUMBERED} AS datum_number FROM points)
         SELECT kind, regexp_extract(metric, '^[^\[]+') AS metric_name, datum_type,
                {POINT_VALUES}, unit, 1 AS resolution,
                'Environment=test,Stack=main,Type=' || datum_type || ',src=test,user='
                    || regexp_extract(metric, 'user:(\d+)', 1) AS dimension_text,
                datum_number, datum_number // 20 AS batch
         FROM numbered""",
)
def c10_metric_report(t: Inputs) -> DataFrame:
    return report_columns(metric_report.metric_report(t["fx_samples"], ts(AS_OF), REPORT))


# --- streams -------------------------------------------------------------------------------


def event_stream(t: Inputs, view: str, events: DataFrame | None = None) -> DataFrame:
    """``view`` over the events read as a stream, or over another stream of events."""
    if events is None:
        source = t.spark.readStream.schema(t["events"].schema)
        events = source.parquet(f"{t.sf_dir}/events*.parquet")
    text = fixtures.VIEWS[view].replace("{NTZ}", "TIMESTAMP_NTZ")
    return t.spark.sql(text, events=events)


def finish_stream(results: DataFrame, path: str) -> None:
    writer = stream_reports.append_to(f"{path}/out", results)
    writer.option("checkpointLocation", f"{path}/log").trigger(
        availableNow=True
    ).start().awaitTermination()


def streamed_streaks(t: Inputs) -> tuple[DataFrame, str]:
    """The events come in three parts in time order; the stream is started again for each."""
    path = scratch_path(t.spark, "streaks")
    events = t["events"]
    low, high = events.agg(F.percentile_approx("ts", [1 / 3, 2 / 3])).first()[0]
    at = F.col("ts")
    for part in (at <= low, (at > low) & (at <= high), at.isNull() | (at > high)):
        events.where(part).write.mode("append").parquet(f"{path}/in")
        fed = t.spark.readStream.schema(events.schema).parquet(f"{path}/in")
        streaks_of = stream_failure_streaks(event_stream(t, "fx_attempts", fed), t["fx_counters"])
        finish_stream(streaks_of, path)
    return t.spark.read.schema(streaks_of.schema).parquet(f"{path}/out"), path


@check("st1_stream_failure_streaks", STREAKS)
def _(t: Inputs) -> DataFrame:
    return streamed_streaks(t)[0]


@check(
    "st1_stored_counters",
    f"""WITH streaks AS ({STREAKS}), ended AS (SELECT pipeline_id,
            arg_max(counter, ROW(attempt_time, attempt_id)) AS failure_count,
            max(attempt_time) AS updated_at FROM streaks GROUP BY pipeline_id)
        SELECT pipeline_id, failure_count, updated_at FROM ended WHERE failure_count > 0
        UNION ALL SELECT pipeline_id, failure_count, updated_at FROM {{fx_counters}}
        WHERE failure_count > 0 AND pipeline_id NOT IN (SELECT pipeline_id FROM ended)""",
)
def _(t: Inputs) -> DataFrame:
    """What the stream's own state says after its last batch."""
    return stored_counters(t.spark, f"{streamed_streaks(t)[1]}/log")


def run_stream(t: Inputs, results: DataFrame) -> DataFrame:
    path = scratch_path(t.spark, "reports")
    finish_stream(results, path)
    return t.spark.read.schema(results.schema).parquet(f"{path}/out")


CLOSED_DAYS = """
    SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS report_time
    FROM {fx_samples} WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
        <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {events})"""


@check(
    "st2_stream_counter_deltas",
    f"""SELECT report_time, kind, metric, count(*) AS delta FROM ({CLOSED_DAYS}) AS closed
        GROUP BY report_time, kind, metric""",
)
def _(t: Inputs) -> DataFrame:
    samples = event_stream(t, "fx_samples")
    return run_stream(t, stream_reports.stream_counter_deltas(samples, "1 day", LATENESS))


@check(
    "st3_stream_metric_report",
    f"""SELECT report_time, kind, metric, round(sum(value), 9) AS sum,
               CAST(count(value) AS DOUBLE) AS sample_count, min(value) AS minimum,
               max(value) AS maximum, round(avg(value), 9) AS mean,
               round(COALESCE(stddev_samp(value), 0), 9) AS std_dev
        FROM ({CLOSED_DAYS}) AS closed GROUP BY report_time, kind, metric""",
)
def _(t: Inputs) -> DataFrame:
    samples = event_stream(t, "fx_samples")
    report = run_stream(t, stream_reports.stream_metric_report(samples, "1 day", LATENESS))
    return rounded(report, "sum", "mean", "std_dev")
