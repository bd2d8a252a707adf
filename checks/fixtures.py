"""Fleet tables as views over the test tables, in SQL that Spark and DuckDB both read.

``{name}`` stands for a test table or another view. ``{NTZ}`` is the zone-free timestamp type.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "fx_pipelines": """
        SELECT c.c_custkey AS id, c.c_name AS name,
               concat('s3://jars/', lower(c.c_mktsegment), '.jar') AS jar,
               concat('com.example.P', c.c_custkey) AS class_name,
               c.c_nationkey NOT IN (3, 17) AS is_active,
               CAST(1 + c.c_custkey % 3 AS INT) AS retention,
               o.first_run AS start_time,
               CASE c.c_custkey % 6 WHEN 0 THEN '1 day' WHEN 1 THEN '1 week'
                    WHEN 2 THEN '1 month' WHEN 3 THEN '12 hours'
                    WHEN 4 THEN '1 year' ELSE '90 minutes' END AS period,
               CASE WHEN c.c_custkey % 5 = 0 THEN {NTZ} '2001-03-01 00:00:00' END AS end_time,
               CASE WHEN c.c_acctbal >= 0 THEN o.last_run END AS next_run_time,
               c.c_custkey % 2 = 0 AS backfill,
               CASE c.c_custkey % 4
                    WHEN 1 THEN concat('owner', c.c_custkey, '@example.com')
                    WHEN 2 THEN concat('arn:aws:sns:us-east-1:123456789012:topic-', c.c_custkey)
                    WHEN 3 THEN 'not an owner' END AS owner
        FROM {customer} c
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_run, max(o_orderdate) AS last_run
                   FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "fx_runs": """
        SELECT concat('df-', o_orderkey) AS aws_id, o_custkey AS pipeline_id,
               concat('sp_', o_orderkey, '_', o_custkey) AS pipeline_name,
               o_orderdate AS scheduled_start,
               o_orderdate - INTERVAL '1' DAY * (extract(DAY FROM o_orderdate) - 1)
                   AS actual_start,
               o_orderdate + INTERVAL '1' HOUR AS deployed_time,
               CASE WHEN o_orderkey % 13 = 0 THEN 'fail' ELSE 'success' END AS status,
               o_totalprice >= 150000 AS in_console
        FROM {orders}""",
    "fx_status": """
        SELECT concat('df-', o_orderkey) AS aws_id,
               concat(CASE o_orderkey % 4 WHEN 0 THEN 'sp_' WHEN 1 THEN 'dev_' ELSE 'adhoc_' END,
                      o_orderkey) AS name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ERROR' WHEN '5-LOW' THEN NULL
                    ELSE 'HEALTHY' END AS health_status,
               CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' END END AS pipeline_state,
               CASE WHEN o_orderkey % 17 <> 0
                    THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T00:00:00') END
                   AS creation_time
        FROM {orders} WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "fx_status_dirty": """
        SELECT aws_id, name, health_status,
               CASE WHEN health_status IS NULL AND pipeline_state = 'RUNNING' THEN 'PROMOTED'
                    ELSE pipeline_state END AS pipeline_state,
               creation_time
        FROM {fx_status}""",
    "fx_failed": """
        SELECT concat('df-', o_orderkey) AS aws_id, o_custkey AS pipeline_id, FALSE AS resolved,
               o_orderdate AS checked_time
        FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000""",
    "fx_counters": """
        SELECT user_id AS pipeline_id, CAST(1 + count(*) % 3 AS INT) AS failure_count,
               max(ts) AS updated_at
        FROM {events} WHERE event_type = 'error' GROUP BY user_id HAVING max(value) >= 150""",
    "fx_scheduler_metrics": """
        SELECT ts AS start_time,
               CASE WHEN event_id % 9 <> 0 THEN CAST(user_id AS INT) END AS pipeline_count,
               CASE WHEN event_id % 11 <> 0
                    THEN ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) END AS end_time
        FROM {events} WHERE event_type = 'signup'""",
    "fx_attempts": """
        SELECT event_id AS attempt_id, user_id AS pipeline_id, ts AS attempt_time,
               event_type <> 'error' AS ok, props AS log
        FROM {events}""",
    "fx_dispatch": """
        SELECT attempt_id,
               CASE WHEN attempt_id % 97 = 0 THEN -pipeline_id ELSE pipeline_id END AS pipeline_id,
               CASE WHEN attempt_id % 89 <> 0 THEN ok AND attempt_id % 5 <> 0 END AS ok, log
        FROM {fx_attempts}""",
    "fx_new_runs": """
        SELECT concat('df-new-', o_orderkey) AS aws_id, o_custkey AS pipeline_id,
               concat('sp_new_', o_custkey) AS pipeline_name, o_orderdate AS scheduled_start,
               o_orderdate AS actual_start, o_orderdate + INTERVAL '1' HOUR AS deployed_time,
               'success' AS status, TRUE AS in_console
        FROM {orders} WHERE o_orderstatus = 'P'""",
    "fx_samples": """
        SELECT event_id, ts,
               CASE event_type WHEN 'error' THEN 'gauge' WHEN 'signup' THEN 'counter'
                    WHEN 'view' THEN 'histogram' WHEN 'purchase' THEN 'meter'
                    ELSE 'timer' END AS kind,
               concat(event_type, '.count[user:', user_id, ',src:test]') AS metric,
               value,
               CASE WHEN value >= 120 THEN 'n/a' ELSE CAST(value AS VARCHAR(20)) END AS reading
        FROM {events}""",
    "fx_reported": """
        SELECT kind, metric, count(*) AS count
        FROM {fx_samples} WHERE ts < {NTZ} '2024-01-15 00:00:00' GROUP BY kind, metric""",
    "fx_reports": """
        SELECT kind, metric, report_time,
               CAST(sum(n) OVER (PARTITION BY kind, metric ORDER BY report_time) AS BIGINT)
                   AS value
        FROM (SELECT kind, metric, CAST(CAST(ts AS DATE) AS {NTZ}) AS report_time, count(*) AS n
              FROM {fx_samples} GROUP BY 1, 2, 3) AS daily""",
    "fx_periods": """
        SELECT p_partkey AS id,
               concat(CASE WHEN p_size = 7 THEN '' WHEN p_size = 8 THEN '-2'
                           WHEN p_size = 9 THEN '10000' WHEN p_size = 10 THEN '2000000'
                           WHEN p_size = 11 THEN '0100000000' WHEN p_size = 12 THEN '3360000'
                           WHEN p_size = 13 THEN '3360001' WHEN p_size = 14 THEN '9999999999999999'
                           WHEN p_size = 15 THEN '99999999999999999999'
                           ELSE CAST(p_size % 20 AS VARCHAR(9)) END, ' ',
                      CASE p_partkey % 8 WHEN 0 THEN 'year' WHEN 1 THEN 'months' WHEN 2 THEN 'week'
                           WHEN 3 THEN 'days' WHEN 4 THEN 'hour' WHEN 5 THEN 'Minutes'
                           WHEN 6 THEN 'fortnight' ELSE 'day' END) AS period
        FROM {part}""",
    "fx_submissions": """
        SELECT request_id,
               CASE WHEN p_size % 5 = 0 THEN concat('com.example.P', k)
                    ELSE concat('Customer#', lpad(CAST(k AS VARCHAR(9)), 9, '0')) END
                   AS pipeline_object,
               concat('s3://jars/v2/', request_id, '.jar') AS jar,
               p_size % 2 = 0 AS start_now,
               request_id % 5 = 0 AS do_update,
               request_id % 5 = 1 AS update_jar_only,
               p_size % 3 = 0 AS no_backfill,
               request_id % 5 = 2 OR p_size = 11 AS enable_flag,
               request_id % 5 = 3 OR p_size = 11 AS disable_flag,
               CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size = 13 THEN 'nobody'
                    WHEN p_size % 4 = 1 THEN 'arn:aws:sns:us-east-1:123456789012:topic'
                    ELSE concat('o', request_id, '@example.com') END AS owner,
               CASE WHEN p_size % 6 <> 0 THEN {NTZ} '2001-01-31 00:00:00' END AS schedule,
               CASE WHEN p_size % 7 <> 0 THEN '1 month' END AS frequency,
               p_size % 7 = 1 AS dry_run
        FROM (SELECT p_partkey AS request_id, p_size, p_partkey - p_partkey % 3 AS k
              FROM {part}) AS p""",
    "fx_definitions": """
        SELECT name AS pipeline_object, start_time, period FROM {fx_pipelines}
        UNION ALL
        SELECT class_name AS pipeline_object, start_time, period FROM {fx_pipelines}""",
    "fx_locations": """
        SELECT jar, concat('/cache/', substr(jar, 11)) AS location
        FROM (SELECT DISTINCT jar FROM {fx_pipelines}) AS j
        WHERE jar <> 's3://jars/furniture.jar'""",
    "fx_deployed": """
        SELECT c_custkey AS pipeline_id, concat('sp_', c_custkey) AS pipeline_name,
               {NTZ} '2001-06-01 00:10:00' AS deployed_time
        FROM {customer}""",
    "fx_names": """
        SELECT concat('df-', o_orderkey) AS aws_id, concat('sp_', o_custkey) AS pipeline_name
        FROM {orders} WHERE o_orderpriority = '2-HIGH'""",
    "fx_activations": """
        SELECT concat('sp_', o_custkey) AS pipeline_name, max(o_totalprice) > 200000 AS activated
        FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey""",
}


def _names(text: str) -> list[str]:
    return [n for _, n, _, _ in string.Formatter().parse(text) if n and n != "NTZ"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or view as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{NTZ}", "TIMESTAMP_NTZ")
    inputs = {n: table(spark, sf_dir, n) for n in dict.fromkeys(_names(text))}
    return spark.sql(text, **inputs)


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five catalog tables."""
    views = {
        "pipelines": "fx_pipelines",
        "scheduled_pipelines": "fx_runs",
        "failed_pipelines": "fx_failed",
        "schedule_failure_counters": "fx_counters",
        "scheduler_metrics": "fx_scheduler_metrics",
    }
    return {name: table(spark, sf_dir, view) for name, view in views.items()}


def for_duckdb(query: str) -> str:
    """``query`` with the views it names put in front of it as common table expressions."""
    needed: dict[str, str] = {}

    def need(text: str) -> None:
        for name in _names(text):
            if name in VIEWS and name not in needed:
                need(VIEWS[name])
                needed[name] = VIEWS[name]

    need(query)
    names = {n: n for n in [*BASE_TABLES, *VIEWS]} | {"NTZ": "TIMESTAMP"}
    body = query.format(**names).strip()
    if not needed:
        return body
    heads = ",\n".join(f"{n} AS ({t.format(**names).strip()})" for n, t in needed.items())
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads},\n{body[len('WITH'):]}"
    return f"WITH {heads}\n{body}"
