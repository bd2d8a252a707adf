"""Times the headline queries and prints one line of JSON.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores. Each query is planned
and run in full into the no-op sink, after one warm-up, and the middle one of three times counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402

# Query and the table whose rows its throughput is counted in.
HEADLINE = {
    "c1_schedule_tick": "customer",
    "c2_dispatch_next_state": "events",
    "c3_cleanup_actions": "orders",
    "c7_submission_next_state": "part",
    "c10_metric_report": "events",
    "w4_failure_streaks": "events",
    "a12_metric_percentiles": "events",
    "t6_expand_runs": "customer",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name, table in HEADLINE.items():
        timed = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(timed[1:]), 3)
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
        rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
