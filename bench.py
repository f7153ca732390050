"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from costurero.checks.queries import queries

HEADLINES = [
    "orders_progress",
    "orders_status_pct",
    "orders_with_total",
    "orders_counts",
    "process_summary",
    "process_matrix",
    "cut_progress",
    "cut_by_client",
    "packages",
    "packages_by_size",
    "packages_header",
    "qc_report",
    "qc_histogram",
    "gantt_schedule",
    "gantt_calendar",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    times = {}
    # Setting up the session and the tables is timed apart.
    began = time.perf_counter()
    registered["scan_counts"](spark, folder).collect()
    setup = round(time.perf_counter() - began, 3)
    # One untimed run, so that the first headline does not pay for compiling and warming up.
    registered[chosen[0]](spark, folder).write.format("noop").mode("overwrite").save()
    for name in chosen:
        began = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "setup": setup,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
