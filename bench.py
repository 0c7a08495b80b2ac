"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query runs once untimed on the same data, then is timed over ``RUNS`` runs; the median counts. A run
covers building the plan and reading every row of the result.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from grantlake.plans import load_queries

RUNS = 2
HEADLINES = [
    "secured_customers",
    "merged_row_filter",
    "merged_masks",
    "mask_hash",
    "text_masks",
    "grant_items",
    "item_fact",
    "tag_grants",
    "table_pattern_grants",
    "nested_paths",
    "conflict_members",
    "duplicate_grants",
    "grant_deny_conflicts",
    "item_statistics",
    "gap_summary",
    "readiness",
    "effective_grants",
    "filter_columns",
    "log_comparison",
]


def session(stages: str) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", stages)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    stages = tempfile.mkdtemp(prefix="bench-")  # one process on one machine
    spark = session(stages)
    queries = load_queries()[0]
    times: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
    shutil.rmtree(stages, ignore_errors=True)


if __name__ == "__main__":
    main()
