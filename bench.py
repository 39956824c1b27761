"""Times the queries, writers and streams included, and prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs of a headline query, the best counts (default 2, after one warm-up)

The headline queries make up ``value``. All others are timed once, after them.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from leadcurve.plans.queries import QUERIES

HEADLINE = [
    "funnel_retention",
    "funnel_summary",
    "funnel_local_period",
    "funnel_page_filter",
    "funnel_sheet_mode",
    "funnel_by_preset",
    "variants_available",
    "events_clean",
    "event_rejects",
    "insights_actions",
    "ad_daily",
    "ad_hourly",
    "ad_rollup_status",
    "creative_metrics",
    "creative_report",
    "daily_series",
    "hourly_series",
    "tag_report",
    "tag_metric_matrix",
    "kpi_totals",
    "top_creatives",
    "creative_medals",
    "costs_in_period",
    "creative_upsert",
    "cost_changes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leadcurve-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(min(timed(name) for _ in range(runs)), 4)
    others = {name: round(timed(name), 4) for name in QUERIES if name not in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds | others,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
