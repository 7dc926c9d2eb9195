"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the local cores.  Every query is
built and collected once after a few warm-up queries on small tables in the same session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driver_queries import QUERIES  # noqa: E402

HEADLINE = [
    "segment_grid",
    "numeric_summary_lines",
    "distribution_moments",
    "outliers",
    "infer_types_lineitem",
    "data_dictionary",
    "distinct_counts",
    "top_values",
    "duplicate_rows",
    "correlation_matrix",
    "monthly_trend",
    "quality_issues",
    "kpi_totals",
    "histogram",
    "box_stats",
    "text_date_check",
    "whitespace_texts",
    "messy_csv_load",
    "pipeline_summary",
]


#: run first, untimed, so that the first timed query does not pay for starting the JVM
WARM_UP = ["segment_rollup", "infer_types_supplier", "numeric_summary_parts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-"))  # local runs only
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).collect()

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
