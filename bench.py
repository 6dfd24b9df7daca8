"""Wall time of the headline reports: one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from jobtrail.plans import all_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "a01_lifecycle",
    "a02_lifecycle_with_enqueue",
    "a06_duration_summary",
    "a08_metrics_snapshot",
    "a09_coalesce_logs",
    "a10_job_documents",
    "a14_stuck_report",
    "a17_outcome_report",
    "j02_job_detail",
    "j04_drain_status",
    "j05_watched_logs",
    "p14_env_report",
    "p16_effective_resources",
    "p18_parse_logs",
    "p21_secret_scan",
    "p23_redact_documents",
    "p32_admission_report",
    "r01_stream_lifecycle",
    "r04_stream_documents",
    "r06_stream_metrics",
    "r08_stream_dedup",
    "t01_job_list",
    "t02_log_tail",
    "w03_tail_trim",
    "w08_dispatch_order",
    "w10_dedup_within",
    "w11_dedup_replay",
    "w14_lockout_report",
    "w16_transitions",
]


def main(names):
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("jobtrail-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the Python and code-generation machinery outside the clock.
    queries["a03_status_counts"](spark, SF_DIR).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every column of every row.
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
