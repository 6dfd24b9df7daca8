"""The package must work where only the driver can import it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
from __spark_entry__ import queries
for name in ("w10_dedup_within", "w10_dedup_within_hot_keys", "w14_lockout_report_hot_keys", "r09_stream_timeouts", "r08_stream_dedup"):
    print(name, queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    counts = dict(line.split() for line in done.stdout.splitlines() if len(line.split()) == 2)
    assert counts.get("w10_dedup_within") == counts.get("w10_dedup_within_hot_keys") == counts.get("r08_stream_dedup") == "645", done.stderr[-3000:]
    assert counts["w14_lockout_report_hot_keys"] == "8" and counts["r09_stream_timeouts"] == "125"
