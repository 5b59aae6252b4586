"""Rows read from the raw table by a query, from Spark's event log (a session of its own)."""

from __future__ import annotations

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["daily_metrics", "anomalies", "instrument_summary", "screener_filtered", "card_kpi", "ranked_summary"]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
log, sf, names = sys.argv[1], sys.argv[2], sys.argv[3:]
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
         .config("spark.eventLog.dir", "file://" + log).config("spark.checkpoint.dir", log + "-ckpt").getOrCreate())
import __spark_entry__
from tradelake.plans.registry import reset
queries = __spark_entry__.queries()
for name in names:
    reset()
    spark.sparkContext.setJobGroup(name, name)
    queries[name](spark, sf).write.format("noop").mode("overwrite").save()
spark.stop()
"""


def test_queries_read_the_raw_table_once(tmp_path):
    log, sf = tmp_path / "events", "/root/testdata/sf0.001"
    log.mkdir()
    subprocess.run([sys.executable, "-c", SCRIPT, str(log), sf, *NAMES], cwd=REPO, check=True, timeout=600, capture_output=True)
    group, read = {}, dict.fromkeys(NAMES, 0)
    for line in next(log.iterdir()).open():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            group |= {s: e["Properties"].get("spark.jobGroup.id") for s in e["Stage IDs"]}
        elif e["Event"] == "SparkListenerTaskEnd" and group.get(e["Stage ID"]) in read:
            read[group[e["Stage ID"]]] += e["Task Metrics"]["Input Metrics"]["Records Read"]
    rows = 6000  # lineitem at this size
    assert all(rows <= n <= 1.1 * rows for n in read.values()), read
