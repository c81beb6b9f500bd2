"""Job, stage and task times of one registered query, read from Spark's event log.

    python benchmarks/stage_times.py /root/testdata/sf0.1 state_trade_balance

The query runs twice to warm up, then once measured.  The event log goes to a new
scratch folder (no web UI is started or read).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens.plans.registry import QUERIES  # noqa: E402
from orderlens.session import build_session  # noqa: E402


def main(sf_dir: str, name: str) -> None:
    log_dir = tempfile.mkdtemp(prefix="orderlens-eventlog-")
    spark = build_session("local[8]", shuffle_partitions=8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"})
    for _ in range(2):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    start_ms = time.time() * 1000
    wall = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - wall
    spark.stop()

    files = [p for p in glob.glob(log_dir + "/**", recursive=True) if os.path.isfile(p)]
    print(f"{name}: wall {wall:.2f}s (event log in {log_dir})")
    for line in (line for f in files for line in open(f)):
        event = json.loads(line)
        kind = event["Event"]
        if kind == "SparkListenerJobStart" and event["Submission Time"] >= start_ms:
            print(f"  job {event['Job ID']} stages {event['Stage IDs']}")
        elif kind == "SparkListenerTaskEnd" and event["Task Info"]["Launch Time"] >= start_ms:
            m = event["Task Metrics"]
            print(f"    stage {event['Stage ID']:3d} run {m['Executor Run Time']:5d}ms "
                  f"cpu {m['Executor CPU Time'] // 1_000_000:5d}ms gc {m['JVM GC Time']:4d}ms "
                  f"rows in {m['Input Metrics']['Records Read']:8d} "
                  f"shuffle read {m['Shuffle Read Metrics']['Total Records Read']:8d} "
                  f"written {m['Shuffle Write Metrics']['Shuffle Records Written']:8d}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
