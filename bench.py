"""Benchmark the ten analyses.

Runs each headline query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` (default 8) and prints one JSON line:
``{"metric", "value", "unit", "queries", "sf", ...}``.

Every query is executed in full into Spark's ``noop`` sink (no rows are
pulled to the driver).  One untimed warm-up pass runs first; then each
query runs ``$BENCH_RUNS`` times (default 3) and its median is reported.
``$BENCH_EVENT_LOG`` names an (existing) folder for Spark's event log, to
read stage and task times afterwards.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "pivot_payment_type_by_state",   # Q1
    "active_sellers_by_year",        # Q2
    "customer_share_by_state",       # Q3
    "state_trade_balance",           # Q4
    "hour_weekday_matrix",           # Q5
    "payment_summary",               # Q6
    "orders_per_state",              # Q7
    "customer_behaviour",            # Q8
    "value_by_product_size",         # Q9
    "seller_monthly_growth",         # Q10
]


def run_once(spark, build, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from orderlens.session import build_session
    from orderlens.plans.registry import QUERIES

    extra = {"spark.driver.memory": "16g"}
    event_log = os.environ.get("BENCH_EVENT_LOG")    # optional folder for Spark's event log
    if event_log:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log})
    spark = build_session(f"local[{cpus}]", app_name="orderlens-bench", shuffle_partitions=cpus, extra=extra)
    for name in names:                      # warm-up: JIT, class loading, file listing caches
        run_once(spark, QUERIES[name], sf_dir)
    timings = {}
    for name in names:
        timings[name] = round(statistics.median(run_once(spark, QUERIES[name], sf_dir) for _ in range(runs)), 4)
    spark.stop()

    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(match.group(1)) if match else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
