"""Measure the plan choices of the analyses against the straightforward forms.

Each pair computes the same result on the same views; only the plan differs.
Prints one JSON line per pair with median seconds (noop sink, after warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from orderlens.functions import classify  # noqa: E402
from orderlens.operators import aggregate  # noqa: E402
from orderlens.plans import analyses as A  # noqa: E402
from orderlens.session import build_session  # noqa: E402
from orderlens.sources.fixtures import OrderViews  # noqa: E402


def timed(df, runs):
    df.write.format("noop").mode("overwrite").save()
    out = []
    for _ in range(runs):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - t)
    return round(statistics.median(out), 4)


def python_udf_size_class():
    small, medium = classify.SMALL_LIMITS, classify.MEDIUM_LIMITS

    def size(length, width, height, weight):
        dims = (length, width, height)
        if weight is None or any(d is None for d in dims):
            return "Unknown"
        for label, (edge, grams) in (("Small", small), ("Medium", medium)):
            if weight <= grams and all(d <= edge for d in dims):
                return label
        return "Large"
    return F.udf(size, T.StringType())


def q9_straight(v):
    cls = A.size_classified(v.products, python_udf_size_class())
    return (v.items.join(cls, "product_id").groupBy("product_size_category")
            .agg(F.round(F.avg("price"), 2).alias("average_order_value")))


Q4_SQL = """
WITH item AS (
  SELECT DISTINCT i.order_id, i.price, i.seller_id, s.seller_state, o.customer_id, c.customer_state
  FROM {items} i JOIN {sellers} s USING (seller_id) JOIN {orders} o USING (order_id) JOIN {customers} c USING (customer_id)),
bought AS (SELECT customer_state AS state, sum(price) AS buys FROM item GROUP BY customer_state),
sold AS (SELECT seller_state AS state, sum(price) AS sells FROM item GROUP BY seller_state)
SELECT state, buys, coalesce(sells, 0) AS sells, sign(coalesce(sells, 0) - buys) AS direction
FROM bought LEFT JOIN sold USING (state)
"""


def q4_straight(v, spark):
    """The question as one SQL text with a branch for each side."""
    return spark.sql(Q4_SQL, items=v.items_bucketed, sellers=v.sellers, orders=v.clean_orders, customers=v.customers)


def q1_discover_on_join(v):
    rows = (v.clean_orders.join(v.customers, "customer_id").join(v.clean_payments, "order_id"))
    return aggregate.pivot_count(rows, "customer_state", "payment_type", counted="order_id", values=None)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra={"spark.driver.memory": "16g"})
    v = OrderViews(spark, sf_dir)
    pairs = {
        "q9_classifier_case_when_vs_python_udf": (lambda: A.value_by_product_size(v.items, v.products),
                                                  lambda: q9_straight(v)),
        "q4_one_pass_fold_vs_two_branch_join": (
            lambda: A.state_trade_balance(A.item_route(spark, v.items_bucketed, v.sellers, v.clean_orders,
                                                       v.customers)),
            lambda: q4_straight(v, spark)),
        "q1_fold_before_customers_vs_pivot_on_join": (
            lambda: A.pivot_payment_type_by_state(v.clean_orders, v.customers, v.clean_payments),
            lambda: q1_discover_on_join(v)),
    }
    for name, (ours, straight) in pairs.items():
        # pivot discovery runs at plan-build time, so build inside the timing
        if name.startswith("q1"):
            def clock(build):
                build().write.format("noop").mode("overwrite").save()
                ts = []
                for _ in range(runs):
                    t = time.perf_counter()
                    build().write.format("noop").mode("overwrite").save()
                    ts.append(time.perf_counter() - t)
                return round(statistics.median(ts), 4)
            a, b = clock(ours), clock(straight)
        else:
            a, b = timed(ours(), runs), timed(straight(), runs)
        print(json.dumps({"pair": name, "ours_sec": a, "straight_sec": b, "sf_dir": sf_dir}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
