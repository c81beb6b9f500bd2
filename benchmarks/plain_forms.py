"""The ten analyses against the plain statement of each question.

The plain forms join all rows first, aggregate afterwards, sum doubles and
classify with row-at-a-time Python functions: what one writes without a
thought for the plan.  Both are built and run in one process, into the noop
sink, in turns; the median counts.  The results are compared as well, numbers
"""

from __future__ import annotations

import json
import math
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from orderlens.functions.classify import MARGIN_LABELS, MEDIUM_LIMITS, SIZE_LABELS, SMALL_LIMITS  # noqa: E402
from orderlens.functions.scalar import WEEKDAYS  # noqa: E402
from orderlens.plans import registry  # noqa: E402
from orderlens.session import build_session  # noqa: E402
from orderlens.sources.fixtures import OrderViews  # noqa: E402


def side(margin):
    return MARGIN_LABELS[(margin > 0) - (margin < 0) + 1] if margin == margin else None


def size(*measures):
    if None in measures:
        return SIZE_LABELS[3]
    *edges, weight = measures
    for label, (edge, most) in zip(SIZE_LABELS, (SMALL_LIMITS, MEDIUM_LIMITS)):
        if max(edges) <= edge and weight <= most:
            return label
    return SIZE_LABELS[2]


PLAIN = {
    "active_sellers_by_year": """
        SELECT year(order_approved_at) AS year, count(DISTINCT seller_id) AS active_seller, count(DISTINCT product_id) AS product_count
        FROM items JOIN orders USING (order_id) JOIN payments USING (order_id) JOIN sellers USING (seller_id) JOIN products USING (product_id)
        GROUP BY 1 ORDER BY 1, 2 DESC""",
    "customer_share_by_state": """
        SELECT customer_state, n AS no_customers, round(n / sum(n) OVER () * 100, 2) AS percentage_customer_base,
               round(sum(n) OVER (ORDER BY n DESC) / sum(n) OVER () * 100, 2) AS running_total_percentage
        FROM (SELECT customer_state, count(customer_unique_id) AS n FROM customers GROUP BY customer_state) ORDER BY n DESC""",
    "state_trade_balance": """
        WITH deal AS (SELECT DISTINCT order_id, price, seller_id, seller_state, customer_id, customer_state
                      FROM priced JOIN sellers USING (seller_id) JOIN orders USING (order_id) JOIN customers USING (customer_id)),
        bought AS (SELECT customer_state, sum(price) AS buy_value FROM deal GROUP BY customer_state),
        sold AS (SELECT seller_state, sum(price) AS value FROM deal GROUP BY seller_state)
        SELECT customer_state, buy_value, customer_state AS seller_state, coalesce(value, 0) AS sell_value,
               coalesce(value, 0) - buy_value AS margin_activity, side(coalesce(value, 0) - buy_value) AS margin_category
        FROM bought LEFT JOIN sold ON customer_state = sold.seller_state""",
    "hour_weekday_matrix": f"""
        SELECT * FROM (SELECT hour(order_purchase_timestamp) AS hour, date_format(order_purchase_timestamp, 'EEEE') AS day, order_id
                       FROM (SELECT DISTINCT order_purchase_timestamp, order_id FROM clicks))
        PIVOT (count(order_id) FOR day IN ({', '.join(f"'{d}'" for d in WEEKDAYS)})) ORDER BY hour DESC""",
    "payment_summary": """
        SELECT payment_type, sum(payment_value) AS total_payment_value, avg(payment_installments) AS avg_installments
        FROM payments GROUP BY payment_type ORDER BY payment_type""",
    "orders_per_state": """
        SELECT customer_state, count(order_id) AS order_count FROM customers JOIN orders USING (customer_id) GROUP BY customer_state ORDER BY 2""",
    "customer_behaviour": """
        SELECT customer_id, order_count, average_order_value
        FROM (SELECT customer_id, count(order_id) AS order_count FROM orders GROUP BY customer_id)
        JOIN (SELECT customer_id, avg(payment_value) AS average_order_value FROM orders JOIN payments USING (order_id) GROUP BY customer_id) USING (customer_id)
        ORDER BY average_order_value DESC""",
    "value_by_product_size": """
        SELECT size(product_length_cm, product_width_cm, product_height_cm, product_weight_g) AS product_size_category,
               round(avg(price), 2) AS average_order_value
        FROM items JOIN products USING (product_id) GROUP BY 1""",
    "seller_monthly_growth": """
        SELECT seller_id, year_month, monthly_sales, prev_month_sales,
               try_divide(monthly_sales - prev_month_sales, prev_month_sales) * 100 AS sales_growth_percentage
        FROM (SELECT *, lag(monthly_sales) OVER (PARTITION BY seller_id ORDER BY year_month) AS prev_month_sales
              FROM (SELECT seller_id, left(CAST(order_purchase_timestamp AS STRING), 7) AS year_month, CAST(sum(price) AS FLOAT) AS monthly_sales
                    FROM orders JOIN items USING (order_id) GROUP BY 1, 2))""",
}
PIVOT = """
    SELECT * FROM (SELECT customer_state, payment_type, order_id FROM orders JOIN customers USING (customer_id) JOIN payments USING (order_id))
    PIVOT (count(order_id) FOR payment_type IN ({types}))"""


def plain(spark, name):
    if name != "pivot_payment_type_by_state":
        return spark.sql(PLAIN[name])
    found = spark.sql("SELECT DISTINCT payment_type FROM orders JOIN customers USING (customer_id) JOIN payments USING (order_id) ORDER BY 1").collect()
    return spark.sql(PIVOT.format(types=", ".join(f"'{r[0]}'" for r in found))).na.fill(0)


def same(a, b) -> bool:
    """Equal rows, numbers to a relative 1e-9; all other columns name a row."""
    def split(df):
        rows = [r.asDict() for r in df.collect()]
        return {tuple((c, r[c]) for c in sorted(r) if not isinstance(r[c], float)): [r[c] for c in sorted(r) if isinstance(r[c], float)] for r in rows}, len(rows)

    (one, n), (two, m) = split(a), split(b)
    return n == m == len(one) and one.keys() == two.keys() and all(
        math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for k in one for x, y in zip(one[k], two[k], strict=True))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra={"spark.driver.memory": "16g"})
    v = OrderViews(spark, sf_dir)
    registry.OrderViews = lambda *_: v                       # both forms start from the same views, built once
    views = {"items": v.items, "priced": v.items_bucketed, "orders": v.clean_orders, "payments": v.clean_payments, "customers": v.customers,
             "sellers": v.sellers, "products": v.products, "clicks": v.clickstream_orders}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.udf.register("side", side, T.StringType())
    spark.udf.register("size", size, T.StringType())
    table = ["| query | plain form (s) | this library (s) | plain / library |", "| --- | --- | --- | --- |"]
    for name in ("pivot_payment_type_by_state", *PLAIN):
        forms = {"plain": lambda: plain(spark, name), "library": lambda: registry.QUERIES[name](spark, sf_dir)}
        equal = same(forms["plain"](), forms["library"]())
        times = {form: [] for form in forms}
        for _ in range(runs):
            for form, build in forms.items():
                start = time.perf_counter()
                build().write.format("noop").mode("overwrite").save()
                times[form].append(time.perf_counter() - start)
        a, b = (statistics.median(times[form]) for form in ("plain", "library"))
        print(json.dumps({"query": name, "plain_sec": round(a, 3), "library_sec": round(b, 3), "equal": equal, "sf_dir": sf_dir}), flush=True)
        table.append(f"| {name} | {a:.2f} | {b:.2f} | {a / b:.2f} |")
    print("\n".join(table))
    spark.stop()


if __name__ == "__main__":
    main()
