"""Registered queries over the driver tables, each with its SQL oracle.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame built from the
order views of ``orderlens.sources.fixtures``; ``oracle_sql()[name]`` is the
same question in DuckDB SQL over the same base tables.  Column names match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.functions import classify
from orderlens.functions.scalar import (
    WEEKDAYS, exact_sum, hour_of, month_key, text_to_timestamp, weekday_name, year_of,
)
from orderlens.operators import cleaning, partials, quality, relational, sketches
from orderlens.plans import analyses as A
from orderlens.sources.bucketed import bucket_load, write_bucketed
from orderlens.sources.catalog import publish, publish_classifiers, run_sql
from orderlens.sources.files import load_csv, read_ordered, write_ordered, write_result
from orderlens.sources.fixtures import PAYMENT_TYPES, UNDEFINED_PAYMENT_TYPE, OrderViews, with_views
from orderlens.sources.scratch import new_path, store
from orderlens.sources.statistics import save_analyzed

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build: Callable[[OrderViews], DataFrame]) -> Callable[[OrderViews], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(OrderViews(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql.strip())
        return build
    return wrap


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Shared SQL fragments ----------------------------------------------------------------------------
def _round2(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def _money_sum(expr: str) -> str:
    # by way of text both ways: DuckDB's own casts between double and a wide decimal are off in the last digits
    return f"CAST(CAST(sum(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,10))) AS VARCHAR) AS DOUBLE)"


def _margin_case(m: str) -> str:
    neg, zero, pos = classify.MARGIN_LABELS
    return (f"CASE WHEN {m} IS NULL OR isnan({m}) THEN NULL WHEN {m} < 0 THEN '{neg}' "
            f"WHEN {m} = 0 THEN '{zero}' ELSE '{pos}' END")


def _size_case(p: str = "p") -> str:
    (se, sw), (me, mw) = classify.SMALL_LIMITS, classify.MEDIUM_LIMITS
    dims = [f"{p}.product_length_cm", f"{p}.product_width_cm", f"{p}.product_height_cm"]
    w = f"{p}.product_weight_g"
    any_null = " OR ".join(f"{d} IS NULL" for d in dims + [w])
    small = " AND ".join([f"{d} <= {se}" for d in dims] + [f"{w} <= {sw}"])
    medium = " AND ".join([f"{d} <= {me}" for d in dims] + [f"{w} <= {mw}"])
    s, m, l, u = classify.SIZE_LABELS
    return f"CASE WHEN {any_null} THEN '{u}' WHEN {small} THEN '{s}' WHEN {medium} THEN '{m}' ELSE '{l}' END"


_WEEKDAY_COLUMNS = ", ".join(f"max(n) FILTER (WHERE day = '{d}') AS \"{d}\"" for d in WEEKDAYS)


def _hour_weekday_sql(view: str) -> str:
    return f"""
WITH e AS (SELECT DISTINCT order_purchase_timestamp AS ts, order_id FROM {view}),
g AS (SELECT hour(ts) AS hour, dayname(ts) AS day, count(order_id) AS n FROM e GROUP BY 1, 2)
SELECT CAST(hour AS INTEGER) AS hour, {_WEEKDAY_COLUMNS} FROM g GROUP BY hour"""


_BEHAVIOUR_SQL = f"""
WITH oc AS (SELECT customer_id, count(order_id) AS order_count FROM ol_clean_orders GROUP BY customer_id),
av AS (SELECT o.customer_id, {_money_sum('p.payment_value')} / count(p.payment_value) AS average_order_value
       FROM ol_clean_orders o JOIN ol_clean_payments p ON o.order_id = p.order_id GROUP BY o.customer_id)
SELECT oc.customer_id, oc.order_count, av.average_order_value
FROM oc JOIN av ON oc.customer_id = av.customer_id"""

_BEHAVIOUR_ORDER_GRAIN_SQL = f"""
WITH po AS (SELECT order_id, sum(CAST(CAST(payment_value AS VARCHAR) AS DECIMAL(38,10))) AS paid
            FROM ol_clean_payments GROUP BY order_id),
oc AS (SELECT customer_id, count(order_id) AS order_count FROM ol_clean_orders GROUP BY customer_id),
av AS (SELECT o.customer_id, CAST(CAST(sum(po.paid) AS VARCHAR) AS DOUBLE) / count(po.paid) AS average_order_value
       FROM ol_clean_orders o JOIN po ON o.order_id = po.order_id GROUP BY o.customer_id)
SELECT oc.customer_id, oc.order_count, av.average_order_value
FROM oc JOIN av ON oc.customer_id = av.customer_id"""


def _trade_balance_sql(route_columns: str, items_view: str) -> str:
    return f"""
WITH r AS (SELECT DISTINCT {route_columns}
           FROM {items_view} i JOIN ol_sellers s ON i.seller_id = s.seller_id
           JOIN ol_clean_orders o ON i.order_id = o.order_id
           JOIN ol_customers c ON c.customer_id = o.customer_id),
sell AS (SELECT seller_state, {_money_sum('price')} AS sell_value FROM r GROUP BY seller_state),
buy AS (SELECT customer_state, {_money_sum('price')} AS buy_value FROM r GROUP BY customer_state)
SELECT b.customer_state, b.buy_value, b.customer_state AS seller_state,
       COALESCE(s.sell_value, 0) AS sell_value,
       COALESCE(s.sell_value, 0) - b.buy_value AS margin_activity,
       {_margin_case('(COALESCE(s.sell_value, 0) - b.buy_value)')} AS margin_category
FROM buy b LEFT JOIN sell s ON b.customer_state = s.seller_state"""


_ROUTE_COLUMNS = "i.order_id, i.price, i.seller_id, s.seller_state, o.customer_id, c.customer_state"

_ACTIVE_SQL = """
SELECT CAST(year(o.order_approved_at) AS INTEGER) AS year,
       count(DISTINCT i.seller_id) AS active_seller, count(DISTINCT i.product_id) AS product_count
FROM ol_items i JOIN ol_clean_orders o ON i.order_id = o.order_id
JOIN ol_clean_payments p ON i.order_id = p.order_id
JOIN ol_sellers s ON i.seller_id = s.seller_id
JOIN ol_products pr ON i.product_id = pr.product_id
{where}
GROUP BY 1"""

_SHARE_SQL = f"""
WITH c AS (SELECT customer_state, count({{agg}}) AS no_customers FROM ol_customers GROUP BY customer_state)
SELECT customer_state, no_customers,
  {_round2('no_customers / CAST(sum(no_customers) OVER () AS DOUBLE) * 100')} AS percentage_customer_base,
  {_round2('CAST(sum(no_customers) OVER (ORDER BY no_customers DESC) AS DOUBLE) / CAST(sum(no_customers) OVER () AS DOUBLE) * 100')}
    AS running_total_percentage
FROM c"""

_GROWTH_SQL = f"""
WITH m AS (SELECT i.seller_id, strftime(o.order_purchase_timestamp, '%Y-%m') AS year_month,
                  CAST({_money_sum('i.price')} AS FLOAT) AS monthly_sales
           FROM ol_clean_orders o JOIN ol_items i ON o.order_id = i.order_id GROUP BY 1, 2),
l AS (SELECT *, lag(monthly_sales) OVER w AS prev_sales,
             lag(year_month) OVER w AS prev_month
      FROM m WINDOW w AS (PARTITION BY seller_id ORDER BY year_month ASC NULLS FIRST)),
k AS (SELECT seller_id, year_month, monthly_sales,
             {{prev}} AS prev_month_sales FROM l)
SELECT seller_id, year_month, monthly_sales, prev_month_sales,
       CAST(monthly_sales - prev_month_sales AS DOUBLE) / NULLIF(CAST(prev_month_sales AS DOUBLE), 0) * 100
         AS sales_growth_percentage
FROM k"""

_CALENDAR_PREV = ("CASE WHEN CAST(strptime(prev_month || '-01', '%Y-%m-%d') AS DATE) + INTERVAL 1 MONTH "
                  "= CAST(strptime(year_month || '-01', '%Y-%m-%d') AS DATE) THEN prev_sales END")


# Q1-Q10 -----------------------------------------------------------------------------------------
@register("pivot_payment_type_by_state", "SELECT d.customer_state, " + ", ".join(
    f"count(*) FILTER (WHERE p.payment_type = '{t}') AS \"{t}\"" for t in PAYMENT_TYPES) + """
FROM ol_clean_orders o JOIN ol_customers d ON o.customer_id = d.customer_id
JOIN ol_clean_payments p ON o.order_id = p.order_id GROUP BY d.customer_state""")
def _q1(v: OrderViews) -> DataFrame:
    return A.pivot_payment_type_by_state(v.clean_orders, v.customers, v.clean_payments)


def _pivot_sql(payments_view: str, null_column: str | None) -> str:
    cells = [f"count(*) FILTER (WHERE p.payment_type = '{t}') AS \"{t}\"" for t in PAYMENT_TYPES]
    if null_column is not None:
        cells.insert(0, f"count(*) FILTER (WHERE p.payment_type IS NULL) AS \"{null_column}\"")
    return (f"SELECT d.customer_state, {', '.join(cells)} FROM ol_clean_orders o "
            f"JOIN ol_customers d ON o.customer_id = d.customer_id "
            f"JOIN {payments_view} p ON o.order_id = p.order_id GROUP BY d.customer_state")


@register("pivot_payment_type_declared_values", _pivot_sql("ol_clean_payments", None))
def _q1_declared(v: OrderViews) -> DataFrame:
    return A.pivot_payment_type_by_state(v.clean_orders, v.customers, v.clean_payments, values=PAYMENT_TYPES)


@register("pivot_payment_type_by_state_null_type", _pivot_sql("ol_payments_partly_untyped", "null"))
def _q1_null_type(v: OrderViews) -> DataFrame:
    return A.pivot_payment_type_by_state(v.clean_orders, v.customers, v.payments_partly_untyped)


@register("pivot_payment_type_by_state_unknown_label", _pivot_sql("ol_payments_partly_untyped", "unknown"))
def _q1_unknown_label(v: OrderViews) -> DataFrame:
    return A.pivot_payment_type_by_state(v.clean_orders, v.customers, v.payments_partly_untyped,
                                         null_label="unknown")


@register("payment_summary_null_type", f"""
SELECT payment_type, {_money_sum('payment_value')} AS total_payment_value,
       avg(payment_installments) AS avg_installments
FROM ol_payments_partly_untyped GROUP BY payment_type""")
def _q6_null_type(v: OrderViews) -> DataFrame:
    return A.payment_summary(v.payments_partly_untyped)


@register("active_sellers_by_year", _ACTIVE_SQL.format(where=""))
def _q2(v: OrderViews) -> DataFrame:
    return A.active_sellers_by_year(v.items, v.clean_orders, v.clean_payments, v.sellers, v.products)


@register("active_sellers_by_year_with_gaps", _ACTIVE_SQL.format(where="").replace("ol_clean_payments", "ol_some_payments")
          .replace("ol_sellers", "ol_some_sellers").replace("ol_products", "ol_some_products"))
def _q2_gaps(v: OrderViews) -> DataFrame:
    """Items whose payment, seller or product is missing."""
    return A.active_sellers_by_year(v.items, v.clean_orders, v.some_payments, v.some_sellers, v.some_products)


@register("active_sellers_by_year_approximate", f"""
SELECT year, active_seller, product_count, true AS seller_estimate_within, true AS product_estimate_within
FROM ({_ACTIVE_SQL.format(where="")}) t""")
def _q2_approximate(v: OrderViews) -> DataFrame:
    """Sketches by year and month, stored, united by year and held against the exact counts."""
    tables = (v.items, v.clean_orders, v.clean_payments, v.sellers, v.products)
    guessed = A.active_sellers_of_sketches(store(A.active_seller_sketches(*tables), "sketches"))
    exact = A.active_sellers_by_year(*tables)
    bound = sketches.error_bound()
    guessed = guessed.select(F.col("year").alias("period"), F.col("active_seller").alias("sellers"), F.col("product_count").alias("products"))
    return exact.join(guessed, F.col("year").eqNullSafe(F.col("period"))).select(
        "year", "active_seller", "product_count",
        (F.abs(F.col("sellers") - F.col("active_seller")) <= F.col("active_seller") * bound).alias("seller_estimate_within"),
        (F.abs(F.col("products") - F.col("product_count")) <= F.col("product_count") * bound).alias("product_estimate_within"))


@register("active_sellers_by_year_status", _ACTIVE_SQL.format(where="WHERE o.order_status IN ('F')"))
def _q2_status(v: OrderViews) -> DataFrame:
    return A.active_sellers_by_year(v.items, v.clean_orders, v.clean_payments, v.sellers, v.products,
                                    status_in=["F"])


@register("customer_share_by_state", _SHARE_SQL.format(agg="customer_unique_id"))
def _q3(v: OrderViews) -> DataFrame:
    return A.customer_share_by_state(v.customers)


@register("customer_share_by_state_distinct", _SHARE_SQL.format(agg="DISTINCT customer_unique_id"))
def _q3_distinct(v: OrderViews) -> DataFrame:
    return A.customer_share_by_state(v.customers, distinct=True)


@register("customer_share_by_state_shared_ids",
          _SHARE_SQL.format(agg="DISTINCT customer_unique_id").replace("ol_customers", "ol_shared_customers"))
def _q3_shared(v: OrderViews) -> DataFrame:
    return A.customer_share_by_state(v.shared_customers, distinct=True)


@register("state_trade_balance", _trade_balance_sql(_ROUTE_COLUMNS, "ol_items_bucketed"))
def _q4(v: OrderViews) -> DataFrame:
    return A.trade_balance_of_tables(v.items_bucketed, v.sellers, v.clean_orders, v.customers)


@register("state_trade_balance_of_route", _trade_balance_sql(_ROUTE_COLUMNS, "ol_items_bucketed"))
def _q4_route(v: OrderViews) -> DataFrame:
    return A.state_trade_balance(A.item_route(v.spark, v.items_bucketed, v.sellers, v.clean_orders, v.customers))


@register("state_trade_balance_subcent", _trade_balance_sql(_ROUTE_COLUMNS, "ol_items_subcent"))
def _q4_subcent(v: OrderViews) -> DataFrame:
    return A.trade_balance_of_tables(v.items_subcent, v.sellers, v.clean_orders, v.customers)


@register("state_trade_balance_with_gaps", _trade_balance_sql(_ROUTE_COLUMNS, "ol_items_bucketed")
          .replace("ol_sellers", "ol_some_sellers").replace("ol_customers", "ol_shared_customers"))
def _q4_gaps(v: OrderViews) -> DataFrame:
    """States without sellers and states without buyers."""
    return A.trade_balance_of_tables(v.items_bucketed, v.some_sellers, v.clean_orders, v.shared_customers)


@register("state_trade_balance_item_grain",
          _trade_balance_sql("i.order_item_id, " + _ROUTE_COLUMNS, "ol_items_bucketed"))
def _q4_item_grain(v: OrderViews) -> DataFrame:
    return A.trade_balance_of_tables(v.items_bucketed, v.sellers, v.clean_orders, v.customers,
                                     extra_item_columns=["order_item_id"])


@register("hour_weekday_matrix", _hour_weekday_sql("ol_clickstream_orders"))
def _q5(v: OrderViews) -> DataFrame:
    return A.hour_weekday_matrix(v.clickstream_orders)


@register("hour_weekday_matrix_orders", _hour_weekday_sql("ol_clean_orders"))
def _q5_orders(v: OrderViews) -> DataFrame:
    return A.hour_weekday_matrix(v.clean_orders)


@register("payment_summary", f"""
SELECT payment_type, {_money_sum('payment_value')} AS total_payment_value,
       avg(payment_installments) AS avg_installments
FROM ol_clean_payments GROUP BY payment_type""")
def _q6(v: OrderViews) -> DataFrame:
    return A.payment_summary(v.clean_payments)


@register("payment_summary_subcent", f"""
SELECT payment_type, {_money_sum('payment_value')} AS total_payment_value,
       avg(payment_installments) AS avg_installments
FROM ol_payments_subcent GROUP BY payment_type""")
def _q6_subcent(v: OrderViews) -> DataFrame:
    return A.payment_summary(v.payments_subcent)


@register("orders_per_state", """
SELECT c.customer_state, count(o.order_id) AS order_count
FROM ol_customers c JOIN ol_clean_orders o ON c.customer_id = o.customer_id GROUP BY c.customer_state""")
def _q7(v: OrderViews) -> DataFrame:
    return A.orders_per_state(v.customers, v.clean_orders)


@register("customer_behaviour", _BEHAVIOUR_SQL)
def _q8(v: OrderViews) -> DataFrame:
    return A.customer_behaviour(v.clean_orders, v.clean_payments)


@register("customer_behaviour_order_grain", _BEHAVIOUR_ORDER_GRAIN_SQL)
def _q8_order_grain(v: OrderViews) -> DataFrame:
    return A.customer_behaviour(v.clean_orders, v.clean_payments, grain="order")


@register("customer_behaviour_subcent", _BEHAVIOUR_SQL.replace("ol_clean_payments", "ol_payments_subcent"))
def _q8_subcent(v: OrderViews) -> DataFrame:
    return A.customer_behaviour(v.clean_orders, v.payments_subcent)


@register("customer_behaviour_with_gaps", _BEHAVIOUR_SQL.replace("ol_clean_payments", "ol_some_payments"))
def _q8_gaps(v: OrderViews) -> DataFrame:
    """Orders, and customers, without a payment."""
    return A.customer_behaviour(v.clean_orders, v.some_payments)


@register("customer_behaviour_count", f"SELECT count(*) AS row_count FROM ({_BEHAVIOUR_SQL}) t")
def _p4(v: OrderViews) -> DataFrame:
    return quality.row_count(A.customer_behaviour(v.clean_orders, v.clean_payments))


@register("top_customers", f"""
SELECT * FROM ({_BEHAVIOUR_SQL}) t ORDER BY average_order_value DESC NULLS LAST, customer_id LIMIT 20""")
def _o4(v: OrderViews) -> DataFrame:
    return A.top_customers(A.customer_behaviour(v.clean_orders, v.clean_payments), 20)


@register("value_by_product_size", f"""
SELECT {_size_case('p')} AS product_size_category,
       {_round2(_money_sum('i.price') + ' / count(i.price)')} AS average_order_value
FROM ol_items i JOIN ol_products p ON i.product_id = p.product_id GROUP BY 1""")
def _q9(v: OrderViews) -> DataFrame:
    return A.value_by_product_size(v.items, v.products)


@register("value_by_product_size_subcent", f"""
SELECT {_size_case('p')} AS product_size_category,
       {_round2(_money_sum('i.price') + ' / count(i.price)')} AS average_order_value
FROM ol_items_subcent i JOIN ol_products p ON i.product_id = p.product_id GROUP BY 1""")
def _q9_subcent(v: OrderViews) -> DataFrame:
    return A.value_by_product_size(v.items_subcent, v.products)


@register("seller_monthly_growth_subcent", _GROWTH_SQL.format(prev="prev_sales").replace(
    "JOIN ol_items i ON", "JOIN ol_items_subcent i ON"))
def _q10_subcent(v: OrderViews) -> DataFrame:
    return A.seller_monthly_growth(v.clean_orders, v.items_subcent)


@register("seller_monthly_growth", _GROWTH_SQL.format(prev="prev_sales"))
def _q10(v: OrderViews) -> DataFrame:
    return A.seller_monthly_growth(v.clean_orders, v.items)


@register("seller_monthly_growth_bucketed", _GROWTH_SQL.format(prev="prev_sales").replace(
    "JOIN ol_items i ON", "JOIN ol_items_bucketed i ON"))
def _q10_bucketed(v: OrderViews) -> DataFrame:
    """Bucketed prices make whole months sum to 0, so growth against a zero month is exercised."""
    return A.seller_monthly_growth(v.clean_orders, v.items_bucketed)


@register("seller_monthly_growth_calendar", _GROWTH_SQL.format(prev=_CALENDAR_PREV))
def _q10_calendar(v: OrderViews) -> DataFrame:
    return A.seller_monthly_growth(v.clean_orders, v.items, calendar=True)


# Loads that add up --------------------------------------------------------------------------------
LOADS = 3


@register("payment_summary_merged_loads", f"""
SELECT payment_type, {_money_sum('payment_value')} AS total_payment_value,
       avg(payment_installments) AS avg_installments
FROM ol_clean_payments GROUP BY payment_type""")
def _q6_merged(v: OrderViews) -> DataFrame:
    """Q6 from three loads of payments; the second comes twice, first in part."""
    path, payments = new_path(v.spark, "payment-loads"), v.clean_payments
    load = F.pmod(F.col("order_id"), F.lit(LOADS))
    partials.add_load(A.payment_partials(payments.where((load == 1) & (F.col("payment_value") > 100_000))), path, "1")
    for i in reversed(range(LOADS)):
        partials.add_load(A.payment_partials(payments.where(load == i)), path, str(i))
    return A.payment_summary_of_partials(partials.all_loads(v.spark, path, ["payment_type"]))


@register("seller_monthly_growth_merged_loads", _GROWTH_SQL.format(prev="prev_sales"))
def _q10_merged(v: OrderViews) -> DataFrame:
    """Q10 from three loads of orders with their items; months and sellers are in several loads."""
    path, load = new_path(v.spark, "sales-loads"), F.pmod(F.col("order_id"), F.lit(LOADS))
    for i in range(LOADS):
        partials.add_load(A.seller_month_sums(v.clean_orders.where(load == i), v.items.where(load == i)), path, str(i))
    return A.seller_growth_of_sums(partials.all_loads(v.spark, path, ["seller_id", "month"]))


# Results on disk ----------------------------------------------------------------------------------
@register("result_with_a_month_rewritten", _GROWTH_SQL.format(prev="prev_sales"))
def _s4_rewritten(v: OrderViews) -> DataFrame:
    """Growth by month folders, where one month was written wrong and is then replaced alone."""
    path, month = new_path(v.spark, "growth"), "1997-05"
    growth = A.seller_monthly_growth(v.clean_orders, v.items)
    wrong = growth.where(F.col("year_month") != month).unionByName(growth.where(F.col("year_month") == month).withColumn("monthly_sales", F.lit(-1).cast("float")))
    write_result(wrong, path, partition_by=["year_month"])
    write_result(growth.where(F.col("year_month") == month), path, partition_by=["year_month"], mode="replace_partitions")
    return v.spark.read.schema(growth.schema).parquet(path).select(*growth.columns)


@register("result_in_written_order", f"""
SELECT *, row_number() OVER (ORDER BY average_order_value DESC NULLS LAST, customer_id) AS place FROM ({_BEHAVIOUR_SQL}) t""")
def _s4_ordered(v: OrderViews) -> DataFrame:
    """Q8 written in its order; the places are told from files and rows, without the order columns."""
    path = new_path(v.spark, "behaviour")
    write_ordered(A.customer_behaviour(v.clean_orders, v.clean_payments), path, F.col("average_order_value").desc_nulls_last(), F.col("customer_id").asc())
    rows = read_ordered(v.spark, path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)                          # one row a file
    files = rows.groupBy(F.col("position.file").alias("file")).count().select("file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return rows.join(files, F.col("position.file") == F.col("file")).select(
        "customer_id", "order_count", "average_order_value", (F.col("before") + F.col("position.row") + 1).alias("place"))


# Text files ---------------------------------------------------------------------------------------
_SPOILT = """
WITH p AS (SELECT order_id, payment_sequential, payment_type,
                  CASE WHEN order_id % 89 = 0 THEN 'many' ELSE CAST(payment_installments AS VARCHAR) END AS payment_installments,
                  CASE WHEN order_id % 97 = 0 THEN 'n/a' ELSE CAST(payment_value AS VARCHAR) END AS payment_value
           FROM ol_clean_payments)
"""


def _loaded_payments(v: OrderViews):
    """The payments as CSV files, with some cells spoilt, loaded in one scan."""
    text = v.clean_payments.select(
        F.col("order_id").cast("string").alias("order_id"), F.col("payment_sequential").cast("int").alias("payment_sequential"), "payment_type",
        F.when(F.col("order_id") % 89 == 0, "many").otherwise(F.col("payment_installments").cast("string")).alias("payment_installments"),
        F.when(F.col("order_id") % 97 == 0, "n/a").otherwise(F.col("payment_value").cast("string")).alias("payment_value"))
    path = new_path(v.spark, "payments-csv")
    text.write.option("header", True).csv(path)
    return load_csv(v.spark, path, "payments", new_path(v.spark, "payments-loaded"))


@register("csv_good_rows", _SPOILT + """
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(payment_sequential AS INTEGER) AS payment_sequential, payment_type,
       TRY_CAST(payment_installments AS INTEGER) AS payment_installments, TRY_CAST(payment_value AS DOUBLE) AS payment_value
FROM p WHERE payment_installments <> 'many' AND payment_value <> 'n/a'""")
def _s1_good(v: OrderViews) -> DataFrame:
    return _loaded_payments(v).good


@register("csv_quarantined_cells", _SPOILT + """
SELECT "column", text, count(*) AS cells FROM (
  SELECT 'payment_installments' AS "column", payment_installments AS text FROM p WHERE payment_installments = 'many'
  UNION ALL SELECT 'payment_value', payment_value FROM p WHERE payment_value = 'n/a') t GROUP BY ALL""")
def _s1_bad(v: OrderViews) -> DataFrame:
    return _loaded_payments(v).bad.groupBy("column", "text").agg(F.count("*").alias("cells"))


# Sources, joins, projections --------------------------------------------------------------------
@register("sql_item_route", f"""
SELECT {_ROUTE_COLUMNS}
FROM ol_items i JOIN ol_sellers s ON i.seller_id = s.seller_id
JOIN ol_clean_orders o ON i.order_id = o.order_id
JOIN ol_customers c ON c.customer_id = o.customer_id""")
def _s3(v: OrderViews) -> DataFrame:
    return A.item_route(v.spark, v.items, v.sellers, v.clean_orders, v.customers)


@register("sql_route_of_views", f"""
SELECT {_ROUTE_COLUMNS}
FROM ol_items i JOIN ol_sellers s ON i.seller_id = s.seller_id
JOIN ol_clean_orders o ON i.order_id = o.order_id
JOIN ol_customers c ON c.customer_id = o.customer_id""")
def _s2(v: OrderViews) -> DataFrame:
    """SQL text over temp views, named for this call and dropped once the text is resolved."""
    tables = {"items": v.items, "sellers": v.sellers, "orders": v.clean_orders, "customers": v.customers}
    names = dict(zip(tables, publish(tables, prefix=f"view_{uuid.uuid4().hex}_")))
    try:
        return run_sql(v.spark, f"SELECT {', '.join(A.ROUTE_COLUMNS)} {A.ROUTE_FROM.format(**names)}")
    finally:
        for name in names.values():
            v.spark.catalog.dropTempView(name)


BUCKETS = 8


def _by_order(v: OrderViews, **frames: DataFrame) -> dict[str, DataFrame]:
    """The frames written into buckets of order_id and read back; the table names are dropped, the files stay."""
    out = {}
    for name, df in frames.items():
        table = f"{name}_{uuid.uuid4().hex}"
        out[name] = write_bucketed(df, table, "order_id", BUCKETS, path=new_path(v.spark, name))
        v.spark.sql(f"DROP TABLE {table}")
    return out


@register("sql_item_route_bucketed", f"""
SELECT {_ROUTE_COLUMNS}
FROM ol_items i JOIN ol_sellers s ON i.seller_id = s.seller_id
JOIN ol_clean_orders o ON i.order_id = o.order_id
JOIN ol_customers c ON c.customer_id = o.customer_id""")
def _j6_bucketed(v: OrderViews) -> DataFrame:
    """The route as SQL text over bucketed items and orders: they meet first, without a shuffle."""
    t = _by_order(v, items=v.items, orders=v.clean_orders)
    return run_sql(v.spark, f"SELECT {', '.join(A.ROUTE_COLUMNS)} FROM {{items}} AS i JOIN {{orders}} AS o ON i.order_id = o.order_id "
                   "JOIN {sellers} AS s ON i.seller_id = s.seller_id JOIN {customers} AS c ON o.customer_id = c.customer_id",
                   sellers=v.sellers, customers=v.customers, **t)


@register("join_inner_using_bucketed", """
SELECT * FROM ol_clean_orders JOIN ol_clean_payments USING (order_id)""")
def _j1_bucketed(v: OrderViews) -> DataFrame:
    t = _by_order(v, orders=v.clean_orders, payments=v.clean_payments)
    return t["orders"].join(t["payments"], "order_id")


@register("join_inner_multiway_bucketed", """
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price, o.order_approved_at,
       p.payment_sequential, p.payment_type, s.seller_state, pr.product_category_name
FROM ol_items i JOIN ol_clean_orders o ON i.order_id = o.order_id
JOIN ol_clean_payments p ON i.order_id = p.order_id
JOIN ol_sellers s ON i.seller_id = s.seller_id
JOIN ol_products pr ON i.product_id = pr.product_id""")
def _j2_bucketed(v: OrderViews) -> DataFrame:
    """The three tables keyed by order meet bucket by bucket, the two others by their own keys."""
    return _multiway(v, **_by_order(v, items=v.items, orders=v.clean_orders, payments=v.clean_payments))


_SOLD_IN_STATE = """
SELECT i.order_id, i.order_item_id, i.price, o.customer_id, p.payment_type, pr.product_category_name
FROM {items} i JOIN {orders} o ON i.order_id = o.order_id
JOIN {payments} p ON i.order_id = p.order_id
JOIN {products} pr ON i.product_id = pr.product_id
JOIN {sellers} s ON i.seller_id = s.seller_id
WHERE s.seller_state = 'NATION_7'"""


@register("join_multiway_by_statistics", _SOLD_IN_STATE.format(
    items="ol_items", orders="ol_clean_orders", payments="ol_clean_payments", products="ol_products", sellers="ol_sellers"))
def _j2_statistics(v: OrderViews) -> DataFrame:
    """The filtered sellers stand last in the text; by statistics they meet the items first."""
    keys = {"items": ["order_id", "product_id", "seller_id"], "orders": ["order_id", "customer_id"], "payments": ["order_id"],
            "products": ["product_id"], "sellers": ["seller_id", "seller_state"]}
    frames = {"items": v.items, "orders": v.clean_orders, "payments": v.clean_payments, "products": v.products, "sellers": v.sellers}
    tables = {}
    for name, df in frames.items():
        table = f"{name}_{uuid.uuid4().hex}"
        tables[name] = save_analyzed(df, table, path=new_path(v.spark, name), columns=keys[name])
        v.spark.sql(f"DROP TABLE {table}")                   # the frame keeps the files and their statistics
    return run_sql(v.spark, _SOLD_IN_STATE, **tables)


@register("bucket_load_of_items", f"""
SELECT CAST(count(*) AS BIGINT) AS keys, CAST(sum(n) AS BIGINT) AS rows, max(n) AS rows_of_largest_key
FROM (SELECT order_id, count(*) AS n FROM ol_items GROUP BY order_id) t""")
def _bucket_load(v: OrderViews) -> DataFrame:
    """Over all buckets, as SQL has no equal of the bucket's hash."""
    load = bucket_load(v.items, "order_id", BUCKETS)
    return load.agg(F.sum("keys").alias("keys"), F.sum("rows").alias("rows"), F.max("rows_of_largest_key").alias("rows_of_largest_key"))


@register("project_columns", "SELECT order_purchase_timestamp, order_id FROM ol_clean_orders")
def _r1(v: OrderViews) -> DataFrame:
    return relational.project(v.clean_orders, ["order_purchase_timestamp", "order_id"])


@register("join_inner_using", """
SELECT * FROM ol_clean_orders JOIN ol_customers USING (customer_id)""")
def _j1(v: OrderViews) -> DataFrame:
    return v.clean_orders.join(v.customers, "customer_id")


@register("join_inner_multiway", """
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price, o.order_approved_at,
       p.payment_sequential, p.payment_type, s.seller_state, pr.product_category_name
FROM ol_items i JOIN ol_clean_orders o ON i.order_id = o.order_id
JOIN ol_clean_payments p ON i.order_id = p.order_id
JOIN ol_sellers s ON i.seller_id = s.seller_id
JOIN ol_products pr ON i.product_id = pr.product_id""")
def _j2(v: OrderViews) -> DataFrame:
    return _multiway(v, v.items, v.clean_orders, v.clean_payments)


def _multiway(v: OrderViews, items: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    i, o, p = items.alias("i"), orders.alias("o"), payments.alias("p")
    s, pr = v.sellers.alias("s"), v.products.alias("pr")
    joined = (i.join(o, F.col("i.order_id") == F.col("o.order_id"))
              .join(p, F.col("i.order_id") == F.col("p.order_id"))
              .join(s, F.col("i.seller_id") == F.col("s.seller_id"))
              .join(pr, F.col("i.product_id") == F.col("pr.product_id")))
    return joined.select("i.order_id", "i.order_item_id", "i.product_id", "i.seller_id", "i.price",
                         "o.order_approved_at", "p.payment_sequential", "p.payment_type",
                         "s.seller_state", "pr.product_category_name")


_LEFT_COUNTS_SQL = """
WITH b AS (SELECT customer_state, count(customer_id) AS customers FROM ol_customers GROUP BY customer_state),
s AS (SELECT seller_state, count(seller_id) AS sellers FROM ol_sellers GROUP BY seller_state)
SELECT b.customer_state, b.customers, b.customer_state AS seller_state, COALESCE(s.sellers, 0) AS sellers
FROM b LEFT JOIN s ON b.customer_state = s.seller_state"""


@register("join_left_expression", _LEFT_COUNTS_SQL)
def _j5(v: OrderViews) -> DataFrame:
    return A.state_counts_left_join(v.customers, v.sellers)


@register("join_left_expression_with_gaps", _LEFT_COUNTS_SQL.replace("ol_sellers", "ol_some_sellers"))
def _j5_gaps(v: OrderViews) -> DataFrame:
    """States without sellers take the filled 0."""
    return A.state_counts_left_join(v.customers, v.some_sellers)


@register("join_left_semi_exists_with_gaps", """
SELECT * FROM ol_items i
WHERE i.order_id IN (SELECT order_id FROM ol_some_payments)
  AND i.seller_id IN (SELECT seller_id FROM ol_some_sellers)
  AND i.product_id IN (SELECT product_id FROM ol_some_products)""")
def _j3_gaps(v: OrderViews) -> DataFrame:
    return relational.semi_filter(v.items, (v.some_payments, "order_id"), (v.some_sellers, "seller_id"),
                                  (v.some_products, "product_id"))


@register("join_left_semi_exists", """
SELECT * FROM ol_items i
WHERE i.order_id IN (SELECT order_id FROM ol_clean_payments)
  AND i.seller_id IN (SELECT seller_id FROM ol_sellers)
  AND i.product_id IN (SELECT product_id FROM ol_products)""")
def _j3(v: OrderViews) -> DataFrame:
    return relational.semi_filter(v.items, (v.clean_payments, "order_id"), (v.sellers, "seller_id"),
                                  (v.products, "product_id"))


# Cleaning ---------------------------------------------------------------------------------------
@register("clean_trim_columns", """
SELECT product_id, trim(product_name) AS product_name, trim(product_brand) AS product_brand,
       trim(product_category_name) AS product_category_name, product_size FROM ol_products_padded""")
def _c1(v: OrderViews) -> DataFrame:
    return cleaning.trim_columns(v.products_padded)


@register("clean_collapse_whitespace", """
SELECT product_id, regexp_replace(product_name, '\\s+', ' ', 'g') AS product_name,
       regexp_replace(product_brand, '\\s+', ' ', 'g') AS product_brand,
       regexp_replace(product_category_name, '\\s+', ' ', 'g') AS product_category_name,
       product_size FROM ol_products_padded""")
def _c2(v: OrderViews) -> DataFrame:
    return cleaning.collapse_whitespace(v.products_padded)


@register("clean_replace_values", """
SELECT customer_id,
       CASE WHEN customer_unique_id = 'NATION_1' THEN 'NATION_ONE' ELSE customer_unique_id END
         AS customer_unique_id,
       CASE WHEN customer_state = 'NATION_1' THEN 'NATION_ONE' ELSE customer_state END AS customer_state
FROM ol_customers""")
def _c3(v: OrderViews) -> DataFrame:
    return cleaning.replace_values(v.customers, {"NATION_1": "NATION_ONE"})


@register("clean_drop_nulls", "SELECT * FROM ol_clean_orders")
def _c4(v: OrderViews) -> DataFrame:
    return cleaning.drop_nulls(v.orders)


@register("clean_drop_nulls_subset", """
SELECT order_id, order_approved_at FROM ol_orders
WHERE order_id IS NOT NULL AND order_approved_at IS NOT NULL""")
def _c5(v: OrderViews) -> DataFrame:
    return cleaning.drop_nulls(v.orders.select("order_id", "order_approved_at"))


_TRANSLATE_SQL = """
SELECT p.product_id, t.product_category_name_english AS product_category_name, p.product_length_cm,
       p.product_width_cm, p.product_height_cm, p.product_weight_g
FROM ol_products p LEFT JOIN ol_category_translation t
  ON p.product_category_name = t.product_category_name"""


@register("clean_lookup_translate", _TRANSLATE_SQL)
def _c8(v: OrderViews) -> DataFrame:
    return cleaning.lookup_translate(v.products, v.category_translation, "product_category_name",
                                     "product_category_name_english")


@register("clean_lookup_translate_join", _TRANSLATE_SQL)
def _c8_join(v: OrderViews) -> DataFrame:
    """The same translation under a collation, for names spelt in other case."""
    spelt = v.products.withColumn("product_category_name", F.when(F.col("product_id") % 2 == 0, F.lower("product_category_name"))
                                  .otherwise(F.col("product_category_name")))
    return cleaning.lookup_translate(spelt, v.category_translation, "product_category_name",
                                     "product_category_name_english", collation=cleaning.SPELLINGS)


@register("clean_unify_spellings", """
WITH s AS (SELECT *, CASE WHEN customer_id % 3 = 0 THEN lower(customer_state) WHEN customer_id % 3 = 1 THEN replace(customer_state, 'A', '\u00c3')
                     ELSE customer_state END AS spelt FROM ol_customers)
SELECT customer_id, customer_unique_id, min(spelt) OVER (PARTITION BY customer_state) AS customer_state FROM s""")
def _c3_spellings(v: OrderViews) -> DataFrame:
    """States in three spellings become one, the smallest (capitals)."""
    state = F.col("customer_state")
    spelt = F.when(F.col("customer_id") % 3 == 0, F.lower(state)).when(F.col("customer_id") % 3 == 1, F.regexp_replace(state, "A", "\u00c3")).otherwise(state)
    return cleaning.unify_spellings(v.customers.withColumn("customer_state", spelt), ["customer_state"])


@register("clean_conditional_override", "SELECT * FROM ol_clean_payments")
def _c9(v: OrderViews) -> DataFrame:
    return cleaning.zero_undefined_installments(v.payments, undefined=UNDEFINED_PAYMENT_TYPE)


@register("clean_dedupe_rows", "SELECT DISTINCT order_id, seller_id, price FROM ol_items_bucketed")
def _c10(v: OrderViews) -> DataFrame:
    return cleaning.dedupe_rows(v.items_bucketed.select("order_id", "seller_id", "price"))


# Quality ----------------------------------------------------------------------------------------
_ORDER_COLUMNS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at"]
_ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in _ORDER_COLUMNS)


@register("quality_clean_counts", f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_ALL_PRESENT}) AS rows_after,
       count(*) - count(*) FILTER (WHERE {_ALL_PRESENT}) AS rows_dropped FROM ol_orders""")
def _p1(v: OrderViews) -> DataFrame:
    return quality.clean_counts(v.orders)


@register("quality_null_audit", "SELECT count(*) AS rows_total, "
          f"count(*) FILTER (WHERE NOT ({_ALL_PRESENT})) AS rows_with_null, "
          + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in _ORDER_COLUMNS)
          + " FROM ol_orders")
def _p2(v: OrderViews) -> DataFrame:
    return quality.null_audit(v.orders)


def _written_orders(v: OrderViews) -> quality.CleanFigures:
    return quality.write_clean(v.orders, new_path(v.spark, "clean-orders"))


@register("quality_observed_clean_counts", f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_ALL_PRESENT}) AS rows_after,
       count(*) - count(*) FILTER (WHERE {_ALL_PRESENT}) AS rows_dropped FROM ol_orders""")
def _p1_observed(v: OrderViews) -> DataFrame:
    """Counted inside the job that writes the cleaned orders."""
    return _written_orders(v).clean_counts


@register("quality_observed_null_audit", "SELECT count(*) AS rows_total, "
          f"count(*) FILTER (WHERE NOT ({_ALL_PRESENT})) AS rows_with_null, "
          + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in _ORDER_COLUMNS)
          + " FROM ol_orders")
def _p2_observed(v: OrderViews) -> DataFrame:
    return _written_orders(v).null_audit


@register("quality_observed_row_count", f"SELECT count(*) AS row_count FROM ol_orders WHERE {_ALL_PRESENT}")
def _p4_observed(v: OrderViews) -> DataFrame:
    return _written_orders(v).row_count


@register("quality_duplicate_audit", """
SELECT count(*) AS rows_total, count(DISTINCT (order_id, seller_id, price)) AS rows_distinct,
       count(*) - count(DISTINCT (order_id, seller_id, price)) AS duplicate_rows
FROM ol_items_bucketed""")
def _p3(v: OrderViews) -> DataFrame:
    return quality.duplicate_audit(v.items_bucketed.select("order_id", "seller_id", "price"))


# Classifiers and scalar functions ---------------------------------------------------------------
@register("margin_category", f"""
WITH paid AS (SELECT order_id, {_money_sum('payment_value')} AS paid_value
              FROM ol_payments GROUP BY order_id),
goods AS (SELECT order_id, {_money_sum('price')} AS goods_value FROM ol_items_bucketed GROUP BY order_id)
SELECT p.order_id, p.paid_value, g.goods_value, p.paid_value - g.goods_value AS margin_activity,
       {_margin_case('(p.paid_value - g.goods_value)')} AS margin_category
FROM paid p JOIN goods g ON p.order_id = g.order_id""")
def _u1(v: OrderViews) -> DataFrame:
    paid = v.payments.groupBy("order_id").agg(exact_sum("payment_value").alias("paid_value"))
    goods = v.items_bucketed.groupBy("order_id").agg(exact_sum("price").alias("goods_value"))
    margin = F.col("paid_value") - F.col("goods_value")
    return paid.join(goods, "order_id").select(
        "order_id", "paid_value", "goods_value", margin.alias("margin_activity"),
        classify.margin_category(margin).alias("margin_category"))


@register("margin_category_balanced", f"""
WITH goods AS (SELECT order_id, {_money_sum('price')} AS goods_value FROM ol_items GROUP BY order_id),
m AS (SELECT order_id, CASE WHEN order_id % 3 = 0 THEN 0.0 ELSE goods_value - 150000 END AS margin_activity FROM goods)
SELECT order_id, CAST(margin_activity AS DOUBLE) AS margin_activity, {_margin_case('margin_activity')} AS margin_category FROM m""")
def _u1_balanced(v: OrderViews) -> DataFrame:
    """Every third order is balanced exactly; the others fall on both sides."""
    goods = v.items.groupBy("order_id").agg(exact_sum("price").alias("goods_value"))
    margin = F.when(F.col("order_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("goods_value") - 150000)
    return goods.select("order_id", margin.alias("margin_activity"), classify.margin_category(margin).alias("margin_category"))


@register("product_size_class", f"""
SELECT p.*, {_size_case('p')} AS product_size_category FROM ol_products p""")
def _u2(v: OrderViews) -> DataFrame:
    return A.size_classified(v.products)


@register("scalar_casts", """
SELECT order_id, CAST(order_purchase_timestamp AS VARCHAR) AS purchase_text,
       TRY_CAST(CAST(order_purchase_timestamp AS VARCHAR) AS TIMESTAMP) AS purchase_ts,
       TRY_CAST(order_status AS TIMESTAMP) AS status_ts,
       dayname(order_purchase_timestamp) AS purchase_day,
       CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour,
       strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
       CAST(year(order_approved_at) AS INTEGER) AS approved_year
FROM ol_orders""")
def _f5(v: OrderViews) -> DataFrame:
    text = F.col("order_purchase_timestamp").cast("string")
    return v.orders.select("order_id", text.alias("purchase_text"),
                           text_to_timestamp(text).alias("purchase_ts"),
                           text_to_timestamp("order_status").alias("status_ts"),
                           weekday_name("order_purchase_timestamp").alias("purchase_day"),
                           hour_of("order_purchase_timestamp").alias("purchase_hour"),
                           month_key("order_purchase_timestamp").alias("purchase_month"),
                           year_of("order_approved_at").alias("approved_year"))


_SIZES = "product_length_cm, p.product_width_cm, p.product_height_cm, p.product_weight_g"


@register("sql_product_size_class", f"""
SELECT {_size_case('p')} AS product_size_category, count(*) AS products FROM ol_products p GROUP BY 1""")
def _u2_sql(v: OrderViews) -> DataFrame:
    """The size class called by name from SQL text."""
    publish_classifiers(v.spark, "ol_")
    return run_sql(v.spark, f"SELECT ol_product_size_class(p.{_SIZES}) AS product_size_category, count(*) AS products "
                   "FROM {products} AS p GROUP BY 1", products=v.products)


@register("sql_margin_category", f"""
WITH goods AS (SELECT order_id, {_money_sum('price')} AS goods_value FROM ol_items GROUP BY order_id),
m AS (SELECT order_id, CASE WHEN order_id % 3 = 0 THEN 0.0 ELSE goods_value - 150000 END AS margin_activity FROM goods)
SELECT {_margin_case('margin_activity')} AS margin_category, count(*) AS orders FROM m GROUP BY 1""")
def _u1_sql(v: OrderViews) -> DataFrame:
    goods = v.items.groupBy("order_id").agg(exact_sum("price").alias("goods_value"))
    publish_classifiers(v.spark, "ol_")
    return run_sql(v.spark, "SELECT ol_margin_category(CASE WHEN order_id % 3 = 0 THEN 0D ELSE goods_value - 150000 END) AS margin_category, "
                   "count(*) AS orders FROM {goods} GROUP BY 1", goods=goods)


@register("sql_month_and_blanks", """
SELECT strftime(o.order_purchase_timestamp, '%Y-%m') AS purchase_month, count(*) AS orders FROM ol_orders o GROUP BY 1""")
def _f4_sql(v: OrderViews) -> DataFrame:
    publish_classifiers(v.spark, "ol_")
    return run_sql(v.spark, "SELECT ol_collapse_whitespace(ol_month_key(order_purchase_timestamp)) AS purchase_month, count(*) AS orders "
                   "FROM {orders} GROUP BY 1", orders=v.orders)
