"""Properties that hold on any data, checked on the sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import SF_SMALL
from orderlens.plans import analyses as A
from orderlens.sources.fixtures import OrderViews

Q = entry_module.queries()


@pytest.fixture(scope="module")
def views(spark):
    return OrderViews(spark, SF_SMALL)


def test_pivot_cells_sum_to_joined_rows(spark, views):
    pivot = Q["pivot_payment_type_by_state"](spark, SF_SMALL)
    cells = pivot.select(sum(F.col(f"`{c}`") for c in pivot.columns[1:]).alias("t")).agg(F.sum("t")).first()[0]
    joined = views.clean_orders.join(views.customers, "customer_id").join(views.clean_payments, "order_id").count()
    assert cells == joined


def test_shares_add_up(spark):
    rows = Q["customer_share_by_state"](spark, SF_SMALL).collect()
    assert abs(sum(r.percentage_customer_base for r in rows) - 100) < 0.01 * len(rows)
    assert rows[-1].running_total_percentage == 100.0
    assert all(a.running_total_percentage <= b.running_total_percentage for a, b in zip(rows, rows[1:]))


def test_sell_equals_buy_before_left_join(spark, views):
    route = A.item_route(spark, views.items_bucketed, views.sellers, views.clean_orders, views.customers).dropDuplicates()
    sell = route.groupBy("seller_state").agg(F.sum("price").alias("v")).agg(F.sum("v")).first()[0]
    buy = route.groupBy("customer_state").agg(F.sum("price").alias("v")).agg(F.sum("v")).first()[0]
    assert sell == pytest.approx(buy)


def test_hour_weekday_cells_sum_to_distinct_orders(spark, views):
    m = Q["hour_weekday_matrix"](spark, SF_SMALL)
    total = m.select(sum(F.coalesce(F.col(d), F.lit(0)) for d in m.columns[1:]).alias("t")).agg(F.sum("t")).first()[0]
    assert total == views.clickstream_orders.dropDuplicates().count()


def test_orders_per_state_sums_to_joined_orders(spark, views):
    total = Q["orders_per_state"](spark, SF_SMALL).agg(F.sum("order_count")).first()[0]
    assert total == views.clean_orders.join(views.customers, "customer_id").count()


def test_one_first_month_per_seller(spark):
    g = Q["seller_monthly_growth"](spark, SF_SMALL)
    firsts = g.where(F.col("prev_month_sales").isNull()).groupBy("seller_id").count()
    assert firsts.where("count != 1").count() == 0
    assert firsts.count() == g.select("seller_id").distinct().count()


def test_growth_null_exactly_where_previous_missing_or_zero(spark):
    g = Q["seller_monthly_growth_bucketed"](spark, SF_SMALL)
    counts = g.agg(
        F.count_if(F.col("sales_growth_percentage").isNull()).alias("null_growth"),
        F.count_if(F.col("prev_month_sales").isNull() | (F.col("prev_month_sales") == 0)).alias("no_base")).first()
    assert counts.null_growth == counts.no_base
