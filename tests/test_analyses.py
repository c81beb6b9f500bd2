"""Analyses on handmade frames with the edge rows that matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.functions import WEEKDAYS
from orderlens.operators import aggregate
from orderlens.plans import analyses as A


def _ts(*a):
    return dt.datetime(*a)


@pytest.fixture
def payments(spark):
    return spark.createDataFrame([
        ("o1", 1, None, 2, 10.0), ("o1", 2, "credit_card", 4, 20.0),
        ("o2", 1, "not_defined", 3, 5.0), ("o3", 1, "credit_card", 1, 1.10),
    ], "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double")


def test_payment_summary(spark, payments):
    from orderlens.operators import cleaning
    got = [tuple(r) for r in A.payment_summary(cleaning.zero_undefined_installments(payments)).collect()]
    assert got == [(None, 10.0, 2.0), ("credit_card", 21.1, 2.5), ("not_defined", 5.0, 0.0)]


def test_pivot_fills_missing_cells_with_zero(spark):
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c2"), ("o3", "c2")], "order_id string, customer_id string")
    customers = spark.createDataFrame([("c1", "SP"), ("c2", "RJ")], "customer_id string, customer_state string")
    pays = spark.createDataFrame([("o1", "boleto"), ("o1", "boleto"), ("o2", "voucher"), ("o3", "boleto")],
                                 "order_id string, payment_type string")
    out = A.pivot_payment_type_by_state(orders, customers, pays)
    assert out.columns == ["customer_state", "boleto", "voucher"]
    assert {tuple(r) for r in out.collect()} == {("SP", 2, 0), ("RJ", 1, 1)}


def test_share_with_ties_uses_range_frame(spark):
    rows = [("A", i) for i in range(5)] + [("B", i) for i in range(3)] + [("C", i) for i in range(3)] + [("D", 0)]
    df = spark.createDataFrame(rows, "customer_state string, customer_unique_id int")
    got = {r.customer_state: (r.no_customers, r.percentage_customer_base, r.running_total_percentage)
           for r in A.customer_share_by_state(df).collect()}
    assert got == {"A": (5, 41.67, 41.67), "B": (3, 25.0, 91.67), "C": (3, 25.0, 91.67), "D": (1, 8.33, 100.0)}


def test_share_distinct_counts_people(spark):
    df = spark.createDataFrame([("A", "u1"), ("A", "u1"), ("B", "u2")], "customer_state string, customer_unique_id string")
    got = {r.customer_state: r.no_customers for r in A.customer_share_by_state(df, distinct=True).collect()}
    assert got == {"A": 1, "B": 1}


@pytest.fixture
def route(spark):
    # order, price, seller, seller_state, customer, customer_state
    rows = [
        ("o1", 10.0, "s1", "SP", "c1", "RJ"),   # SP sells to RJ
        ("o1", 10.0, "s1", "SP", "c1", "RJ"),   # equal-priced second item: merged by the distinct
        ("o2", 7.0, "s2", "MG", "c2", "SP"),    # MG only sells
        ("o3", 4.0, "s3", "BA", "c3", "BA"),    # BA balanced
        ("o4", 3.0, "s1", "SP", "c4", "PR"),    # PR only buys
        ("o5", None, "s4", "AC", "c5", "AC"),   # null prices only
    ]
    return spark.createDataFrame(rows, "order_id string, price double, seller_id string, seller_state string, "
                                       "customer_id string, customer_state string")


def test_state_trade_balance(route):
    got = {r.customer_state: (r.buy_value, r.seller_state, r.sell_value, r.margin_activity, r.margin_category)
           for r in A.state_trade_balance(route).collect()}
    assert got == {
        "RJ": (10.0, "RJ", 0.0, -10.0, "consumer_dominant"),
        "SP": (7.0, "SP", 13.0, 6.0, "seller_dominant"),
        "BA": (4.0, "BA", 4.0, 0.0, "balanced"),
        "PR": (3.0, "PR", 0.0, -3.0, "consumer_dominant"),
        "AC": (None, "AC", 0.0, None, None),
    }
    assert "MG" not in got


def test_state_trade_balance_item_grain_keeps_equal_prices(spark, route):
    with_item = route.withColumn("order_item_id", F.monotonically_increasing_id())
    got = {r.customer_state: r.buy_value for r in A.state_trade_balance(with_item).collect()}
    assert got["RJ"] == 20.0


def test_state_trade_balance_null_state_sells_nothing(spark):
    rows = [("o1", 5.0, "s1", None, "c1", None), ("o2", 2.0, "s2", "SP", "c2", "SP")]
    df = spark.createDataFrame(rows, "order_id string, price double, seller_id string, seller_state string, "
                                     "customer_id string, customer_state string")
    got = {r.customer_state: (r.buy_value, r.sell_value) for r in A.state_trade_balance(df).collect()}
    assert got == {None: (5.0, 0.0), "SP": (2.0, 2.0)}


def test_hour_weekday_matrix_absent_days_are_null(spark):
    rows = [("o1", _ts(2017, 3, 6, 10, 0)), ("o1", _ts(2017, 3, 6, 10, 0)), ("o2", _ts(2017, 3, 6, 10, 30)),
            ("o3", _ts(2017, 3, 13, 23, 0))]
    df = spark.createDataFrame(rows, "order_id string, order_purchase_timestamp timestamp_ntz")
    out = A.hour_weekday_matrix(df)
    assert out.columns == ["hour"] + WEEKDAYS
    got = [tuple(r) for r in out.collect()]
    assert got == [(23, 1, None, None, None, None, None, None), (10, 2, None, None, None, None, None, None)]


def test_orders_per_state(spark):
    customers = spark.createDataFrame([("c1", "SP"), ("c2", "SP"), ("c3", "RJ")], "customer_id string, customer_state string")
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c2"), ("o3", "c3"), ("o4", "cX")], "order_id string, customer_id string")
    assert [tuple(r) for r in A.orders_per_state(customers, orders).collect()] == [("RJ", 1), ("SP", 2)]


def test_customer_behaviour(spark):
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c1"), ("o3", "c2"), ("o4", None), ("o5", "c3")],
                                   "order_id string, customer_id string")
    pays = spark.createDataFrame([("o1", 10.0), ("o1", 20.0), ("o2", 60.0), ("o3", 5.0), ("o4", 9.0)],
                                 "order_id string, payment_value double")
    got = [tuple(r) for r in A.customer_behaviour(orders, pays).collect()]
    assert got == [("c1", 2, 30.0), ("c2", 1, 5.0)]
    by_order = {r.customer_id: r.average_order_value for r in A.customer_behaviour(orders, pays, grain="order").collect()}
    assert by_order == {"c1": 45.0, "c2": 5.0}
    top = A.top_customers(A.customer_behaviour(orders, pays), 1).collect()
    assert [r.customer_id for r in top] == ["c1"]


def test_value_by_product_size(spark):
    products = spark.createDataFrame([("p1", 20, 20, 20, 500), ("p2", 30, 30, 30, 900), ("p3", None, 1, 1, 1)],
                                     "product_id string, product_length_cm int, product_width_cm int, "
                                     "product_height_cm int, product_weight_g int")
    items = spark.createDataFrame([("p1", 10.0), ("p1", 20.01), ("p2", 7.0), ("p3", 1.0), ("p9", 99.0)],
                                  "product_id string, price double")
    got = {r.product_size_category: r.average_order_value for r in A.value_by_product_size(items, products).collect()}
    assert got == {"Small": 15.01, "Medium": 7.0, "Unknown": 1.0}


def test_seller_monthly_growth(spark):
    orders = spark.createDataFrame([
        ("o1", _ts(2017, 1, 5)), ("o2", _ts(2017, 3, 5)), ("o3", _ts(2017, 4, 1)),
        ("o4", _ts(2017, 5, 1)), ("o5", _ts(2017, 6, 1))], "order_id string, order_purchase_timestamp timestamp_ntz")
    items = spark.createDataFrame([
        ("o1", "s1", 10.0), ("o2", "s1", 15.0), ("o3", "s1", 0.0), ("o4", "s1", 5.0), ("o5", "s2", 1.0)],
        "order_id string, seller_id string, price double")
    got = {(r.seller_id, r.year_month): (r.monthly_sales, r.prev_month_sales, r.sales_growth_percentage)
           for r in A.seller_monthly_growth(orders, items).collect()}
    assert got == {("s1", "2017-01"): (10.0, None, None), ("s1", "2017-03"): (15.0, 10.0, 50.0),
                   ("s1", "2017-04"): (0.0, 15.0, -100.0), ("s1", "2017-05"): (5.0, 0.0, None),
                   ("s2", "2017-06"): (1.0, None, None)}
    cal = {(r.seller_id, r.year_month): r.prev_month_sales
           for r in A.seller_monthly_growth(orders, items, calendar=True).collect()}
    assert cal[("s1", "2017-03")] is None and cal[("s1", "2017-04")] == 15.0


def test_monthly_sales_are_float32(spark):
    orders = spark.createDataFrame([("o1", _ts(2017, 1, 5))], "order_id string, order_purchase_timestamp timestamp_ntz")
    items = spark.createDataFrame([("o1", "s1", 10.1)], "order_id string, seller_id string, price double")
    out = A.seller_monthly_growth(orders, items)
    assert dict(out.dtypes)["monthly_sales"] == "float"
    assert dict(out.dtypes)["sales_growth_percentage"] == "double"


def test_active_sellers_semi_join_matches_inner_join(spark):
    items = spark.createDataFrame([("o1", "s1", "p1"), ("o1", "s2", "p2"), ("o2", "s1", "p1"), ("o3", "s3", "p3")],
                                  "order_id string, seller_id string, product_id string")
    orders = spark.createDataFrame([("o1", "F", _ts(2017, 1, 2)), ("o2", "O", _ts(2018, 1, 2)), ("o3", "F", _ts(2018, 5, 1))],
                                   "order_id string, order_status string, order_approved_at timestamp_ntz")
    pays = spark.createDataFrame([("o1",), ("o1",), ("o1",), ("o2",)], "order_id string")
    sellers = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "seller_id string")
    products = spark.createDataFrame([("p1",), ("p2",)], "product_id string")
    got = [tuple(r) for r in A.active_sellers_by_year(items, orders, pays, sellers, products).collect()]
    assert got == [(2017, 2, 2), (2018, 1, 1)]
    inner = (items.join(orders, "order_id").join(pays, "order_id").join(sellers, "seller_id").join(products, "product_id")
             .groupBy(F.year("order_approved_at").alias("year"))
             .agg(F.countDistinct("seller_id"), F.countDistinct("product_id")).orderBy("year"))
    assert [tuple(r) for r in inner.collect()] == got
    status = [tuple(r) for r in A.active_sellers_by_year(items, orders, pays, sellers, products, status_in=["F"]).collect()]
    assert status == [(2017, 2, 2)]


def test_pivot_values(spark):
    wide = spark.range(20_000).withColumnRenamed("id", "v")
    assert len(aggregate.discover_values(wide, "v")) == 20_000
    df = spark.createDataFrame([("a", None), ("a", "unknown"), ("b", "null"), ("b", "card")], "s string, t string")
    merged = aggregate.pivot_count(df, "s", "t", "s", null_label="unknown")
    assert merged.columns == ["s", "unknown", "card", "null"] and {tuple(r) for r in merged.collect()} == {("a", 2, 0, 0), ("b", 0, 1, 1)}
    assert {tuple(r) for r in aggregate.pivot_count(df, "s", "t", "s").collect()} == {("a", 1, 0, 1), ("b", 1, 1, 0)}
    with pytest.raises(Exception, match="not among the pivot values"):
        aggregate.pivot_count(df, "s", "t", "s", values=["card"]).collect()


def test_state_counts_left_join(spark):
    buyers = spark.createDataFrame([("c1", "SP"), ("c2", "RJ")], "customer_id string, customer_state string")
    sellers = spark.createDataFrame([("s1", "SP"), ("s2", "SP"), ("s3", "MG")], "seller_id string, seller_state string")
    got = {tuple(r) for r in A.state_counts_left_join(buyers, sellers).collect()}
    assert got == {("SP", 1, "SP", 2), ("RJ", 1, "RJ", 0)}


def test_pivot_null_type_column_and_label(spark):
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c1")], "order_id string, customer_id string")
    customers = spark.createDataFrame([("c1", "SP")], "customer_id string, customer_state string")
    pays = spark.createDataFrame([("o1", None), ("o2", "boleto")], "order_id string, payment_type string")
    plain = A.pivot_payment_type_by_state(orders, customers, pays)
    assert plain.columns == ["customer_state", "null", "boleto"]
    assert tuple(plain.first()) == ("SP", 1, 1)
    labelled = A.pivot_payment_type_by_state(orders, customers, pays, null_label="unknown")
    assert labelled.columns == ["customer_state", "unknown", "boleto"]   # the label takes the null column's place
    assert tuple(labelled.first()) == ("SP", 1, 1)


def test_state_trade_balance_nan_price(spark):
    rows = [("o1", float("nan"), "s1", "SP", "c1", "RJ"), ("o2", 4.0, "s2", "RJ", "c2", "SP")]
    df = spark.createDataFrame(rows, "order_id string, price double, seller_id string, seller_state string, "
                                     "customer_id string, customer_state string")
    got = {r.customer_state: r for r in A.state_trade_balance(df).collect()}
    import math
    assert math.isnan(got["RJ"].buy_value) and got["RJ"].sell_value == 4.0
    assert math.isnan(got["RJ"].margin_activity) and got["RJ"].margin_category is None
    # fillna(0) on sell_value replaces NaN as well as null, as the original's fill does
    assert got["SP"].sell_value == 0.0 and got["SP"].margin_category == "consumer_dominant"


def test_value_by_product_size_nan_price(spark):
    products = spark.createDataFrame([("p1", 20, 20, 20, 500)], "product_id string, product_length_cm int, "
                                     "product_width_cm int, product_height_cm int, product_weight_g int")
    items = spark.createDataFrame([("p1", 10.0), ("p1", float("nan"))], "product_id string, price double")
    import math
    assert math.isnan(A.value_by_product_size(items, products).first().average_order_value)


def test_share_when_nothing_is_counted(spark):
    df = spark.createDataFrame([("A", None), ("B", None)], "customer_state string, customer_unique_id string")
    got = {r.customer_state: (r.no_customers, r.percentage_customer_base) for r in A.customer_share_by_state(df).collect()}
    assert got == {"A": (0, None), "B": (0, None)}
