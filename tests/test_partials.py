import itertools

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from orderlens.operators import partials
from orderlens.plans import analyses as A
from orderlens.sources.fixtures import OrderViews


@pytest.fixture(scope="module")
def views(spark):
    return OrderViews(spark, SF_SMALL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_three_loads_make_the_whole(spark, views, tmp_path, order):
    load = F.pmod(F.xxhash64("order_id"), F.lit(3))
    paid, sold = str(tmp_path / "paid"), str(tmp_path / "sold")
    for i in order:
        partials.add_load(A.payment_partials(views.clean_payments.where(load == i)), paid, f"load {i}")
        partials.add_load(A.seller_month_sums(views.clean_orders.where(load == i), views.items.where(load == i)), sold, f"load {i}")
    summary = A.payment_summary_of_partials(partials.all_loads(spark, paid, ["payment_type"]))
    assert rows(summary) == rows(A.payment_summary(views.clean_payments))
    growth = A.seller_growth_of_sums(partials.all_loads(spark, sold, ["seller_id", "month"]))
    assert rows(growth) == rows(A.seller_monthly_growth(views.clean_orders, views.items))


def test_a_load_added_again_replaces_itself(spark, tmp_path):
    schema, path = "payment_type string, payment_value double, payment_installments int", str(tmp_path / "p")
    first = spark.createDataFrame([("card", 0.1, 2), ("card", 0.2, None), (None, float("inf"), 1), ("slip", None, None)], schema)
    for _ in range(2):
        partials.add_load(A.payment_partials(first), path, "a")
    more = spark.createDataFrame([("card", 0.3, 5), ("slip", 7.5, 3)], schema)
    partials.add_load(A.payment_partials(more), path, "b")
    merged = partials.all_loads(spark, path, ["payment_type"])
    assert rows(A.payment_summary_of_partials(merged)) == rows(A.payment_summary(first.unionByName(more)))
    assert {r.payment_type: r.rows for r in merged.collect()} == {"card": 3, "slip": 2, None: 1}


def test_merging_is_associative(spark, views):
    load = F.pmod(F.col("order_id"), F.lit(4))
    a, b, c, d = (A.payment_partials(views.clean_payments.where(load == i)) for i in range(4))
    by = ["payment_type"]
    left = partials.merge(partials.merge(a.unionByName(b), by).unionByName(c).unionByName(d), by)
    right = partials.merge(partials.merge(d.unionByName(c), by).unionByName(partials.merge(b.unionByName(a), by)), by)
    assert rows(left) == rows(right) == rows(A.payment_partials(views.clean_payments))
