import random
import datetime as dt
import math

import pytest

from pyspark.sql import functions as F

from orderlens.functions import (
    exact_avg, exact_sum,
    growth_pct, hour_of, margin_category, month_key, product_size_class, round_half_up,
    text_to_timestamp, weekday_name, year_of,
)


def test_round_half_up_on_decimal_text(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (12.345,), (-0.125,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 2)).collect()]
    assert got[:4] == [1.01, 2.68, 12.35, -0.13]
    assert math.isnan(got[4]) and got[5] is None


def test_margin_category_sign_null_nan(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.5,), (None,), (float("nan"),)], "m double")
    got = [r[0] for r in df.select(margin_category("m")).collect()]
    assert got == ["consumer_dominant", "balanced", "seller_dominant", None, None]


def test_product_size_boundaries(spark):
    rows = [(20, 20, 20, 500), (21, 20, 20, 500), (40, 40, 40, 2000), (41, 1, 1, 1),
            (None, 1, 1, 1), (1, 1, 1, None)]
    df = spark.createDataFrame(rows, "l int, w int, h int, g int")
    got = [r[0] for r in df.select(product_size_class("l", "w", "h", "g")).collect()]
    assert got == ["Small", "Medium", "Medium", "Large", "Unknown", "Unknown"]


def test_product_size_custom_limits(spark):
    df = spark.createDataFrame([(5, 5, 5, 50)], "l int, w int, h int, g int")
    got = df.select(product_size_class("l", "w", "h", "g", small=(4, 40), medium=(10, 100))).first()[0]
    assert got == "Medium"


def test_time_parts_on_wall_clock(spark):
    ts = dt.datetime(2017, 3, 6, 14, 30)  # a Monday
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    r = df.select(weekday_name("ts"), hour_of("ts"), month_key("ts"), year_of("ts")).first()
    assert tuple(r) == ("Monday", 14, "2017-03", 2017)


def test_time_parts_ignore_session_zone(spark):
    ts = dt.datetime(2017, 3, 6, 0, 30)
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        r = df.select(weekday_name("ts"), hour_of("ts"), month_key("ts")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(r) == ("Monday", 0, "2017-03")


def test_growth_pct_zero_and_null_previous(spark):
    df = spark.createDataFrame([(10.0, 5.0), (3.0, 0.0), (3.0, None)], "c float, p float")
    got = [r[0] for r in df.select(growth_pct("c", "p")).collect()]
    assert got == [100.0, None, None]


def test_text_to_timestamp(spark):
    df = spark.createDataFrame([("2017-10-02 10:56:33",), ("not a time",)], "t string")
    got = [r[0] for r in df.select(text_to_timestamp("t")).collect()]
    assert got == [dt.datetime(2017, 10, 2, 10, 56, 33), None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_money_sums_neither_cut_nor_overflow(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        def total(*values):
            return spark.createDataFrame([(float(v),) for v in values], "x double").select(exact_sum("x")).first()[0]
        assert total(1e17) == 1e17 and total(5e16, 5e16) == 1e17 and total(*[0.004] * 1000) == 4.0 and total(1e300, -1e300, 0.25) == 0.25
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_rounding_is_done_once(spark):
    assert spark.createDataFrame([(0.00499999999999,)], "x double").select(round_half_up("x", 2)).first()[0] == 0.0


def test_money_sums_are_exact(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.29,), (104997.88,), (None,)], "x double")
    r = df.select(exact_sum("x").alias("s"), exact_avg("x").alias("a")).first()
    assert r.s == 104998.47            # 0.1 + 0.2 + 0.29 in doubles would not be exact
    assert r.a == 104998.47 / 4
    assert df.where("x is null").select(exact_sum("x")).first()[0] is None


def test_money_sums_keep_nan_and_infinity_semantics(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1.5), ("a", float("nan")), ("b", 2.25), ("b", inf),
                                ("c", inf), ("c", -inf), ("d", None), ("e", 0.1), ("e", 0.2)], "k string, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("x").alias("s")).collect()}
    assert math.isnan(got["a"]) and got["b"] == inf and math.isnan(got["c"])
    assert got["d"] is None and got["e"] == 0.3
    avg = {r.k: r.m for r in df.groupBy("k").agg(exact_avg("x").alias("m")).collect()}
    assert math.isnan(avg["a"]) and avg["e"] == 0.15


def test_exact_sums_of_cents_and_of_all_else(spark):
    from decimal import Decimal
    from orderlens.functions.scalar import CENTS_BELOW, exact_part, exact_sum, sum_exact
    rng = random.Random(3)
    amounts = [0.0, -0.0, 0.01, -0.01, 0.1, 0.125, 1 / 3, 1e-10, 99999999.99, -99999999.99, CENTS_BELOW, CENTS_BELOW - 0.01, 12345678901.23, 1e14 + 0.5, None]
    amounts += [rng.randrange(-10 ** 9, 10 ** 9) / 100 for _ in range(400)] + [rng.uniform(-1e6, 1e6) for _ in range(200)]
    rows = [(i % 3, v) for i, v in enumerate(amounts)] + [(7, None), (8, 0.1), (8, 0.2), (9, -0.07), (9, 0.07)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    found = {r.g: r for r in df.groupBy("g").agg(sum_exact("v").alias("fast"), F.sum(exact_part("v")).alias("plain"), exact_sum("v").alias("total")).collect()}
    for g, r in found.items():
        own = [Decimal(repr(v)).quantize(Decimal("1e-10"), "ROUND_HALF_UP") for k, v in rows if k == g and v is not None]
        assert r.fast == r.plain == (sum(own) if own else None)
        assert r.total == (float(sum(own)) if own else None)
    assert found[7].total is None and found[8].total == 0.3 and found[9].total == 0.0
    odd = df.limit(1).select(F.explode(F.array(F.lit(float("nan")), F.lit(1e15), F.lit(0.01))).alias("v")).agg(sum_exact("v").alias("e"), exact_sum("v").alias("t")).first()
    assert odd.e == Decimal("0.01") and odd.t != odd.t
