"""Every registered query against its DuckDB SQL oracle on the sf0.01 tables."""

import pytest

import __spark_entry__ as entry_module
from conftest import SF_ORACLE
from oracle import compare, duck
from orderlens.plans import registry

QUERIES = registry.QUERIES
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_ORACLE), con, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["customer_state", "buy_value", "seller_state", "sell_value",
                          "margin_activity", "margin_category"]


@pytest.mark.parametrize("name", ["hour_weekday_matrix", "seller_monthly_growth_calendar", "scalar_casts",
                                  "active_sellers_by_year", "payment_summary"])
def test_same_answer_without_ansi_in_another_zone(spark, con, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone")}
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        ok, msg = compare(QUERIES[name](spark, SF_ORACLE), con, ORACLE[name])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ok, msg
