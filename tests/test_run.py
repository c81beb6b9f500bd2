"""The command line over CSV inputs gives the same answers as the registered queries."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from orderlens import run
from orderlens.plans import analyses as A
from orderlens.plans.preparation import prepare_tables
from orderlens.sources import SCHEMAS
from orderlens.sources.fixtures import OrderViews


def _csv(df, path):
    df.coalesce(1).write.option("header", True).csv(path)   # test input files only
    return path


def _conform(df, name, **fill):
    """Lay a view out in the full column order of the marketplace table (CSV is positional)."""
    cols = []
    for field in SCHEMAS[name].fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType))
        elif field.name in fill:
            cols.append(F.col(fill[field.name]).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(cols)


def test_cli_runs_all_analyses_from_csv(spark, tmp_path):
    v = OrderViews(spark, SF_SMALL)
    payments = v.payments.withColumn(
        "payment_type", F.when(F.col("payment_type") == "4-NOT SPECIFIED", "not_defined").otherwise(F.col("payment_type")))
    ts = "order_purchase_timestamp"
    inputs = {"customers": _conform(v.customers, "customers"),
              "orders": _conform(v.orders, "orders", order_delivered_carrier_date=ts,
                                 order_delivered_customer_date=ts, order_estimated_delivery_date=ts),
              "payments": _conform(payments, "payments"), "order_items": _conform(v.items, "order_items"),
              "sellers": _conform(v.sellers, "sellers"), "products": _conform(v.products, "products"),
              "category_translation": _conform(v.category_translation, "category_translation")}
    args = []
    for name, df in inputs.items():
        args += ["--table", f"{name}=" + _csv(df, str(tmp_path / f"{name}.csv"))]
    out = str(tmp_path / "out")
    results = run.main(args + ["--out", out, "--persist"], spark=spark)
    assert not [rdd for rdd in spark.sparkContext._jsc.getPersistentRDDs().values()]   # released
    assert len(results) == 10
    for name in results:
        assert spark.read.parquet(f"{out}/{name}").count() >= 1
    got = {r.payment_type: r.avg_installments for r in spark.read.parquet(f"{out}/payment_summary").collect()}
    assert got["not_defined"] == 0.0
    expected = A.orders_per_state(v.customers.select(F.col("customer_id").cast("string"), "customer_state"),
                                  v.clean_orders.select(F.col("customer_id").cast("string"),
                                                        F.col("order_id").cast("string"))).collect()
    written = spark.read.parquet(f"{out}/orders_per_state").collect()
    assert sorted(map(tuple, written)) == sorted(map(tuple, expected))


def test_prepare_tables_cleaning_steps(spark):
    sellers = spark.createDataFrame([("s1", " a \t b ")], "seller_id string, seller_city string")
    geo = spark.createDataFrame([("são paulo",), ("São Paulo",)], "geolocation_city string")
    orders = spark.createDataFrame([("o1", "c1"), ("o2", None)], "order_id string, customer_id string")
    t = prepare_tables({"sellers": sellers, "geolocation": geo, "orders": orders})
    assert t["sellers"].first().seller_city == " a b "
    assert [r[0] for r in t["geolocation"].collect()] == ["sao paulo", "São Paulo"]
    assert t["orders"].count() == 1
    assert prepare_tables({"sellers": sellers}, trim=True)["sellers"].first().seller_city == "a b"


def test_display_names(spark):
    from orderlens.plans.display import with_display_names
    df = spark.createDataFrame([("boleto", 1.0, 2.0)], "payment_type string, total_payment_value double, avg_installments double")
    assert with_display_names(df, "payment_summary").columns == ["Payment_type", "Total Payment Value", "Avg Installments"]
    assert with_display_names(df, "no_such_analysis").columns == df.columns


def test_cli_with_quarantine_and_cleaned_orders(spark, tmp_path):
    v = OrderViews(spark, SF_SMALL)
    ts = "order_purchase_timestamp"
    orders = _csv(_conform(v.orders, "orders", order_delivered_carrier_date=ts, order_delivered_customer_date=ts,
                           order_estimated_delivery_date=ts), str(tmp_path / "orders.csv"))
    spoilt = _conform(v.payments, "payments").withColumn(
        "payment_value", F.when(F.col("payment_value") > 200_000, "a lot").otherwise(F.col("payment_value").cast("string")))
    payments = _csv(spoilt, str(tmp_path / "payments.csv"))
    out, loaded, cleaned = (str(tmp_path / n) for n in ("out", "loaded", "cleaned"))
    run.main(["--table", f"orders={orders}", "--table", f"payments={payments}", "--out", out, "--quarantine", loaded, "--cleaned", cleaned], spark=spark)
    bad = spark.read.parquet(f"{loaded}/payments_bad")
    many = v.payments.where("payment_value > 200000").count()
    assert many and bad.count() == many and {(r.column, r.text) for r in bad.collect()} == {("payment_value", "a lot")}
    assert spark.read.parquet(f"{loaded}/orders_bad").count() == 0
    counts = spark.read.parquet(f"{cleaned}/orders_clean_counts").first()
    assert (counts.rows_before, counts.rows_after) == (v.orders.count(), v.clean_orders.count()) and counts.rows_dropped > 0
    assert spark.read.parquet(f"{cleaned}/orders").count() == spark.read.parquet(f"{cleaned}/orders_row_count").first().row_count == counts.rows_after
    summary = {r.payment_type: r.total_payment_value for r in spark.read.parquet(f"{out}/payment_summary").collect()}
    kept = v.payments.where("payment_value <= 200000 OR payment_value IS NULL")
    assert summary == {r.payment_type: r.total_payment_value for r in A.payment_summary(kept).collect()}
