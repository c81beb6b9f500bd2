"""Command line: read the order tables, clean them, run the ten analyses.

    python -m orderlens.run --table customers=data/customers.csv --table orders=... \\
        --out results/ [--show]

Tables ending in ``.csv`` or ``.csv.gz`` are read with the declared schema of that table
name (``sources.SCHEMAS``); anything else is read as Parquet.  Each result
is written as Parquet under ``--out/<analysis>`` (or printed with --show).

With ``--quarantine`` a bad CSV cell does not end the run: each CSV table is
loaded in one scan into ``--quarantine/<table>``, and what is wrong with the
rows left out is written to ``--quarantine/<table>_bad``.  With ``--cleaned``
the cleaned orders are written there once, the analyses read them from
there, and the quality figures, counted in the same job, lie beside them.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from orderlens.operators import quality
from orderlens.plans import analyses as A
from orderlens.plans.display import with_display_names
from orderlens.plans.preparation import prepare_tables
from orderlens.sources import SCHEMAS, load_csv, read_csv, read_parquet, write_result

Tables = dict[str, DataFrame]

ANALYSES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "pivot_payment_type_by_state": (("orders", "customers", "payments"), A.pivot_payment_type_by_state),
    "active_sellers_by_year": (("order_items", "orders", "payments", "sellers", "products"),
                               A.active_sellers_by_year),
    "customer_share_by_state": (("customers",), A.customer_share_by_state),
    "hour_weekday_matrix": (("orders",), A.hour_weekday_matrix),
    "payment_summary": (("payments",), A.payment_summary),
    "orders_per_state": (("customers", "orders"), A.orders_per_state),
    "customer_behaviour": (("orders", "payments"), A.customer_behaviour),
    "value_by_product_size": (("order_items", "products"), A.value_by_product_size),
    "seller_monthly_growth": (("orders", "order_items"), A.seller_monthly_growth),
}


def load(spark: SparkSession, paths: dict[str, str], quarantine: str | None = None) -> Tables:
    unknown = sorted(set(paths) - set(SCHEMAS))
    if unknown:
        raise ValueError(f"unknown tables {unknown}; names are {sorted(SCHEMAS)}")
    tables = {}
    for name, path in paths.items():
        if path.endswith((".csv", ".csv.gz")) and quarantine:
            tables[name], bad = load_csv(spark, path, name, f"{quarantine.rstrip('/')}/{name}")
            write_result(bad, f"{quarantine.rstrip('/')}/{name}_bad")
        elif path.endswith((".csv", ".csv.gz")):
            tables[name] = read_csv(spark, path, schema=name)
        else:
            tables[name] = read_parquet(spark, path)
    return tables


def write_clean_orders(spark: SparkSession, orders: DataFrame, folder: str) -> DataFrame:
    """The orders without missing values, written to ``folder`` with the figures about what was left out."""
    folder = folder.rstrip("/")
    figures = quality.write_clean(orders, f"{folder}/orders")
    for name, df in figures._asdict().items():
        write_result(df, f"{folder}/orders_{name}")
    return read_parquet(spark, f"{folder}/orders")


def run_all(spark: SparkSession, tables: Tables, trim: bool = False,
            prepared: Tables | None = None) -> dict[str, DataFrame]:
    """Every analysis whose input tables are present, as lazy DataFrames."""
    t = prepared if prepared is not None else prepare_tables(tables, trim=trim)
    results = {}
    for name, (needs, fn) in ANALYSES.items():
        if all(n in t for n in needs):
            results[name] = fn(*(t[n] for n in needs))
    if all(n in t for n in ("order_items", "sellers", "orders", "customers")):
        results["state_trade_balance"] = A.trade_balance_of_tables(
            t["order_items"], t["sellers"], t["orders"], t["customers"])
    return results


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH",
                        help=f"input table; names: {', '.join(SCHEMAS)}")
    parser.add_argument("--out", help="folder for the results (Parquet, one folder per analysis)")
    parser.add_argument("--show", action="store_true", help="print 20 rows of each result")
    parser.add_argument("--trim", action="store_true", help="also trim sellers and geolocation")
    parser.add_argument("--quarantine", help="folder for the loaded CSV tables and their bad cells; without it a bad cell is an error")
    parser.add_argument("--cleaned", help="folder for the cleaned orders and their quality figures")
    parser.add_argument("--display-names", action="store_true",
                        help="name result columns as the original outputs do")
    parser.add_argument("--persist", action="store_true",
                        help="keep the cleaned orders and payments (memory, spilling to disk) while "
                             "the analyses run; released at the end")
    args = parser.parse_args(argv)
    paths = dict(item.split("=", 1) for item in args.table)
    if spark is None:
        from orderlens.session import build_session
        spark = build_session()
    tables = load(spark, paths, args.quarantine)
    if args.cleaned and "orders" in tables:
        tables["orders"] = write_clean_orders(spark, tables["orders"], args.cleaned)
    prepared = prepare_tables(tables, trim=args.trim)
    kept = []
    if args.persist:
        # Six analyses start from the cleaned orders and three from the cleaned
        # payments; computing them once serves all.  Lost blocks are rebuilt
        # from lineage.
        for name in ("orders", "payments"):
            if name in prepared:
                prepared[name] = prepared[name].persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(prepared[name])
    results = run_all(spark, {}, prepared=prepared)
    if args.display_names:
        results = {name: with_display_names(df, name) for name, df in results.items()}
    try:
        for name, df in results.items():
            if args.out:
                write_result(df, f"{args.out.rstrip('/')}/{name}")
            if args.show:
                print(name)
                df.show(truncate=False)
    finally:
        for df in kept:
            df.unpersist()
    return results


if __name__ == "__main__":
    main()
