"""Order-shaped views over the driver's TPC-H-like tables.

Each view exists twice: as a Spark DataFrame (``OrderViews``) and as a SQL
common table expression (``SQL_VIEWS``) for the DuckDB oracle.  The two are
kept next to each other so they stay the same mapping.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import cleaning, relational

# Fixed values of the mapping.
UNDEFINED_PAYMENT_TYPE = "4-NOT SPECIFIED"  # plays the reference's "not_defined" type
PAYMENT_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
UNTRANSLATED_TYPES = ["PROMO", "STANDARD"]
PRICE_BUCKET = 10_000
UNTYPED_EVERY = 97
STATES_WITHOUT_SELLERS = ["NATION_3", "NATION_8"]
STATES_WITHOUT_BUYERS = ["NATION_5"]
SHARED_IDS = 400


# Column layout of the driver tables, declared so that reading them needs no
# schema-inference job (one per read otherwise).
DRIVER_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class OrderViews:
    """Lazily built views; nothing is read until a query needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in DRIVER_SCHEMAS:
            reader = reader.schema(DRIVER_SCHEMAS[name])
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    def _state_of(self, df: DataFrame, nation_key: str, alias: str) -> DataFrame:
        """The nation's name plays the state; the nation table is a code table."""
        return relational.lookup_column(df, nation_key, self.table("nation"), "n_nationkey", "n_name", alias)

    @cached_property
    def customers(self) -> DataFrame:
        c = self._state_of(self.table("customer"), "c_nationkey", "customer_state")
        return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_unique_id"),
                        "customer_state")

    @cached_property
    def sellers(self) -> DataFrame:
        s = self._state_of(self.table("supplier"), "s_nationkey", "seller_state")
        return s.select(F.col("s_suppkey").alias("seller_id"), "seller_state")

    @cached_property
    def orders(self) -> DataFrame:
        o = self.table("orders")
        approved = F.when(o.o_orderstatus == "P", F.lit(None)).otherwise(
            o.o_orderdate + F.expr("INTERVAL 1 DAY"))
        return o.select(o.o_orderkey.alias("order_id"), o.o_custkey.alias("customer_id"),
                        o.o_orderstatus.alias("order_status"),
                        o.o_orderdate.alias("order_purchase_timestamp"),
                        approved.alias("order_approved_at"))

    @cached_property
    def clean_orders(self) -> DataFrame:
        return cleaning.drop_nulls(self.orders)

    def _items(self, price) -> DataFrame:
        li = self.table("lineitem")
        return li.select(li.l_orderkey.alias("order_id"), li.l_linenumber.alias("order_item_id"),
                         li.l_partkey.alias("product_id"), li.l_suppkey.alias("seller_id"),
                         price.alias("price"))

    @cached_property
    def items(self) -> DataFrame:
        return self._items(F.col("l_extendedprice"))

    @cached_property
    def items_bucketed(self) -> DataFrame:
        """Prices rounded to whole buckets, so equal-priced items of one seller occur."""
        return self._items(F.floor(F.col("l_extendedprice") / PRICE_BUCKET + 0.5).cast("double") * PRICE_BUCKET)

    @cached_property
    def payments(self) -> DataFrame:
        o = self.table("orders")
        last_seq = F.when(o.o_orderkey % 5 == 0, F.lit(2)).otherwise(F.lit(1))
        return o.select(
            o.o_orderkey.alias("order_id"),
            F.explode(F.sequence(F.lit(1), last_seq)).alias("payment_sequential"),
            o.o_orderpriority.alias("payment_type"),
            (F.lit(1) + o.o_orderkey % 12).cast("int").alias("payment_installments"),
            o.o_totalprice.alias("payment_value"))

    @cached_property
    def clean_payments(self) -> DataFrame:
        return cleaning.zero_undefined_installments(self.payments, undefined=UNDEFINED_PAYMENT_TYPE)

    @cached_property
    def payments_partly_untyped(self) -> DataFrame:
        """Clean payments with no type on every order whose key is a multiple of 97."""
        p = self.clean_payments
        return p.withColumn("payment_type", F.when(p.order_id % UNTYPED_EVERY == 0, F.lit(None))
                            .otherwise(p.payment_type))

    @cached_property
    def products(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            p.p_partkey.alias("product_id"), p.p_type.alias("product_category_name"),
            F.when(p.p_partkey % 97 == 0, F.lit(None)).otherwise(p.p_size).cast("int").alias("product_length_cm"),
            p.p_size.alias("product_width_cm"), p.p_size.alias("product_height_cm"),
            (F.lit(50) * p.p_size).cast("int").alias("product_weight_g"))

    @cached_property
    def category_translation(self) -> DataFrame:
        p = self.table("part")
        return (p.where(~p.p_type.isin(UNTRANSLATED_TYPES))
                .select(p.p_type.alias("product_category_name"),
                        F.lower(p.p_type).alias("product_category_name_english"))
                .distinct())

    @cached_property
    def some_sellers(self) -> DataFrame:
        """Sellers with gaps: a seventh of the ids and whole states are missing."""
        return self.sellers.where((F.col("seller_id") % 7 != 0) & ~F.col("seller_state").isin(STATES_WITHOUT_SELLERS))

    @cached_property
    def some_payments(self) -> DataFrame:
        """Clean payments, none for every eleventh order."""
        return self.clean_payments.where(F.col("order_id") % 11 != 0)

    @cached_property
    def some_products(self) -> DataFrame:
        return self.products.where(F.col("product_id") % 5 != 0)

    @cached_property
    def shared_customers(self) -> DataFrame:
        """Customers whose unique ids repeat, and states where nobody buys."""
        shared = F.concat(F.lit("U"), (F.col("customer_id") % SHARED_IDS).cast("string"))
        return (self.customers.where(~F.col("customer_state").isin(STATES_WITHOUT_BUYERS))
                .withColumn("customer_unique_id", shared))

    @cached_property
    def items_subcent(self) -> DataFrame:
        """Prices with parts below a cent."""
        return self._items(F.col("l_extendedprice") / 8)

    @cached_property
    def payments_subcent(self) -> DataFrame:
        return self.clean_payments.withColumn("payment_value", F.col("payment_value") / 8)

    @cached_property
    def products_padded(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            p.p_partkey.alias("product_id"),
            F.concat(F.lit("  "), F.replace(p.p_name, F.lit(" "), F.lit(" \t  ")), F.lit(" ")).alias("product_name"),
            F.concat(F.lit(" "), p.p_brand, F.lit("  ")).alias("product_brand"),
            p.p_type.alias("product_category_name"), p.p_size.alias("product_size"))

    @cached_property
    def clickstream_orders(self) -> DataFrame:
        e = self.table("events")
        return e.select(e.event_id.alias("order_id"), e.ts.alias("order_purchase_timestamp"))


# The same views as SQL CTEs (DuckDB dialect), named with an ``ol_`` prefix so
# they do not shadow the base tables.  Listed in dependency order.
_ORDERS_NOT_NULL = ("order_id IS NOT NULL AND customer_id IS NOT NULL AND order_status IS NOT NULL "
                    "AND order_purchase_timestamp IS NOT NULL AND order_approved_at IS NOT NULL")

SQL_VIEWS: dict[str, str] = {
    "ol_customers": """SELECT c.c_custkey AS customer_id, c.c_name AS customer_unique_id,
        n.n_name AS customer_state FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "ol_sellers": """SELECT s.s_suppkey AS seller_id, n.n_name AS seller_state
        FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "ol_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
        o_orderdate AS order_purchase_timestamp,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS order_approved_at
        FROM orders""",
    "ol_clean_orders": f"SELECT * FROM ol_orders WHERE {_ORDERS_NOT_NULL}",
    "ol_items": """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
        l_suppkey AS seller_id, l_extendedprice AS price FROM lineitem""",
    "ol_items_bucketed": f"""SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
        l_partkey AS product_id, l_suppkey AS seller_id,
        CAST(floor(l_extendedprice / {PRICE_BUCKET} + 0.5) AS DOUBLE) * {PRICE_BUCKET} AS price FROM lineitem""",
    "ol_payments": """SELECT o_orderkey AS order_id, 1 AS payment_sequential, o_orderpriority AS payment_type,
            CAST(1 + o_orderkey % 12 AS INTEGER) AS payment_installments, o_totalprice AS payment_value
        FROM orders
        UNION ALL
        SELECT o_orderkey, 2, o_orderpriority, CAST(1 + o_orderkey % 12 AS INTEGER), o_totalprice
        FROM orders WHERE o_orderkey % 5 = 0""",
    "ol_clean_payments": f"""SELECT order_id, payment_sequential, payment_type,
        CASE WHEN payment_type = '{UNDEFINED_PAYMENT_TYPE}' THEN 0 ELSE payment_installments END
            AS payment_installments, payment_value FROM ol_payments""",
    "ol_payments_partly_untyped": f"""SELECT order_id, payment_sequential,
        CASE WHEN order_id % {UNTYPED_EVERY} = 0 THEN NULL ELSE payment_type END AS payment_type,
        payment_installments, payment_value FROM ol_clean_payments""",
    "ol_products": """SELECT p_partkey AS product_id, p_type AS product_category_name,
        CAST(CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END AS INTEGER) AS product_length_cm,
        p_size AS product_width_cm, p_size AS product_height_cm,
        CAST(50 * p_size AS INTEGER) AS product_weight_g FROM part""",
    "ol_category_translation": """SELECT DISTINCT p_type AS product_category_name,
        lower(p_type) AS product_category_name_english FROM part
        WHERE p_type NOT IN ({untranslated})""".replace(
        "{untranslated}", ", ".join(f"'{t}'" for t in UNTRANSLATED_TYPES)),
    "ol_some_sellers": """SELECT * FROM ol_sellers
        WHERE seller_id % 7 <> 0 AND seller_state NOT IN ({states})""".replace(
        "{states}", ", ".join(f"'{s}'" for s in STATES_WITHOUT_SELLERS)),
    "ol_some_payments": "SELECT * FROM ol_clean_payments WHERE order_id % 11 <> 0",
    "ol_some_products": "SELECT * FROM ol_products WHERE product_id % 5 <> 0",
    "ol_shared_customers": f"""SELECT customer_id, 'U' || CAST(customer_id % {SHARED_IDS} AS VARCHAR) AS customer_unique_id,
        customer_state FROM ol_customers WHERE customer_state NOT IN ({{states}})""".replace(
        "{states}", ", ".join(f"'{s}'" for s in STATES_WITHOUT_BUYERS)),
    "ol_items_subcent": """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
        l_suppkey AS seller_id, l_extendedprice / 8 AS price FROM lineitem""",
    "ol_payments_subcent": """SELECT order_id, payment_sequential, payment_type, payment_installments,
        payment_value / 8 AS payment_value FROM ol_clean_payments""",
    "ol_products_padded": """SELECT p_partkey AS product_id,
        '  ' || replace(p_name, ' ', ' ' || chr(9) || '  ') || ' ' AS product_name,
        ' ' || p_brand || '  ' AS product_brand, p_type AS product_category_name,
        p_size AS product_size FROM part""",
    "ol_clickstream_orders": """SELECT event_id AS order_id, ts AS order_purchase_timestamp FROM events""",
}


def with_views(select: str) -> str:
    """Prefix ``select`` with the CTEs it mentions (and their dependencies)."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                visit(body)

    visit(select)
    ctes = [f"{name} AS ({body})" for name, body in SQL_VIEWS.items() if name in needed]
    if not ctes:
        return select
    head = "WITH " + ",\n".join(ctes)
    if select.lstrip().upper().startswith("WITH "):
        return head + ",\n" + select.lstrip()[5:]
    return head + "\n" + select


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{re.escape(name)}\b", text) is not None
