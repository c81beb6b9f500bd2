"""The ten order analyses as lazy DataFrame plans.

Inputs are DataFrames (already cleaned where the question asks for clean
orders); column names are keyword arguments with the marketplace names as
defaults.  Nothing here collects rows, except the bounded pivot-value
discovery of ``pivot_payment_type_by_state`` when no value list is given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions import classify
from orderlens.functions.scalar import (
    WEEKDAYS, exact_sum, hour_of, money_total, residue, round_half_up, sum_exact, year_of,
)
from orderlens.operators import aggregate, cleaning, partials, relational, sketches
from orderlens.sources.catalog import run_sql

# Q1 ---------------------------------------------------------------------------------------------
def pivot_payment_type_by_state(orders: DataFrame, customers: DataFrame, payments: DataFrame,
                                values: Sequence[str] | None = None, null_label: str | None = None, *,
                                order_id: str = "order_id", customer_id: str = "customer_id",
                                state: str = "customer_state", payment_type: str = "payment_type") -> DataFrame:
    """Payment rows per state and payment type, one column per type, empty cells 0.

    Without ``values`` the types are those of the joined rows, sorted, so a
    type without any matching order has no column.  Payments without a type
    are counted in a column named ``null``, or ``null_label`` when given.
    """
    # Count per (customer, type) before meeting the customer table: the join
    # then sees one row per customer and type instead of one per payment, and
    # a customer with a third of all orders is folded by partial aggregation.
    paid = orders.select(order_id, customer_id).join(payments.select(order_id, payment_type), order_id)
    per_customer = paid.groupBy(customer_id, payment_type).agg(F.count(order_id).alias("_n"))
    rows = per_customer.join(customers.select(customer_id, state), customer_id)
    return aggregate.pivot_sum(rows, state, payment_type, summed="_n", values=values, fill=0,
                               null_label=null_label)


# Q2 ---------------------------------------------------------------------------------------------
def active_sellers_by_year(items: DataFrame, orders: DataFrame, payments: DataFrame,
                           sellers: DataFrame, products: DataFrame,
                           status_in: Sequence[str] | None = None, *, order_id: str = "order_id",
                           seller_id: str = "seller_id", product_id: str = "product_id",
                           approved: str = "order_approved_at",
                           status: str = "order_status") -> DataFrame:
    """Distinct sellers and products per year of order approval.

    Payments, sellers and products only test existence: an order with several
    payments does not multiply its items.
    ``status_in`` keeps only orders in those statuses.
    """
    if status_in is not None:
        orders = orders.where(F.col(status).isin(list(status_in)))
    base = _sold_by_period(items, orders, payments, sellers, products, {"year": year_of(approved)}, order_id, seller_id, product_id)
    return (base.groupBy("year")
            .agg(F.countDistinct(seller_id).alias("active_seller"),
                 F.countDistinct(product_id).alias("product_count"))
            .orderBy(F.col("year").asc_nulls_first(), F.col("active_seller").desc()))


def _sold_by_period(items: DataFrame, orders: DataFrame, payments: DataFrame, sellers: DataFrame, products: DataFrame,
                    periods: dict[str, Column], order_id: str, seller_id: str, product_id: str) -> DataFrame:
    """Distinct (periods, seller, product) of the items whose order is paid and whose seller and product are known."""
    # The payment test shares the order key with the order join, so it runs on
    # the order side (a quarter of the item rows) and items meet orders once.
    dated = relational.semi_filter(orders.select(order_id, *[c.alias(name) for name, c in periods.items()]), (payments, order_id))
    # Items are folded to distinct (period, seller, product) before the seller and
    # product tests, so those joins never see item rows.  They are inner joins
    # with distinct keys, because a semi join would be pushed below the fold.
    base = cleaning.dedupe_rows(items.select(order_id, seller_id, product_id).join(dated, order_id)
                                .select(*periods, seller_id, product_id))
    for known, key in ((sellers, seller_id), (products, product_id)):
        base = base.join(cleaning.dedupe_rows(known.select(key)), key)
    return base


def active_seller_sketches(items: DataFrame, orders: DataFrame, payments: DataFrame, sellers: DataFrame, products: DataFrame,
                           lg_k: int = sketches.LG_K, *, order_id: str = "order_id", seller_id: str = "seller_id",
                           product_id: str = "product_id", approved: str = "order_approved_at") -> DataFrame:
    """Per year and month of order approval: sketches of the distinct sellers and products, to be stored and united later."""
    periods = {"year": year_of(approved), "month": F.month(approved)}
    base = _sold_by_period(items, orders, payments, sellers, products, periods, order_id, seller_id, product_id)
    return sketches.distinct_sketches(base, list(periods), {"active_seller": seller_id, "product_count": product_id}, lg_k)


def active_sellers_of_sketches(stored: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """``active_sellers_by_year`` by estimate, from ``active_seller_sketches``; also by month or, without ``by``, over all.

    A seller of several months counts once.  The estimates' error is that of ``sketches.error_bound``.
    """
    names = ["active_seller", "product_count"]
    return sketches.estimates(sketches.unite(stored, list(by), names), names)


# Q3 ---------------------------------------------------------------------------------------------
def customer_share_by_state(customers: DataFrame, distinct: bool = False, *,
                            state: str = "customer_state",
                            counted: str = "customer_unique_id") -> DataFrame:
    """Customers per state, share of all customers and running share (2 decimals).

    ``counted`` rows are counted (``distinct=True`` counts distinct values).
    """
    out = aggregate.share_with_running_total(
        customers, state, counted, distinct=distinct, count_name="no_customers",
        share_name="percentage_customer_base", running_name="running_total_percentage")
    return out.orderBy(F.col("no_customers").desc())


# Q4 ---------------------------------------------------------------------------------------------
ROUTE_COLUMNS = ["i.order_id", "i.price", "i.seller_id", "s.seller_state", "o.customer_id", "c.customer_state"]
ROUTE_FROM = """
FROM {items} AS i
JOIN {sellers} AS s ON i.seller_id = s.seller_id
JOIN ({orders} AS o JOIN {customers} AS c ON o.customer_id = c.customer_id)
  ON i.order_id = o.order_id
"""


def item_route(spark: SparkSession, items: DataFrame, sellers: DataFrame, orders: DataFrame,
               customers: DataFrame, extra_item_columns: Sequence[str] = ()) -> DataFrame:
    """One row per item with the seller's state and the buyer's state (SQL source).

    Orders meet customers first: that join is order-sized, and only its
    result meets the larger item table.  ``extra_item_columns`` are carried
    from the item table as well.
    """
    columns = [f"i.{c}" for c in extra_item_columns] + ROUTE_COLUMNS
    query = "SELECT " + ", ".join(columns) + ROUTE_FROM
    return run_sql(spark, query, items=items, sellers=sellers, orders=orders, customers=customers)


def state_trade_balance(route: DataFrame, dedupe_keys: Sequence[str] | None = None,
                        classifier: Callable[[Column], Column] = classify.margin_category, *,
                        price: str = "price", seller_state: str = "seller_state",
                        buyer_state: str = "customer_state") -> DataFrame:
    """Sell value vs buy value per state, for every state that buys.

    Same answer as "buyers LEFT JOIN sellers ON state": states that only
    sell are not in the result, ``sell_value`` is 0 where a state sells
    nothing, and ``seller_state`` repeats the buyer's state.

    ``route`` rows are de-duplicated (over ``dedupe_keys``, default every
    column) and summed once per (seller state, buyer state) pair.  From the
    four tables themselves, ``trade_balance_of_tables`` shuffles less.
    """
    rows = cleaning.dedupe_rows(route, dedupe_keys)
    pairs = rows.groupBy(seller_state, buyer_state).agg(
        sum_exact(price).alias("_v"), F.sum(residue(price)).alias("_o"))
    return _balance_of_pairs(pairs, classifier, seller_state, buyer_state)


def trade_balance_of_tables(items: DataFrame, sellers: DataFrame, orders: DataFrame, customers: DataFrame,
                            extra_item_columns: Sequence[str] = (),
                            classifier: Callable[[Column], Column] = classify.margin_category, *,
                            order_id: str = "order_id", customer_id: str = "customer_id",
                            seller_id: str = "seller_id", price: str = "price",
                            seller_state: str = "seller_state", buyer_state: str = "customer_state") -> DataFrame:
    """``state_trade_balance`` of ``item_route``, from the four tables.

    Every join key is a column of the route, so the distinct route is the
    join of the distinct inputs.  Items are de-duplicated first, on a key
    that spreads a hot order; they meet their orders and are summed per
    (seller, buyer state), and only those sums meet the sellers.  The sums
    follow the order join by a shuffle, so AQE can split a hot order there.
    """
    bought = cleaning.dedupe_rows(items.select(*extra_item_columns, order_id, price, seller_id))
    located = cleaning.dedupe_rows(orders.select(order_id, customer_id)).join(
        cleaning.dedupe_rows(customers.select(customer_id, buyer_state)), customer_id)
    per_seller = bought.join(located, order_id).groupBy(seller_id, buyer_state).agg(
        sum_exact(price).alias("_v"), F.sum(residue(price)).alias("_o"))
    pairs = (per_seller.join(cleaning.dedupe_rows(sellers.select(seller_id, seller_state)), seller_id)
             .groupBy(seller_state, buyer_state).agg(F.sum("_v").alias("_v"), F.sum("_o").alias("_o")))
    return _balance_of_pairs(pairs, classifier, seller_state, buyer_state)


def _balance_of_pairs(pairs: DataFrame, classifier: Callable[[Column], Column], seller_state: str,
                      buyer_state: str) -> DataFrame:
    """The balance per state from at most states x states rows of money sums, unpivoted to (state, side, value)."""
    sides = pairs.unpivot(["_v", "_o"], [seller_state, buyer_state], "_side", "_state")
    selling, buying = F.col("_side") == seller_state, F.col("_side") == buyer_state

    def side_total(on: Column) -> Column:
        return money_total(F.sum(F.when(on, F.col("_v"))), F.sum(F.when(on, F.col("_o"))))

    per_state = sides.groupBy("_state").agg(
        side_total(selling).alias("_sell"), side_total(buying).alias("buy_value"),
        F.count_if(buying).alias("_buyer_rows"))
    # A null state never matches in the join this mirrors, so it sells nothing.
    sell = F.when(F.col("_state").isNull(), F.lit(0.0)).otherwise(F.col("_sell"))
    out = per_state.where(F.col("_buyer_rows") > 0).select(
        F.col("_state").alias(buyer_state), "buy_value", sell.alias("sell_value"))
    out = cleaning.fill_numeric(out, 0, subset=["sell_value"])
    out = cleaning.copy_column(out, seller_state, F.col(buyer_state))
    margin = F.col("sell_value") - F.col("buy_value")
    return out.select(
        F.col(buyer_state), F.col("buy_value"), F.col(seller_state), F.col("sell_value"),
        margin.alias("margin_activity"), classifier(margin).alias("margin_category"))


def state_counts_left_join(buyers: DataFrame, sellers: DataFrame, *, buyer_state: str = "customer_state",
                           seller_state: str = "seller_state", buyer_id: str = "customer_id",
                           seller_id: str = "seller_id") -> DataFrame:
    """Customers and sellers per state for every state with customers.

    An aliased LEFT JOIN on an expression key between two per-state
    aggregates; states without sellers get 0 and take the buyer's state
    name.
    """
    b = buyers.groupBy(buyer_state).agg(F.count(buyer_id).alias("customers")).alias("buyer")
    s = sellers.groupBy(seller_state).agg(F.count(seller_id).alias("sellers")).alias("seller")
    joined = b.join(s, F.col(f"buyer.{buyer_state}") == F.col(f"seller.{seller_state}"), "left")
    joined = cleaning.fill_numeric(joined, 0, subset=["sellers"])
    joined = cleaning.copy_column(joined, seller_state, F.col(f"buyer.{buyer_state}"))
    return joined.select(F.col(buyer_state), "customers", F.col(seller_state), "sellers")


# Q5 ---------------------------------------------------------------------------------------------
def hour_weekday_matrix(orders: DataFrame, *, ts: str = "order_purchase_timestamp",
                        order_id: str = "order_id") -> DataFrame:
    """Orders per hour (rows) and weekday (Monday..Sunday columns), hour descending.

    Rows are de-duplicated on (timestamp, id) first.  A cell with no order
    is null.  The seven weekday columns always exist.
    """
    rows = cleaning.dedupe_rows(orders.select(ts, order_id))
    # Pivot on the weekday number and name the seven columns afterwards, so no
    # day name is formatted per row (Spark numbers days 1 = Sunday .. 7 = Saturday).
    rows = rows.select(hour_of(ts).alias("hour"), F.dayofweek(F.col(ts).cast("date")).alias("_day"),
                       F.col(order_id))
    numbers = [(i + 1) % 7 + 1 for i in range(len(WEEKDAYS))]   # Monday -> 2 ... Sunday -> 1
    matrix = aggregate.pivot_count(rows, "hour", "_day", counted=order_id, values=numbers, fill=None)
    named = [F.col(f"`{n}`").alias(d) for n, d in zip(numbers, WEEKDAYS)]
    return matrix.select("hour", *named).orderBy(F.col("hour").desc())


# Q6 ---------------------------------------------------------------------------------------------
def payment_summary(payments: DataFrame, *, payment_type: str = "payment_type",
                    value: str = "payment_value",
                    installments: str = "payment_installments") -> DataFrame:
    """Total payment value and mean installments per payment type, type ascending."""
    return (payments.groupBy(payment_type)
            .agg(exact_sum(value).alias("total_payment_value"),
                 F.avg(installments).alias("avg_installments"))
            .orderBy(F.col(payment_type).asc_nulls_first()))


def payment_partials(payments: DataFrame, *, payment_type: str = "payment_type", value: str = "payment_value",
                     installments: str = "payment_installments") -> DataFrame:
    """What one load of payments adds to ``payment_summary``: a row for each payment type."""
    return partials.money_partials(payments, [payment_type], money=[value], means=[installments])


def payment_summary_of_partials(merged: DataFrame, *, payment_type: str = "payment_type", value: str = "payment_value",
                                installments: str = "payment_installments") -> DataFrame:
    """``payment_summary`` from ``payment_partials`` of any number of loads, merged."""
    return (merged.select(payment_type, partials.total(value).alias("total_payment_value"), partials.mean(installments).alias("avg_installments"))
            .orderBy(F.col(payment_type).asc_nulls_first()))


# Q7 ---------------------------------------------------------------------------------------------
def orders_per_state(customers: DataFrame, orders: DataFrame, *, customer_id: str = "customer_id",
                     order_id: str = "order_id", state: str = "customer_state") -> DataFrame:
    """Orders per customer state, smallest count first.

    Orders are counted per customer before the customer join, so the join
    is customer-sized and a hot customer is folded map-side.
    """
    per_customer = orders.groupBy(customer_id).agg(F.count(order_id).alias("_n"))
    joined = customers.select(customer_id, state).join(per_customer, customer_id)
    return (joined.groupBy(state).agg(F.sum("_n").alias("order_count"))
            .orderBy(F.col("order_count").asc()))


# Q8 ---------------------------------------------------------------------------------------------
def customer_behaviour(orders: DataFrame, payments: DataFrame, grain: str = "payment", *,
                       order_id: str = "order_id", customer_id: str = "customer_id",
                       value: str = "payment_value") -> DataFrame:
    """Orders per customer and their average value, highest average first.

    ``grain="payment"``: the mean over the customer's payment rows.
    ``grain="order"``: the mean over orders of each order's payment total.
    Customers without any payment row are left out.

    Payments are folded per order, so orders are read and meet them once, and
    one aggregate per customer gives both measures.
    """
    if grain not in ("payment", "order"):
        raise ValueError("grain must be 'payment' or 'order'")
    per_order = payments.groupBy(order_id).agg(
        sum_exact(value).alias("_paid"), F.sum(residue(value)).alias("_odd"),
        F.count(value).alias("_values"), F.count("*").alias("_rows"))
    valued = F.col("_paid").isNotNull() | F.col("_odd").isNotNull()
    number = F.sum("_values") if grain == "payment" else F.count_if(valued)
    mean = F.try_divide(money_total(F.sum("_paid"), F.sum("_odd")), number.cast("double"))
    joined = orders.select(order_id, customer_id).where(F.col(customer_id).isNotNull()).join(per_order, order_id, "left")
    return (joined.groupBy(customer_id)
            .agg(F.count(order_id).alias("order_count"), mean.alias("average_order_value"), F.sum("_rows").alias("_rows"))
            .where(F.col("_rows") > 0)
            .select(customer_id, "order_count", "average_order_value")
            .orderBy(F.col("average_order_value").desc()))


def top_customers(behaviour: DataFrame, k: int = 20, *, customer_id: str = "customer_id") -> DataFrame:
    """The ``k`` customers with the highest average value (ties by id)."""
    return relational.top_k(behaviour, k, [F.col("average_order_value").desc_nulls_last()],
                            [F.col(customer_id).asc()])


# Q9 ---------------------------------------------------------------------------------------------
def size_classified(products: DataFrame, classifier=classify.product_size_class, *,
                    product_id: str = "product_id", length: str = "product_length_cm",
                    width: str = "product_width_cm", height: str = "product_height_cm",
                    weight: str = "product_weight_g") -> DataFrame:
    return products.withColumn("product_size_category",
                               classifier(F.col(length), F.col(width), F.col(height), F.col(weight)))


def value_by_product_size(items: DataFrame, products: DataFrame, classifier=classify.product_size_class,
                          *, product_id: str = "product_id", price: str = "price",
                          **dimension_columns: str) -> DataFrame:
    """Mean item price per product size class (2 decimals).

    Items are summed per product before the join, so the join and the
    shuffle feeding it are product-sized, not item-sized.
    """
    per_product = items.groupBy(product_id).agg(
        sum_exact(price).alias("_sum"), F.sum(residue(price)).alias("_odd"), F.count(price).alias("_n"))
    classes = size_classified(products, classifier, product_id=product_id, **dimension_columns)
    joined = per_product.join(classes.select(product_id, "product_size_category"), product_id)
    return (joined.groupBy("product_size_category")
            .agg(money_total(F.sum("_sum"), F.sum("_odd")).alias("_sum"), F.sum("_n").cast("double").alias("_n"))
            .select("product_size_category",
                    round_half_up(F.try_divide("_sum", "_n"), 2).alias("average_order_value")))


# Q10 --------------------------------------------------------------------------------------------
def seller_monthly_growth(orders: DataFrame, items: DataFrame, calendar: bool = False, *,
                          order_id: str = "order_id", seller_id: str = "seller_id",
                          ts: str = "order_purchase_timestamp", price: str = "price") -> DataFrame:
    """Per seller and month: sales (float), previous month's sales, growth %."""
    sums = seller_month_sums(orders, items, order_id=order_id, seller_id=seller_id, ts=ts, price=price)
    return seller_growth_of_sums(sums, calendar, seller_id=seller_id)


def seller_month_sums(orders: DataFrame, items: DataFrame, *, order_id: str = "order_id", seller_id: str = "seller_id",
                      ts: str = "order_purchase_timestamp", price: str = "price") -> DataFrame:
    """What one load of orders, with their items, adds to ``seller_monthly_growth``: a row for each seller and month."""
    combined = orders.select(order_id, ts).join(items.select(order_id, seller_id, price), order_id)
    return aggregate.month_sums(combined, seller_id, ts, price)


def seller_growth_of_sums(merged: DataFrame, calendar: bool = False, *, seller_id: str = "seller_id") -> DataFrame:
    """``seller_monthly_growth`` from ``seller_month_sums`` of any number of loads, merged."""
    return aggregate.growth_of_sums(merged, seller_id, calendar)
