"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.sources.scratch import remove_run, ship_package, store  # noqa: F401

WHITE = " \t\n\x0b\x0c\r"           # the characters of [\x20\x09-\x0D]
HEAVY_SHARE = 1000                  # a key with at least 1/1000 of the rows is heavy


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that columns added beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_of(name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row for each ``key`` and the number of its rows in ``size``.

    Keys with at least ``total / HEAVY_SHARE`` rows number at most
    ``HEAVY_SHARE``, so that side is broadcast whatever the input; all other
    keys are too small to skew the shuffled join.
    """
    least = max(1, total // HEAVY_SHARE)
    heavy, light = groups.where(F.col(size) >= least), groups.where(F.col(size) < least)
    in_heavy = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return in_heavy.unionByName(rest.join(light, key))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums in a global order, both ends included, without a task that sees all rows.

    The rows are range-sorted and written; the sums of the ranges (one row for
    each) give the offsets, and a window within each range does the rest.
    """
    keys = {f"order{i}": c for i, c in enumerate(order)}
    columns = df.columns
    ranged = df.withColumns(keys | {f"sum{i}": c for i, c in enumerate(sums.values())}).repartitionByRange(*keys)
    ranged = store(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range").agg(*[F.sum(f"sum{i}").alias(f"total{i}") for i in range(len(sums))])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)         # one row a range
    offsets = totals.select("range", *[F.coalesce(F.sum(f"total{i}").over(before), F.lit(0)).alias(f"offset{i}") for i in range(len(sums))])
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), "range").select(
        *columns, *[(F.col(f"offset{i}") + F.sum(f"sum{i}").over(within)).alias(n) for i, n in enumerate(sums)])
