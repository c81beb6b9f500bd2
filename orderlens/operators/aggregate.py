"""Grouping, pivot and window building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.scalar import float32, growth_pct, money_total, residue, round_half_up, sum_exact
from orderlens.sources.scratch import store

LEVEL_BUCKETS = 1024               # ranges of a running share: 16 to a doubling of the count, up to 2^64


def discover_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of ``column`` (nulls first), one for each output column of a pivot; one aggregate job.

    The driver holds as many values as the result has columns; beyond some
    thousands of columns Spark takes long to plan any query.
    """
    return [r[0] for r in df.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).collect()]


def _only(column: str, values: list) -> Column:
    """``column``, failing on a value that is not in ``values``."""
    listed = F.lit(False)
    for v in values:
        listed = listed | F.col(column).eqNullSafe(F.lit(v))
    told = F.concat(F.lit(f"{column} has a value that is not among the pivot values: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.when(listed, F.col(column)).otherwise(F.raise_error(told))


def folded_cells(df: DataFrame, row: str | Sequence[str], column: str, measure: Column) -> DataFrame:
    """``measure`` for each ``row`` x value of ``column``, as ``_cell``: the table that a pivot lays out."""
    rows = [row] if isinstance(row, str) else list(row)
    return df.groupBy(*rows, column).agg(measure.alias("_cell"))


def _pivot(df: DataFrame, row: str | Sequence[str], column: str, measure: Column,
           values: Sequence | None, fill: int | None, null_label: str | None) -> DataFrame:
    rows = [row] if isinstance(row, str) else list(row)
    if values is None:
        # The folded cells are written once; the values and the pivot are read from there, so ``df`` is computed once.
        df, measure = store(folded_cells(df, rows, column, measure), "cells"), F.sum("_cell")
        vals = discover_values(df, column)
    else:
        vals = list(dict.fromkeys(values))
        df = df.withColumn(column, _only(column, vals))
    if None in vals and (null_label is not None or "null" in vals):     # a label that is also a value gets one column
        label = "null" if null_label is None else null_label
        df = df.withColumn(column, F.coalesce(F.col(column), F.lit(label)))
        vals = list(dict.fromkeys(label if v is None else v for v in vals))
    out = df.groupBy(*rows).pivot(column, vals).agg(measure)
    if fill is not None:
        out = out.na.fill(fill, subset=[c for c in out.columns if c not in rows])
    return out


def pivot_count(df: DataFrame, row: str | Sequence[str], column: str, counted: str,
                values: Sequence | None = None, fill: int | None = 0,
                null_label: str | None = None) -> DataFrame:
    """Count of non-null ``counted`` per ``row`` x value of ``column``.

    One output column per value, in the order of ``values`` (discovered and
    sorted when not given).  A null value gets a column named ``null``, or
    ``null_label`` when given (in the null column's place).  Cells without
    rows are null; ``fill`` replaces them (``None`` keeps nulls).  Map-side
    partial counts mean a hot row key costs one row per partition in the
    shuffle.
    """
    return _pivot(df, row, column, F.count(F.col(counted)), values, fill, null_label)


def pivot_sum(df: DataFrame, row: str | Sequence[str], column: str, summed: str,
              values: Sequence | None = None, fill: int | None = 0,
              null_label: str | None = None) -> DataFrame:
    """Sum of ``summed`` per ``row`` x value of ``column``; same layout rules as ``pivot_count``."""
    return _pivot(df, row, column, F.sum(F.col(summed)), values, fill, null_label)


def share_with_running_total(df: DataFrame, key: str, counted: str, distinct: bool = False,
                             count_name: str = "n", share_name: str = "share_pct",
                             running_name: str = "running_share_pct", scale: int = 2) -> DataFrame:
    """Count per key, its share of all counts, and the running share.

    The running share orders keys by count, largest first, with a RANGE
    frame: keys with equal counts share one running value.

    Only the distinct count values need a global order, and that takes two
    steps: the levels fall into LEVEL_BUCKETS ranges by their logarithm,
    whose totals give the offsets, and each range is ordered by itself.
    """
    agg = F.countDistinct(counted) if distinct else F.count(F.col(counted))
    counts = df.groupBy(key).agg(agg.alias(count_name))
    steps = LEVEL_BUCKETS // 64                     # buckets to a doubling of the count
    levels = (counts.groupBy(count_name).agg(F.sum(count_name).alias("_level_total"))
              .withColumn("_range", F.floor(F.log2(F.greatest(F.col(count_name), F.lit(1))) * steps).cast("int")))
    larger = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)     # LEVEL_BUCKETS rows at most
    ranges = levels.groupBy("_range").agg(F.sum("_level_total").alias("_range_total")).select(
        "_range", F.coalesce(F.sum("_range_total").over(larger), F.lit(0)).alias("_above"),
        F.sum("_range_total").over(Window.partitionBy()).alias("_grand"))
    by_size = Window.partitionBy("_range").orderBy(F.col(count_name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.join(ranges, "_range").select(
        count_name, (F.col("_above") + F.sum("_level_total").over(by_size)).alias("_running"), "_grand")
    joined = counts.join(levels, on=count_name, how="inner")
    return joined.select(
        key, count_name,
        round_half_up(F.try_divide(F.col(count_name), F.col("_grand")) * 100, scale).alias(share_name),
        round_half_up(F.try_divide(F.col("_running"), F.col("_grand")) * 100, scale).alias(running_name))


def period_growth(df: DataFrame, key: str, ts: str, amount: str, calendar: bool = False,
                  period_name: str = "year_month", value_name: str = "monthly_sales",
                  prev_name: str = "prev_month_sales",
                  growth_name: str = "sales_growth_percentage") -> DataFrame:
    """Per key and month: summed amount (as float), the previous month's sum, growth %.

    The previous month is the previous month *present* for the key; with
    ``calendar=True`` it must also be the previous calendar month, else null.
    Growth against a zero or missing previous value is null.  The window
    runs on the (key, month) aggregate, so even a key holding a third of all
    rows contributes one row per month.
    """
    return growth_of_sums(month_sums(df, key, ts, amount), key, calendar, period_name, value_name, prev_name, growth_name)


def month_sums(df: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Per ``key`` and ``month`` (its first day): the amount as ``exact`` and ``residue`` parts, which add up over several loads."""
    # Group on the month's first day (a date) and format the key only on the
    # aggregated rows: no string formatting per input row.
    month = F.trunc(F.col(ts).cast("date"), "month")
    return df.groupBy(F.col(key), month.alias("month")).agg(sum_exact(amount).alias("exact"), F.sum(residue(amount)).alias("residue"))


def growth_of_sums(sums: DataFrame, key: str, calendar: bool = False, period_name: str = "year_month",
                   value_name: str = "monthly_sales", prev_name: str = "prev_month_sales",
                   growth_name: str = "sales_growth_percentage") -> DataFrame:
    """``period_growth`` from ``month_sums``."""
    monthly = sums.select(key, F.col("month").alias("_month"), money_total("exact", "residue").alias("_sum"))
    w = Window.partitionBy(key).orderBy(F.col("_month").asc_nulls_first())
    monthly = monthly.withColumn(value_name, float32("_sum"))
    prev = F.lag(value_name).over(w)
    if calendar:
        prev = F.when(F.lag("_month").over(w) == F.add_months("_month", -1), prev)
    monthly = monthly.withColumn(prev_name, prev).withColumn(period_name, F.date_format("_month", "yyyy-MM"))
    return monthly.select(key, period_name, value_name, prev_name,
                          growth_pct(value_name, prev_name).alias(growth_name))
