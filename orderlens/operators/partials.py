"""Partial tables that add up: an aggregate kept load by load.

Each load of new rows is folded to a small table of exact sums and counts.
Any number of such tables, in any order, add up to the partials of all rows
together, from which the result follows.  Old rows are never read again.

A folder keeps the loads under their names.  Adding a load again replaces
what the name held, so a repeated load does not count twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.functions.scalar import money_total, residue, sum_exact
from orderlens.sources.files import write_result


def money_partials(df: DataFrame, by: Sequence[str], money: Sequence[str] = (), means: Sequence[str] = ()) -> DataFrame:
    """For each group: rows; for a money column c: c_exact, c_residue and c_count; for an integer column c of ``means``: c_sum and c_count."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in money:
        aggs += [sum_exact(c).alias(f"{c}_exact"), F.sum(residue(c)).alias(f"{c}_residue"), F.count(c).alias(f"{c}_count")]
    for c in means:
        aggs += [F.sum(F.col(c).cast("long")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count")]
    return df.groupBy(*by).agg(*aggs)


def merge(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partial rows of equal groups added up; every other column is a sum (null where all are)."""
    return partials.groupBy(*by).agg(*[F.sum(c).cast(t).alias(c) for c, t in partials.dtypes if c not in by])


def total(column: str):
    """The sum of a money column, from its partials."""
    return money_total(f"{column}_exact", f"{column}_residue")


def mean(column: str):
    """The mean of an integer column, from its partials; null without values."""
    return F.try_divide(F.col(f"{column}_sum").cast("double"), F.col(f"{column}_count").cast("double"))


def add_load(partials: DataFrame, path: str, load: str) -> None:
    """Keep ``partials`` in the folder ``path`` as the load ``load``, in place of an earlier one of that name."""
    write_result(partials.withColumn("load", F.lit(load)), path, partition_by=["load"], mode="replace_partitions")


def all_loads(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The loads of the folder added up."""
    return merge(spark.read.parquet(path).drop("load"), by)
