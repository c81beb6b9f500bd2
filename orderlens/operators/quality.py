"""Data-quality measures returned as one-row DataFrames.

The first four take one pass each.  ``write_clean`` takes none of its own:
its figures are collected inside the job that writes the cleaned rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orderlens.operators.cleaning import all_present, missing
from orderlens.sources.files import write_result


def clean_counts(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Rows before and after dropping rows with a missing value."""
    keep = all_present(df, subset)
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(keep).alias("rows_after")).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"))


def null_audit(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows with any missing value, plus a missing count per column (``<col>_nulls``)."""
    cols = list(columns) if columns is not None else df.columns
    return df.agg(F.count(F.lit(1)).alias("rows_total"), *_null_counts(df, cols))


def _null_counts(df: DataFrame, cols: list[str]) -> list[Column]:
    return [F.count_if(~all_present(df, cols)).alias("rows_with_null"),
            *[F.count_if(missing(df, c)).alias(f"{c}_nulls") for c in cols]]


def duplicate_audit(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Total rows, distinct rows and surplus copies.

    Groups by the row itself; partial aggregation folds copies map-side, so a
    value repeated in a third of all rows is never shipped row by row.
    """
    keys = list(subset) if subset is not None else df.columns
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.sum("_copies").cast("bigint").alias("rows_total"),
                      F.count(F.lit(1)).alias("rows_distinct")).select(
        F.coalesce("rows_total", F.lit(0)).alias("rows_total"), "rows_distinct",
        (F.coalesce("rows_total", F.lit(0)) - F.col("rows_distinct")).alias("duplicate_rows"))


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


class CleanFigures(NamedTuple):
    """One-row DataFrames with the columns of the functions of the same names."""

    clean_counts: DataFrame
    null_audit: DataFrame
    row_count: DataFrame


def write_clean(df: DataFrame, path: str, subset: Iterable[str] | None = None, columns: Iterable[str] | None = None,
                **sink) -> CleanFigures:
    """Drop the rows with a missing value in ``subset``, write the rest to ``path`` and count in that same job.

    The figures are those of ``clean_counts(df, subset)``, of
    ``null_audit(df, columns)`` and of ``row_count`` over what was written;
    ``sink`` goes to ``write_result``.

    Repeated tasks: the metrics of a task reach the driver when it ends, and
    a task of the writing stage counts once, however often it is tried or
    speculated.  That holds where rows are read and written without a
    shuffle between (a scan and row-wise cleaning).  Above a shuffle, tasks
    that run again because their shuffle files were lost count again, so
    write such a frame first and count from there.
    The filter cannot reach the scan here: rows it would skip must be counted.
    """
    keys = list(subset) if subset is not None else df.columns
    cols = list(columns) if columns is not None else df.columns
    keep = all_present(df, keys)
    before, after = Observation(), Observation()
    counted = df.observe(before, F.count(F.lit(1)).alias("rows_total"), F.count_if(keep).alias("rows_after"), *_null_counts(df, cols))
    write_result(counted.where(keep).observe(after, F.count(F.lit(1)).alias("row_count")), path, **sink)
    seen, written = before.get, after.get
    spark = df.sparkSession

    def one_row(figures: dict[str, int]) -> DataFrame:
        return spark.createDataFrame([tuple(figures.values())], ", ".join(f"`{name}` long" for name in figures))

    return CleanFigures(
        one_row({"rows_before": seen["rows_total"], "rows_after": seen["rows_after"], "rows_dropped": seen["rows_total"] - seen["rows_after"]}),
        one_row({name: seen[name] for name in ("rows_total", "rows_with_null", *[f"{c}_nulls" for c in cols])}),
        one_row({"row_count": written["row_count"]}))
