"""Cleaning operators: pure ``DataFrame -> DataFrame`` functions.

Each one is a projection or a filter, so it stays inside one whole-stage
codegen span, pushes down where Parquet allows it, and works unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.scalar import one_blank
from orderlens.operators.relational import lookup_column

_FLOATING = (T.FloatType, T.DoubleType)

SPELLINGS = "UNICODE_CI_AI"         # the collation of text in any case, with or without accents


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _pick(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    return list(columns) if columns is not None else string_columns(df)


def map_columns(df: DataFrame, fn, columns: Iterable[str]) -> DataFrame:
    """Apply ``fn(Column) -> Column`` to the named columns; keep the rest and the order."""
    chosen = set(columns)
    return df.select([fn(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def trim_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Strip leading and trailing blanks (spaces) from string columns."""
    return map_columns(df, F.trim, _pick(df, columns))


def collapse_whitespace(df: DataFrame, columns: Iterable[str] | None = None,
                        all_columns: bool = False) -> DataFrame:
    """Turn every run of whitespace into one blank.

    String columns by default; ``all_columns=True`` applies it to every
    column, which turns all of them into strings.
    """
    chosen = df.columns if all_columns else _pick(df, columns)
    return map_columns(df, one_blank, chosen)


def replace_values(df: DataFrame, mapping: dict[str, str],
                   columns: Iterable[str] | None = None) -> DataFrame:
    """Whole-cell, exact, case-sensitive replacement in string columns."""
    subset = _pick(df, columns)
    return df.replace(mapping, subset=subset) if subset else df


def unify_spellings(df: DataFrame, columns: Iterable[str], collation: str = SPELLINGS) -> DataFrame:
    """Give values that are one under ``collation`` (by default: in any case, with or without accents) one spelling, the smallest.

    Opt-in; all other operators compare text byte by byte.  The distinct
    values are grouped by collation, and only they: the rows then look their
    value up.  A null stays null; trailing blanks count.
    """
    for column in columns:
        values = df.select(F.col(column).alias("_value")).distinct()
        groups = values.groupBy(F.collate("_value", collation).alias("_key")).agg(F.min("_value").alias("_spelling"))
        known = values.join(groups, F.collate("_value", collation) == F.col("_key")).select("_value", "_spelling")
        order = df.columns
        df = lookup_column(df, column, known, "_value", "_spelling", "_unified")
        df = df.select([F.col("_unified").alias(c) if c == column else F.col(c) for c in order])
    return df


def _missing(column: str, dtype: T.DataType) -> Column:
    c = F.col(column)
    return (c.isNull() | F.isnan(c)) if isinstance(dtype, _FLOATING) else c.isNull()


def missing(df: DataFrame, column: str) -> Column:
    """True when the cell is null, or NaN in a floating-point column."""
    return _missing(column, df.schema[column].dataType)


def all_present(df: DataFrame, subset: Iterable[str] | None = None) -> Column:
    """True when no column of ``subset`` (default: all) is missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cond = F.lit(True)
    for name in (list(subset) if subset is not None else list(types)):
        cond = cond & ~_missing(name, types[name])
    return cond


def drop_nulls(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Keep rows with no null (or NaN) in ``subset`` (default: all columns).

    Written as a conjunction of ``IS NOT NULL`` so the filter reaches the
    Parquet scan, which ``dropna`` does not.
    """
    return df.where(all_present(df, subset))


def fill_numeric(df: DataFrame, value: float = 0, subset: Iterable[str] | None = None) -> DataFrame:
    """Replace null and NaN in numeric columns (or ``subset``) by ``value``."""
    return df.na.fill(value, subset=list(subset) if subset is not None else None)


def lookup_translate(df: DataFrame, lookup: DataFrame, key: str, translated: str, collation: str | None = None) -> DataFrame:
    """Replace ``key`` by its translation from ``lookup`` (left join semantics).

    Keys without a translation become null.  With ``collation`` (such as
    ``SPELLINGS``) keys match under it; of several spellings in ``lookup``
    the smallest gives the translation.
    """
    if collation:
        first = F.min(F.struct(F.col(key).alias("_spelling"), F.col(translated).alias("_text")))
        lookup = lookup.groupBy(F.collate(key, collation).alias(key)).agg(first.alias("_first")).select(key, F.col("_first._text").alias(translated))
    out = lookup_column(df, key, lookup, key, translated, "_translated", collation)
    return out.select([F.col("_translated").alias(key) if c == key else F.col(c) for c in df.columns])


def conditional_override(df: DataFrame, target: str, condition: Column, value) -> DataFrame:
    """``target := value`` where ``condition`` holds; unchanged elsewhere (null condition too)."""
    new = F.when(condition, F.lit(value) if not isinstance(value, Column) else value)
    return df.withColumn(target, new.otherwise(F.col(target)).cast(df.schema[target].dataType))


def zero_undefined_installments(payments: DataFrame, type_col: str = "payment_type",
                                installments_col: str = "payment_installments",
                                undefined: str = "not_defined") -> DataFrame:
    """Installments become 0 for the undefined payment type."""
    return conditional_override(payments, installments_col, F.col(type_col) == undefined, 0)


def dedupe_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Distinct rows; with ``subset``, of rows equal there the one whose columns, in order, are smallest."""
    if subset is None:
        return df.dropDuplicates()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*subset).agg(F.min(row).alias("_row")).select("_row.*")


def copy_column(df: DataFrame, target: str, source: Column | str) -> DataFrame:
    return df.withColumn(target, F.col(source) if isinstance(source, str) else source)
