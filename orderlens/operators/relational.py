"""Join, selection and ordering helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_column(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, lookup_value: str, alias: str,
                  collation: str | None = None) -> DataFrame:
    """Add ``alias`` = ``lookup_value`` of the ``lookup`` row whose ``lookup_key`` equals ``key``.

    A plain left join: no match gives null, a repeated key repeats the row.
    Spark broadcasts the lookup by its measured size, or shuffles it.  With
    ``collation`` the text keys are compared under it.
    """
    right = lookup.select(F.col(lookup_key).alias("_lookup_key"), F.col(lookup_value).alias(alias))
    own, other = F.col(key), F.col("_lookup_key")
    same = F.collate(own, collation) == F.collate(other, collation) if collation else own == other
    return df.join(right, same, "left").drop("_lookup_key")


def semi_filter(df: DataFrame, *conditions: tuple[DataFrame, str | Sequence[str]]) -> DataFrame:
    """Keep rows of ``df`` that have a partner in each ``(other, key)`` (EXISTS).

    A join used only to test existence must not multiply rows; a left semi
    join never does.
    """
    for other, key in conditions:
        keys = [key] if isinstance(key, str) else list(key)
        df = df.join(other.select(*keys), on=keys, how="left_semi")
    return df


def project(df: DataFrame, columns: Iterable[str | Column]) -> DataFrame:
    return df.select(*columns)


def top_k(df: DataFrame, k: int, order: Sequence[Column], tie_breakers: Sequence[Column] = ()) -> DataFrame:
    """First ``k`` rows by ``order``; tie-breakers make the cut deterministic.

    Planned as TakeOrderedAndProject: each partition keeps its own top ``k``,
    so no full sort is shuffled.
    """
    return df.orderBy(*order, *tie_breakers).limit(k)
