"""Approximate distinct counts as sketches that can be stored and united later.

A sketch takes a few KB whatever it counts.  Groups of a fine grain (months)
are sketched once, and any coarser grain (years, all) is a union of stored
sketches: no input row is read again, and a value that is in several groups
counts once.  The relative standard error is 1.04 / sqrt(2^lg_k); small
groups are counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import DataFrame, functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """The relative error that an estimate stays below, at so many standard deviations."""
    return deviations * 1.04 / sqrt(2 ** lg_k)


def distinct_sketches(df: DataFrame, by: Sequence[str], counted: Mapping[str, str], lg_k: int = LG_K) -> DataFrame:
    """One row for each group ``by``, with a sketch of each counted column's distinct values: {new name: column}.

    Nulls do not count.  Integers, text and binary can be counted.
    """
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(name) for name, c in counted.items()])


def unite(sketches: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The sketches ``names`` united for each group ``by``, a subset of the columns they were made for (or none)."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(n).alias(n) for n in names])


def estimates(sketches: DataFrame, names: Sequence[str]) -> DataFrame:
    """The sketches ``names`` replaced by the distinct counts they stand for."""
    return sketches.select([F.hll_sketch_estimate(c).alias(c) if c in names else F.col(c) for c in sketches.columns])
