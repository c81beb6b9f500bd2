"""Row classifiers as column expressions (``CASE WHEN`` chains).

Each takes columns and returns a column, so a caller may pass any column
function of the same shape in their place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category labels.
MARGIN_LABELS = ("consumer_dominant", "balanced", "seller_dominant")
SIZE_LABELS = ("Small", "Medium", "Large", "Unknown")
# Size limits as (max edge in cm, max weight in g) for Small, then Medium.
SMALL_LIMITS = (20, 500)
MEDIUM_LIMITS = (40, 2000)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def margin_category(margin: Column | str) -> Column:
    """Sign of a margin: negative, zero, positive -> the three labels.

    Null and NaN margins give null.
    """
    m = _col(margin)
    negative, zero, positive = MARGIN_LABELS
    return (F.when(m.isNull() | F.isnan(m), F.lit(None).cast("string"))
            .when(m < 0, negative)
            .when(m == 0, zero)
            .otherwise(positive))


def product_size_class(length: Column | str, width: Column | str, height: Column | str,
                       weight: Column | str, small: tuple[float, float] = SMALL_LIMITS,
                       medium: tuple[float, float] = MEDIUM_LIMITS) -> Column:
    """Size class from three edges and a weight.

    Any null input -> Unknown; every edge and the weight within ``small`` ->
    Small; within ``medium`` -> Medium; otherwise Large.
    """
    edges = [_col(length), _col(width), _col(height)]
    w = _col(weight)
    small_label, medium_label, large_label, unknown_label = SIZE_LABELS

    def within(limits: tuple[float, float]) -> Column:
        edge_max, weight_max = limits
        cond = w <= weight_max
        for e in edges:
            cond = cond & (e <= edge_max)
        return cond

    any_null = w.isNull()
    for e in edges:
        any_null = any_null | e.isNull()
    return (F.when(any_null, unknown_label)
            .when(within(small), small_label)
            .when(within(medium), medium_label)
            .otherwise(large_label))
