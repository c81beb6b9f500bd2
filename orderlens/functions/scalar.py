"""Scalar column functions.

All of them build Catalyst expressions, so they run inside whole-stage
codegen with no Python worker involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English weekday names in calendar order, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Money is summed exactly, to ten digits after the point, so a total does not
# depend on how rows are spread over partitions or in which order they are
# added.  Amounts that are whole cents are summed as longs, in two limbs, so
# that no sum overflows below 2^43 rows; all others as decimals beside them.
# Amounts from EXACT_BELOW on, and NaN and infinities, are summed as doubles,
# and only a total with such an amount may depend on the order; 1e13 rows of
# the largest exact amount still fit.
EXACT_BELOW = 1e15
CENTS_BELOW = 1e9
LIMB_BITS = 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_of(ts: Column | str) -> Column:
    return F.year(_col(ts))


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts))


def weekday_name(ts: Column | str) -> Column:
    """English day name (``EEEE``) of the timestamp's calendar day."""
    return F.date_format(_col(ts).cast("date"), "EEEE")


def month_key(ts: Column | str) -> Column:
    """``yyyy-MM`` text of a timestamp: the first seven characters of its text."""
    return F.date_format(_col(ts), "yyyy-MM")


def one_blank(text: Column | str) -> Column:
    """Every run of white space turned into one blank."""
    return F.regexp_replace(_col(text), r"\s+", " ")


def text_to_timestamp(text: Column | str, strict: bool = False) -> Column:
    """Text to timestamp (no zone).  Unparseable text gives null unless ``strict``."""
    c = _col(text)
    return c.cast("timestamp_ntz") if strict else c.try_cast("timestamp_ntz")


def float32(c: Column | str) -> Column:
    return _col(c).cast("float")


def round_half_up(c: Column | str, scale: int = 2) -> Column:
    """Round half up once, on the number's shortest decimal text; NaN and infinities stay."""
    return F.round(_col(c), scale)


def exact_part(c: Column | str) -> Column:
    """A money amount as ``decimal(38,10)``; null where it belongs to ``residue``."""
    x = _col(c)
    return F.when(F.abs(x) < EXACT_BELOW, x).cast("decimal(38,10)")


def residue(c: Column | str) -> Column:
    """A money amount that no ``exact_part`` holds (from EXACT_BELOW on, NaN, infinite); null otherwise."""
    x = _col(c)
    return F.when(F.abs(x) >= EXACT_BELOW, x).cast("double")


def sum_exact(c: Column | str) -> Column:
    """The sum of the ``exact_part`` of a money column, as ``decimal(38,10)``; null if there is none.

    A double below CENTS_BELOW that is the one nearest to some whole cents
    stands for just these cents, so both forms add up the same numbers.
    """
    x = _col(c).cast("double")
    cents = F.rint(x * 100)
    whole = (F.abs(x) < CENTS_BELOW) & (cents / 100 == x)
    n = F.when(whole, cents.cast("long"))
    high, low = F.sum(F.shiftright(n, LIMB_BITS)), F.sum(n.bitwiseAND(F.lit((1 << LIMB_BITS) - 1)))
    in_cents = high.cast("decimal(38,0)") * F.lit(1 << LIMB_BITS).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    in_cents = (in_cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(37,10)")
    others = F.sum(exact_part(F.when(~whole, _col(c)))).cast("decimal(37,10)")
    both = F.coalesce(in_cents, F.lit(0).cast("decimal(37,10)")) + F.coalesce(others, F.lit(0).cast("decimal(37,10)"))
    return F.when(in_cents.isNotNull() | others.isNotNull(), both).cast("decimal(38,10)")


def money_total(exact: Column | str, rest: Column | str) -> Column:
    """The sum of the exact parts plus the sum of the residues, as double; null if both are."""
    total, odd = _col(exact).cast("double"), _col(rest)
    return F.when(odd.isNull(), total).otherwise(odd + F.coalesce(total, F.lit(0.0)))


def exact_sum(c: Column | str) -> Column:
    """Sum of a money column, exact to ten digits after the point, returned as double."""
    return money_total(sum_exact(c), F.sum(residue(c)))


def exact_avg(c: Column | str) -> Column:
    """Mean of a money column over its non-null values (exact sum / count)."""
    return F.try_divide(exact_sum(c), F.count(_col(c)).cast("double"))


def growth_pct(current: Column | str, previous: Column | str) -> Column:
    """``(current - previous) / previous * 100``; null when previous is 0 or null."""
    cur, prev = _col(current), _col(previous)
    return F.try_divide(cur - prev, prev) * F.lit(100)
