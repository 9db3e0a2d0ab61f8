"""Half-even rounding that does not pass through an inexact intermediate.

Means and weighted means of published figures hit exact ties often (the mean of
two six-decimal values does so half the time), so they are divided as decimals
with enough spare digits that only a true tie is rounded as one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from indexwright.schemas import VALUE


def as_index(value: Column) -> Column:
    """A computed double as a six-decimal index value."""
    return F.bround(value, 6).cast(VALUE)


def mean_of(value: Column, digits: int = 6) -> Column:
    """Aggregate: half-even mean of a decimal column with up to six decimals."""
    total = F.sum(value).cast("decimal(24,6)")
    return F.bround(total / F.count(value).cast("decimal(11,0)"), digits).cast(
        f"decimal(18,{digits})"
    )


def weighted_mean(weight: Column, value: Column) -> Column:
    """Aggregate: sum(w*v)/sum(w) at six decimals, weights in at most eight."""
    top = F.sum(weight.cast("decimal(10,8)") * value.cast(VALUE))
    return F.bround(
        top.cast("decimal(26,14)") / F.sum(weight.cast("decimal(10,8)")).cast("decimal(11,8)"), 6
    ).cast(VALUE)


def ratio(top: Column, bottom: Column, digits: int) -> Column:
    """Half-even quotient of two counts or decimals, NULL when the bottom is zero."""
    quotient = top.cast("decimal(20,6)") / F.nullif(bottom.cast("decimal(13,0)"), F.lit(0))
    return F.bround(quotient, digits)


def percent_change(now: Column, then: Column, digits: int) -> Column:
    """(now - then) / then * 100 of index values; NULL when ``then`` is zero.

    The ratio is taken in units of the last published digit so that the decimal
    quotient keeps at least twelve exact places.
    """
    n, t = now.cast(VALUE), then.cast(VALUE)
    quotient = ((n - t) * F.lit(100)).cast("decimal(17,6)") / F.nullif(t, F.lit(0).cast(VALUE))
    return F.bround(quotient, digits)


def half_even_quotient(top: Column, bottom: Column) -> Column:
    """Half-even integer quotient of two non-negative whole numbers."""
    whole = F.call_function("div", top, bottom)
    rest = (top % bottom) * 2
    up = (rest > bottom) | ((rest == bottom) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)
