"""Exact money arithmetic.

Sums of doubles depend on the order in which tasks finish. Money is therefore carried as whole
cents (BIGINT) through every shuffle and window, and divided once at the end, so a job gives the
same bits however its input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CENTS = 100.0


def cents(amount) -> Column:
    """Money column (double or decimal) to whole cents; null stays null."""
    return F.round(F.col(amount) * 100 if isinstance(amount, str) else amount * 100).cast("bigint")


def dollars(whole_cents) -> Column:
    col = F.col(whole_cents) if isinstance(whole_cents, str) else whole_cents
    return col / F.lit(CENTS)


def ratio(numerator: Column, denominator: Column, floor: float) -> Column:
    """``numerator / max(denominator, floor)``; never divides by zero."""
    return numerator / F.greatest(denominator, F.lit(floor))


def exact_mean(total_cents: Column, n: Column) -> Column:
    """Mean in dollars of ``n`` values whose cents add up to ``total_cents``."""
    return total_cents / n / F.lit(CENTS)


def square(whole_cents: Column) -> Column:
    """Square of a cents value, wide enough not to overflow."""
    wide = whole_cents.cast("decimal(18,0)")
    return (wide * wide).cast("decimal(37,0)")


def exact_pop_std(total_cents: Column, total_squares: Column, n: Column) -> Column:
    """Population standard deviation in dollars from exact integer sums."""
    spread = n.cast("decimal(10,0)") * total_squares.cast("decimal(38,0)") - total_cents.cast(
        "decimal(19,0)"
    ) * total_cents.cast("decimal(19,0)")
    return F.sqrt(spread.cast("double")) / n / F.lit(CENTS)

