"""Number-to-text formatting as Column expressions (report and card text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: currency label used in every report text.
CURRENCY = "GBP"


def stable(col: Column) -> Column:
    """The value without the noise of a few units in the last place that the order
    of summation leaves: nine decimals, far below any digit that is printed."""
    return F.round(col.cast("double"), 9)


def thousands(col: Column) -> Column:
    """Python ``f"{x:,.0f}"`` (DecimalFormat rounds the exact binary value
    half-even, as Python does)."""
    return F.format_number(stable(col), 0)


def fixed(col: Column, digits: int) -> Column:
    """Python ``f"{x:.<digits>f}"``: rounded from the exact binary value, ties
    to even. ``format_number`` (DecimalFormat, HALF_EVEN on the exact value)
    rounds like Python; Java's ``%.2f`` does not (50.315 -> 50.32), so the
    grouping commas of ``format_number`` are removed instead."""
    return F.regexp_replace(F.format_number(stable(col), digits), ",", "")


def percent(col: Column, digits: int = 2) -> Column:
    """Python ``f"{x:.2%}"``."""
    return F.concat(fixed(col.cast("double") * F.lit(100.0), digits), F.lit("%"))


def currency(col: Column) -> Column:
    """``GBP 1,235``."""
    return F.concat(F.lit(CURRENCY + " "), thousands(col))


def compact_currency(col: Column) -> Column:
    """``GBP 1.23M`` from one million, ``GBP 12.3K`` from one thousand, else
    ``GBP 999`` (absolute value decides, the sign is kept)."""
    v = col.cast("double")
    return (F.when(F.abs(v) >= 1_000_000, F.concat(F.lit(CURRENCY + " "), fixed(v / 1_000_000, 2), F.lit("M")))
             .when(F.abs(v) >= 1_000, F.concat(F.lit(CURRENCY + " "), fixed(v / 1_000, 1), F.lit("K")))
             .otherwise(currency(v)))
