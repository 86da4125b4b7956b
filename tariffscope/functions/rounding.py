"""Rounding and ratios.

A mean such as 2.675 is stored as a double slightly below or above the tie,
so rounding the double itself depends on the order in which it was summed.
Going through a decimal with ten places first makes the tie exact.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


# From here on a double has no decimals left to round.
WHOLE_FROM = 1e17


def _rounded(x: Column, round_decimal) -> Column:
    """``x`` rounded from ten places; NULL where it is not a number, as a mean of nothing is."""
    number = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    decimal = F.when(F.abs(number) < WHOLE_FROM, number).cast("decimal(28,10)")
    return F.when(F.abs(number) < WHOLE_FROM, round_decimal(decimal).cast("double")).otherwise(number)


def half_up(x: Column, places: int) -> Column:
    """Round half away from zero (SQL and spreadsheet ROUND)."""
    return _rounded(x, lambda decimal: F.round(decimal, places))


def half_even(x: Column, places: int) -> Column:
    """Round half to the even neighbour (pandas ``round``)."""
    return _rounded(x, lambda decimal: F.bround(decimal, places))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as a double; NULL where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as a double; NULL where ``whole`` is zero."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))
