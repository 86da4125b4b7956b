"""Text for boards."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def monthly_price_text(x: Column) -> Column:
    """``$16.00/mo`` for 16; NULL stays NULL."""
    return F.when(x.isNotNull(), F.format_string("$%.2f/mo", x))


def percent_text(x: Column) -> Column:
    """``74.3%`` for 74.3 and ``70%`` for 70.0."""
    return F.concat(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("%"))
