"""Boolean flags that are never NULL, and the paid-price expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true_text(value: Column) -> Column:
    """True for 'true' in any letter case; NULL and other text are False."""
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def is_set(flag: Column) -> Column:
    """A nullable boolean or 0/1 column, with NULL read as False."""
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def is_comparable(slug: Column, not_comparable: str) -> Column:
    """True unless the category is the not-comparable one; NULL slugs are comparable."""
    return ~slug.eqNullSafe(F.lit(not_comparable))


def paid(price: Column) -> Column:
    """The price where it is positive, else NULL (free and custom offers)."""
    return F.when(price > 0, price)
