"""Sorting whole results."""

from pyspark.sql import Column, DataFrame


def in_order(df: DataFrame, ordered: bool, *keys: str | Column) -> DataFrame:
    """Sort by ``keys`` if asked to.

    For results of one row per entity or offer: a total sort samples its input and
    shuffles it, which a result that is stored or aggregated further can do without.
    Keys should end on a unique column, so that equal values can be divided over tasks.
    """
    return df.orderBy(*keys) if ordered else df
