"""How rows divide over the values of a column."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even, half_up, percent


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, count, pct): each value's share of all non-missing rows, largest first."""
    counts = (
        rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(
        column, "count", half_even(percent(F.col("count"), total), 1).alias("pct")
    ).orderBy(F.desc("count"), column)


def listed_shares(rows: DataFrame, column: str, listed: tuple[str, ...]) -> DataFrame:
    """(position, column, count, pct) for the listed values only, absent ones as 0.

    The share is of the listed values' rows, so rows with other values do not count.
    """
    names = rows.sparkSession.range(1).select(
        F.posexplode(F.array(*(F.lit(v) for v in listed))).alias("position", column)
    )
    counts = (
        rows.filter(F.col(column).isin(*listed)).groupBy(column).agg(F.count("*").alias("count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    return (
        names.join(counts, column, "left")
        .select("position", column, F.coalesce("count", F.lit(0)).alias("count"))
        .withColumn("pct", half_up(percent(F.col("count"), total), 1))
        .orderBy("position")
    )
