"""Equal-width histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_width_histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lo, hi, count) over the values' own range; the last bin is closed.

    Missing values and those that are not numbers are left out, empty bins are kept, and a range of
    one single value is widened by half a unit to each side, or by a billionth of a large value.
    """
    values = rows.select(F.col(value).cast("double").alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    least, most = F.min("value"), F.max("value")
    wide = F.greatest(F.lit(0.5), F.abs(least) * 1e-9)
    widened = F.when(least == most, wide).otherwise(F.lit(0.0))
    span = values.agg((least - widened).alias("lo"), (most + widened).alias("hi")).select(
        F.struct("lo", ((F.col("hi") - F.col("lo")) / bins).alias("width")).alias("span")
    )
    # Named once on each side: each use of a scalar subquery would plan it again.
    lo, width = F.col("span.lo"), F.col("span.width")
    position = F.floor((F.col("value") - lo) / width)
    counts = (
        values.withColumn("span", span.scalar())
        .select(F.least(position, F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("count"))
    )
    edges = (
        rows.sparkSession.range(bins)
        .select(F.col("id").alias("bin"), span.scalar().alias("span"))
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("lo"),
            (lo + (F.col("bin") + 1) * width).alias("hi"),
        )
    )
    return (
        edges.join(counts, "bin", "left")
        .select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("bin")
    )
