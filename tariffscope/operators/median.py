"""Exact medians by repeated narrowing: no group's values are ever sorted, or held in one task.

Values are first reduced to the distinct ones of each group with their number of rows, spread over
tasks by value, and stored.  Each level then cuts what may still hold a group's median into
buckets in value order, counts their rows (combined inside each task), and keeps the bucket in which the running
count reaches the wanted rank.  Only bucket counts are ordered, a bounded number a group:

1. buckets of equal ratio, ``STEPS`` for each factor of e: about 6 million would cover all doubles, prices
   need some ten thousand.  What stays is within a factor of 1.00025, or 2^41 neighbouring doubles.
2. ``CUTS`` buckets between the smallest and largest value that are left: 2^20 neighbours stay at most.
3. the same again: no two doubles share a bucket, so one value is left, the median.

The counts are exact at each level, so no estimate can miss, and the three levels suffice whatever the values are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

STEPS = 4096
CUTS = 1 << 22
# Above any double's place on the scale of ratios, and a logarithm above any finite one's.
_ABOVE, _BEYOND = 4_000_000, 710.0
# Tasks, at least, that a group's values meet their group's bounds in.
SALTS = 32

_GROUP, _SALT = "__group", "__salt"


def _place(value: Column) -> Column:
    """The bucket of equal ratio that a value is in, in order of values."""
    log = F.least(F.ln(F.abs(value)), F.lit(_BEYOND))
    place = F.floor(log * STEPS).cast("long") + _ABOVE
    return F.when(value > 0, place).when(value < 0, -place).otherwise(0)


def _cut(value: Column, lo: Column, hi: Column) -> Column:
    """The bucket of equal width between lo and hi that a value is in."""
    return F.when(hi > lo, F.floor((value - lo) / (hi - lo) * CUTS).cast("long")).otherwise(0)


def _reached(buckets: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """Of buckets (by, bucket, rows, ...), the one of each group that holds the rank, and the ``rank`` within it."""
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = buckets.withColumn("up_to", F.sum("rows").over(order)).withColumn("rank", rank)
    before = F.col("up_to") - F.col("rows")
    found = counted.filter((F.col("rank") > before) & (F.col("rank") <= F.col("up_to")))
    return found.withColumn("rank", F.col("rank") - before).drop("bucket", "rows", "up_to")


def _bucket_counts(values: DataFrame, by: list[str], bucket: Column, *carried: str) -> DataFrame:
    return values.groupBy(*by, bucket.alias("bucket")).agg(
        F.sum("rows").alias("rows"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        *(F.max(c).alias(c) for c in carried),
    )


def _bounded(values: DataFrame, wanted: DataFrame, few_groups: bool) -> DataFrame:
    """The values within the bounds of what is ``wanted`` (a group's lower and upper middle) of their group."""
    targets = wanted.groupBy(_GROUP).agg(F.collect_list(F.struct("which", "rank", "lo", "hi")).alias("targets"))
    if few_groups:
        met = values.join(F.broadcast(targets), _GROUP)
    else:
        spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(_SALT)
        met = values.join(targets.select("*", spread), [_GROUP, _SALT])
    near = F.filter("targets", lambda t: (F.col("value") >= t["lo"]) & (F.col("value") <= t["hi"]))
    return met.select(_GROUP, "value", "rows", F.explode(near).alias("t")).select(
        _GROUP, "value", "rows", "t.which", "t.rank", F.col("t.lo").alias("from"), F.col("t.hi").alias("to")
    )


def exact_medians(rows: DataFrame, by: str, value: str, few_groups: bool = False) -> DataFrame:
    """(by, median) of every group that has a value; a group's key may be of any type that can be grouped by.

    ``few_groups`` says that the groups are known to be few: a row each is then broadcast.  The distinct values are stored
    by ``checkpoint()``, so ``rows`` is run once, when this is called.
    """
    values = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(F.col(by).alias(_GROUP), F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("rows"))
    )
    values = checkpointed(values.withColumn(_SALT, F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")))
    all_rows = F.sum("rows").over(Window.partitionBy(_GROUP))
    middle = F.expr("explode(array(named_struct('which', 0, 'add', 1L), named_struct('which', 1, 'add', 2L)))")
    first = _bucket_counts(values, [_GROUP], _place(F.col("value"))).withColumn("n", all_rows)
    first = first.select("*", middle.alias("middle")).select("*", "middle.which", "middle.add")
    wanted = _reached(first, [_GROUP, "which"], F.expr("(n + add) div 2"))
    for _ in range(2):
        left = _bounded(values, wanted, few_groups)
        counts = _bucket_counts(left, [_GROUP, "which"], _cut(F.col("value"), F.col("from"), F.col("to")), "rank")
        wanted = _reached(counts, [_GROUP, "which"], F.col("rank"))
    found = wanted.groupBy(_GROUP).agg(
        *(F.max(F.when(F.col("which") == which, F.col("lo"))).alias(name) for which, name in enumerate(("lower", "upper")))
    )
    return found.select(F.col(_GROUP).alias(by), ((F.col("lower") + F.col("upper")) / 2).alias("median"))


def global_median(rows: DataFrame, value: str) -> DataFrame:
    """One row (median), NULL where there is no value."""
    one_group = rows.select(F.lit(1).alias("all"), value)
    return exact_medians(one_group, "all", value).agg(F.max("median").alias("median"))
