"""The market in one flat file, and benchmarks by category, vertical and over all.

``verticals`` (category_slug, vertical) says which part of the market a category belongs to; a category
it does not name has no vertical.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even, percent
from ..operators.joins import join_lookup
from ..operators.median import exact_medians
from ..sources.catalogue import Catalogue
from .marts import clean_categories

# Levels by their grouping id: a bit for each of vertical and category that is not grouped by.
LEVELS = {0: "category", 1: "vertical", 3: "all"}


def market_export(mart: DataFrame, verticals: DataFrame, few_categories: bool = False) -> DataFrame:
    """The entity mart as the flat market file: one row an entity, blanks for what is missing.

    Prices are blank where they can't be compared.
    """
    comparable = F.col("price_comparable")
    return join_lookup(mart, verticals, "category_slug", "left", few_categories or None).select(
        F.col("name").alias("tool_name"),
        F.col("category_slug").alias("category"),
        "vertical",
        F.col("has_free_tier").alias("free_plan"),
        F.when(comparable, F.col("entry_price")).alias("starting_price_usd"),
        F.when(comparable, F.col("max_price_monthly")).alias("highest_plan_price_usd"),
        F.coalesce("plan_count", F.lit(0)).cast("int").alias("plan_count"),
        F.col("overall_rating").alias("rating"),
        F.col("feature_count").cast("int").alias("features_count"),
        F.col("website_url").alias("website"),
    )


def _levels() -> list[tuple[int, bool, bool]]:
    """(grouping id, by vertical, by category)."""
    return [(level, not level & 2, not level & 1) for level in LEVELS]


def _key(level: int, by_vertical: bool, by_category: bool):
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(level).alias("grouping_id"),
        (F.col("vertical") if by_vertical else nothing).alias("vertical"),
        (F.col("category") if by_category else nothing).alias("category"),
    )


def benchmark_by_vertical(c: Catalogue, verticals: DataFrame, **cleaning) -> DataFrame:
    """Entities, mean rating, exact median price of paid offers and share with a free tier, per category, vertical and over all.

    Each entity and each offer is read once for all three levels; what a task has of a level is combined before it is
    shuffled.  Entities without a category count nowhere.  ``grouping_id`` tells a row over all verticals from one
    of categories without a vertical.  Means and percentages are rounded half to even.
    """
    few = c.category_is_small
    categories = clean_categories(c, **cleaning).select("category_id", F.col("category_slug").alias("category"))
    named = verticals.select(F.col("category_slug").alias("category"), "vertical")
    placed = categories.join(F.broadcast(named) if few else named, "category", "left")
    entities = join_lookup(c.entity.filter(F.col("category_id").isNotNull()), placed, "category_id", small=few)

    rows = entities.select("vertical", "category", "overall_rating", F.col("has_free_tier").alias("free"))
    sets = [[n for n, used in (("vertical", v), ("category", k)) if used] for _, v, k in _levels()]
    counts = (
        rows.groupingSets(sets, "vertical", "category")
        .agg(
            F.grouping_id().cast("int").alias("grouping_id"),
            F.count("*").alias("tool_count"),
            half_even(F.avg("overall_rating"), 2).alias("avg_rating"),
            half_even(percent(F.count_if("free"), F.count("*")), 0).cast("int").alias("free_plan_pct"),
        )
        .withColumn("key", F.struct("grouping_id", "vertical", "category"))
    )
    paid = c.offer.filter(F.col("price_monthly") > 0).select("entity_id", "price_monthly")
    priced = join_lookup(paid, entities.select("entity_id", "vertical", "category"), "entity_id")
    at_each_level = priced.select(F.explode(F.array(*(_key(*level) for level in _levels()))).alias("key"), "price_monthly")
    medians = exact_medians(at_each_level, "key", "price_monthly", few)
    medians = F.broadcast(medians) if few else medians
    level = F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("grouping_id"))
    return (
        counts.join(medians, "key", "left")
        .select(
            level.alias("level"),
            "grouping_id",
            "vertical",
            "category",
            "tool_count",
            "avg_rating",
            half_even(F.col("median"), 2).alias("median_price"),
            "free_plan_pct",
        )
        .orderBy("grouping_id", "vertical", "category")
    )
