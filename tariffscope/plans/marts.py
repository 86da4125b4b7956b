"""Cleaned tables and marts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.flags import is_comparable, is_set, is_true_text
from ..functions.rounding import half_even, percent
from ..operators import per_entity
from ..operators.joins import join_lookup
from ..operators.median import exact_medians
from ..operators.ordering import in_order
from ..sources.catalogue import Catalogue


def clean_categories(
    c: Catalogue,
    umbrella: str = fixed.UMBRELLA_SLUG,
    name_fixes: dict[str, str] = fixed.CATEGORY_NAME_FIXES,
) -> DataFrame:
    """Categories without the umbrella, with corrected names."""
    return (
        c.category.filter(F.col("slug") != umbrella)
        .replace(name_fixes, subset=["name"])
        .withColumnsRenamed({"name": "category_name", "slug": "category_slug"})
    )


def clean_attributes(c: Catalogue) -> DataFrame:
    """Attributes with lower-case values and a flag for 'true'."""
    return c.attribute.withColumn("feature_value", F.lower("feature_value")).withColumn(
        "is_true", is_true_text(F.col("feature_value"))
    )


def attribute_summary(c: Catalogue) -> DataFrame:
    return per_entity.true_attribute_counts(c.attribute)


def offer_summary(c: Catalogue) -> DataFrame:
    return per_entity.offer_summary(c.offer)


def entity_mart(
    c: Catalogue,
    offers: DataFrame | None = None,
    attributes: DataFrame | None = None,
    not_comparable: str = fixed.NOT_COMPARABLE_SLUG,
    ordered: bool = False,
    **cleaning,
) -> DataFrame:
    """One row per entity with its category, prices and counts (``products_clean``).

    ``offers`` and ``attributes`` are the two summaries where they are stored already
    (see ``build.stage_per_entity``).  Only the attribute count and the custom-price flag are
    filled where missing; ``cleaning`` goes to ``clean_categories``.  ``ordered``
    sorts by name, which a mart that is to be stored does not need.
    """
    offers = offer_summary(c) if offers is None else offers
    attributes = attribute_summary(c) if attributes is None else attributes
    categories = clean_categories(c, **cleaning).select(
        "category_id", "category_slug", "category_name"
    )
    mart = (
        join_lookup(c.entity, categories, "category_id", "left", c.category_is_small)
        .join(offers, "entity_id", "left")
        .join(attributes, "entity_id", "left")
        .select(
            "entity_id", "name", "category_slug", "category_name",
            "overall_rating", "g2_rating", "capterra_rating", "review_count",
            "founded_year", "hq_location",
            is_set(F.col("has_free_tier")).alias("has_free_tier"),
            is_set(F.col("has_free_trial")).alias("has_free_trial"),
            is_set(F.col("has_custom_pricing")).alias("has_custom_pricing"),
            is_comparable(F.col("category_slug"), not_comparable).alias("price_comparable"),
            "entry_price", "max_price_monthly", "plan_count",
            F.coalesce("feature_count", F.lit(0)).alias("feature_count"),
            "website_url", "detail_url",
        )
    )
    return in_order(mart, ordered, "name", "entity_id")


def comparable_price():
    """The entry price of a mart row where it can be compared, else NULL."""
    return F.when(F.col("price_comparable"), F.col("entry_price"))


CATEGORY = ["category_slug", "category_name"]


def categorised(mart: DataFrame) -> DataFrame:
    """Entities that have a category, with their comparable ``price``."""
    return mart.dropna(subset=CATEGORY).withColumn("price", comparable_price())


def category_means(mart: DataFrame) -> DataFrame:
    """Counts and means per category, from the entity mart: the category summary without its medians.

    Entities without a category are left out; prices count only where comparable.
    """
    free = percent(F.col("free_tier_count"), F.col("product_count"))
    return (
        categorised(mart)
        .groupBy(*CATEGORY)
        .agg(
            F.count("entity_id").alias("product_count"),
            half_even(F.avg("overall_rating"), 2).alias("avg_rating"),
            F.count_if("has_free_tier").alias("free_tier_count"),
            half_even(F.avg("feature_count"), 2).alias("avg_feature_count"),
            half_even(F.avg("price"), 2).alias("avg_entry_price"),
        )
        .withColumn("free_tier_pct", half_even(free, 1))
    )


def category_summary(
    mart: DataFrame, few_categories: bool = False, medians: DataFrame | None = None
) -> DataFrame:
    """Counts, means and the exact median entry price per category, from the entity mart.

    ``few_categories``: their number is known to be small (``Catalogue.category_is_small``).  ``medians``
    (category_slug, median) are given to take estimates from stored sketches (``estimates.estimated_medians``) instead.
    """
    if medians is None:
        medians = exact_medians(categorised(mart), "category_slug", "price", few_categories)
    medians = F.broadcast(medians) if few_categories else medians
    return (
        category_means(mart)
        .join(medians, "category_slug", "left")
        .select(
            *CATEGORY,
            "product_count",
            "avg_rating",
            "free_tier_count",
            "avg_feature_count",
            "avg_entry_price",
            half_even(F.col("median"), 2).alias("median_entry_price"),
            "free_tier_pct",
        )
        .orderBy(F.desc("product_count"), "category_slug")
    )


def offers_enriched(c: Catalogue) -> DataFrame:
    """Every offer with its entity's name (``pricing_plans_clean``)."""
    names = c.entity.select("entity_id", F.col("name").alias("product_name"))
    return join_lookup(c.offer, names, "entity_id", "left").select(
        *c.offer.columns, "product_name"
    )
