"""The twelve business questions.

Where a question groups by category, rows are grouped by the category's id first
and the category table is joined to the few groups, not to the rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.flags import is_set, is_true_text
from ..functions.rounding import half_up, percent, ratio
from ..operators.joins import join_lookup
from ..operators.ordering import in_order
from ..operators.per_entity import entry_prices, true_attribute_counts
from ..sources.catalogue import Catalogue


def _named(c: Catalogue, groups: DataFrame) -> DataFrame:
    """Groups keyed by category_id, joined to the category's row."""
    return c.categories.join(groups, "category_id")


def entry_price_by_category(
    c: Catalogue, exclude: tuple[str, ...] = (fixed.NOT_COMPARABLE_SLUG,)
) -> DataFrame:
    """Entry prices per category, over entities with a paid offer only."""
    price = F.col("entry_price")
    groups = (
        c.entity.select("entity_id", "category_id")
        .join(entry_prices(c.offer), "entity_id")
        .groupBy("category_id")
        .agg(
            F.count("*").alias("product_count"),
            half_up(F.avg(price), 2).alias("avg_entry_price"),
            half_up(F.min(price), 2).alias("min_entry_price"),
            half_up(F.max(price), 2).alias("max_entry_price"),
        )
    )
    return (
        c.categories.filter(~F.col("slug").isin(*exclude))
        .select("category_id", F.col("name").alias("category"))
        .join(groups, "category_id")
        .orderBy(F.desc("avg_entry_price"), "category_id")
        .drop("category_id")
    )


def free_tier_share(c: Catalogue) -> DataFrame:
    """Entities with a free tier per category."""
    groups = c.entity.groupBy("category_id").agg(
        F.count("*").alias("entities"),
        F.count_if(is_set(F.col("has_free_tier"))).alias("free_tier_count"),
    )
    return (
        _named(c, groups)
        .select(
            "category_id",
            F.col("name").alias("category"),
            F.col("entities").alias("product_count"),
            "free_tier_count",
            half_up(percent(F.col("free_tier_count"), F.col("entities")), 1).alias("free_tier_pct"),
        )
        .orderBy(F.desc("free_tier_pct"), "category_id")
        .drop("category_id")
    )


def billing_model_mix(c: Catalogue) -> DataFrame:
    """Priced offers and their mean price per billing model; free offers count."""
    return (
        c.offer.filter(F.col("price_monthly").isNotNull())
        .groupBy("billing_model")
        .agg(
            F.count("*").alias("plan_count"),
            half_up(F.avg("price_monthly"), 2).alias("avg_price_monthly"),
        )
        .orderBy(F.desc("plan_count"), "billing_model")
    )


def _with_category(c: Catalogue, rows: DataFrame) -> DataFrame:
    """Entity rows with their category's name; rows without a category drop out."""
    names = c.category.select("category_id", F.col("name").alias("category"))
    return join_lookup(rows, names, "category_id", small=c.category_is_small)


def top_rated(c: Catalogue, limit: int = 10) -> DataFrame:
    """The best-rated entities."""
    rated = c.entity.filter(F.col("overall_rating").isNotNull())
    return (
        _with_category(c, rated)
        .orderBy(F.desc("overall_rating"), F.desc("review_count"), "entity_id")
        .limit(limit)
        .select(
            "name", "category", "overall_rating", "g2_rating", "capterra_rating", "review_count"
        )
    )


def category_leaders(c: Catalogue, ordered: bool = True) -> DataFrame:
    """All entities that share the best rating of their category.

    The best ratings are joined back to the rows, so that the leaders of a category,
    which may be many, are never brought together in one task as by a window.
    """
    rated = c.entity.filter(F.col("overall_rating").isNotNull()).select(
        "entity_id", "category_id", "name", "overall_rating"
    )
    best = rated.groupBy("category_id").agg(F.max("overall_rating").alias("best_rating"))
    # Entities may name categories that the category table lacks, so its size says nothing here.
    leaders = join_lookup(rated, best, "category_id").filter(
        F.col("overall_rating") == F.col("best_rating")
    )
    leaders = _with_category(c, leaders.drop("best_rating"))
    return in_order(leaders, ordered, F.desc("overall_rating"), "entity_id").select(
        "category", F.col("name").alias("top_product"), "overall_rating"
    )


def attributes_vs_price(c: Catalogue, ordered: bool = True) -> DataFrame:
    """True-attribute count and entry price of each entity that has both."""
    both = (
        true_attribute_counts(c.attribute)
        .join(entry_prices(c.offer), "entity_id")
        .join(c.entity.select("entity_id", "name"), "entity_id")
    )
    return in_order(both, ordered, F.desc("feature_count"), "entity_id").select(
        "name", "feature_count", "entry_price"
    )


def best_free(
    c: Catalogue, limit: int = 15, min_stated: int = fixed.MIN_ENTITIES_PER_CATEGORY
) -> DataFrame:
    """The best-rated free entities, in categories stating a minimum count."""
    free = c.entity.filter(is_set(F.col("has_free_tier")) & F.col("overall_rating").isNotNull())
    large = c.category.filter(F.col("product_count") >= min_stated)
    names = large.select("category_id", F.col("name").alias("category"))
    return (
        join_lookup(free, names, "category_id", small=c.category_is_small)
        .orderBy(F.desc("overall_rating"), F.desc("review_count"), "entity_id")
        .limit(limit)
        .select("name", "category", "overall_rating", "review_count")
    )


def custom_price_by_category(
    c: Catalogue, min_offers: int = fixed.MIN_OFFERS_PER_CATEGORY
) -> DataFrame:
    """Offers without a price per category, for categories with enough offers."""
    per_entity = c.offer.groupBy("entity_id").agg(
        F.count("offer_id").alias("offers"),
        F.count_if(F.col("price_monthly").isNull()).alias("custom"),
    )
    groups = (
        c.entity.select("entity_id", "category_id")
        .join(per_entity, "entity_id")
        .groupBy("category_id")
        .agg(
            F.sum("offers").alias("total_plans"),
            F.sum("custom").alias("custom_price_plans"),
        )
        .filter(F.col("total_plans") >= min_offers)
    )
    return (
        _named(c, groups)
        .select(
            "category_id",
            F.col("name").alias("category"),
            "total_plans",
            "custom_price_plans",
            half_up(percent(F.col("custom_price_plans"), F.col("total_plans")), 1).alias(
                "custom_price_pct"
            ),
        )
        .orderBy(F.desc("custom_price_pct"), "category_id")
        .drop("category_id")
    )


def age_cohort(c: Catalogue, years: int = fixed.COHORT_YEARS) -> DataFrame:
    """Mean rating and entry price by founding period; unpaid entities count."""
    return (
        c.entity.filter(F.col("founded_year").isNotNull())
        .select("entity_id", "founded_year", "overall_rating")
        .join(entry_prices(c.offer), "entity_id", "left")
        .groupBy(F.expr(f"(founded_year div {years}) * {years}").alias("founded_period_start"))
        .agg(
            F.count("*").alias("product_count"),
            half_up(F.avg("overall_rating"), 2).alias("avg_rating"),
            half_up(F.avg("entry_price"), 2).alias("avg_entry_price"),
        )
        .orderBy("founded_period_start")
    )


def attribute_group_price(c: Catalogue, weight: str = "attribute") -> DataFrame:
    """Adopters of each attribute group and their mean entry price.

    ``weight="attribute"`` counts an adopter's price once per true attribute it has in
    the group; ``weight="entity"`` counts it once.
    """
    if weight not in ("attribute", "entity"):
        raise ValueError(f"unknown weight {weight!r}")
    times = F.col("attributes") if weight == "attribute" else F.lit(1)
    adopters = (
        c.attribute.filter(is_true_text(F.col("feature_value")))
        .groupBy("category", "entity_id")
        .agg(F.count("*").alias("attributes"))
    )
    return (
        adopters.join(entry_prices(c.offer), "entity_id")
        .groupBy(F.col("category").alias("feature_category"))
        .agg(
            F.count("*").alias("product_count"),
            half_up(ratio(F.sum(times * F.col("entry_price")), F.sum(times)), 2).alias(
                "avg_entry_price_of_adopters"
            ),
        )
        .orderBy(F.desc("avg_entry_price_of_adopters"), "feature_category")
    )


def common_attributes(c: Catalogue, limit: int = 15) -> DataFrame:
    """The attributes most often true."""
    return (
        c.attribute.filter(is_true_text(F.col("feature_value")))
        .groupBy("feature_name", "category")
        .agg(F.count("*").alias("product_count"))
        .orderBy(F.desc("product_count"), "feature_name", "category")
        .limit(limit)
    )


def value_score(c: Catalogue, limit: int = 15) -> DataFrame:
    """Rating per unit of entry price, ranked by the rounded score."""
    rated = c.entity.filter(F.col("overall_rating").isNotNull()).select(
        "entity_id", "category_id", "name", "overall_rating"
    )
    score = half_up(ratio(F.col("overall_rating"), F.col("entry_price")), 3)
    return (
        _with_category(c, rated.join(entry_prices(c.offer), "entity_id"))
        .select(
            "entity_id", "name", "category", "overall_rating", "entry_price",
            score.alias("value_score"),
        )
        .orderBy(F.desc("value_score"), "entity_id")
        .limit(limit)
        .drop("entity_id")
    )
