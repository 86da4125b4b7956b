"""The data-quality audit: sixteen questions about a catalogue."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.rounding import half_up, percent
from ..operators.joins import join_lookup
from ..operators.ordering import in_order
from ..operators.per_entity import entity_keys
from ..sources.catalogue import Catalogue, is_small
from ..sources.roles import ROLES


def _stacked(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_row_counts(c: Catalogue) -> DataFrame:
    """table_name, row_count for every table."""
    return _stacked(
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(ROLES[name].table).alias("table_name"), "row_count"
        )
        for name, df in c.roles.items()
    )


def category_listing(c: Catalogue) -> DataFrame:
    """Categories with their stated count, largest first."""
    return c.category.select("slug", "name", "product_count").orderBy(
        F.desc("product_count"), "slug"
    )


def count_reconcile(c: Catalogue) -> DataFrame:
    """Categories whose stated count is not the actual one, zero included."""
    actual = c.entity.groupBy("category_id").agg(F.count("entity_id").alias("actual_count"))
    return (
        c.category.join(actual, "category_id", "left")
        .select(
            "slug",
            F.col("product_count").alias("stated_count"),
            F.coalesce("actual_count", F.lit(0)).alias("actual_count"),
        )
        .filter(F.col("stated_count") != F.col("actual_count"))
    )


_RATINGS = ("g2_rating", "capterra_rating", "overall_rating")


def missing_rating(c: Catalogue) -> DataFrame:
    """Entities without an overall rating."""
    return c.entity.filter(F.col("overall_rating").isNull()).select("entity_id", "name", *_RATINGS)


def rating_out_of_range(c: Catalogue, low=fixed.RATING_RANGE[0], high=fixed.RATING_RANGE[1]) -> DataFrame:
    """Entities with any rating outside the scale; a missing rating is not outside."""
    outside = reduce(lambda a, b: a | b, (~F.col(r).between(low, high) for r in _RATINGS))
    return c.entity.filter(outside).select("entity_id", "name", *_RATINGS)


def year_outliers(c: Catalogue, first=fixed.FOUNDED_YEARS[0], last=fixed.FOUNDED_YEARS[1]) -> DataFrame:
    """Entities whose founding year is missing or implausible."""
    year = F.col("founded_year")
    return c.entity.filter(year.isNull() | (year < first) | (year > last)).select(
        "entity_id", "name", "founded_year"
    )


def custom_offers(c: Catalogue, ordered: bool = True) -> DataFrame:
    """Offers without a price, with their entity's name.

    The sort ends on the offer's id, so an entity with very many offers is still
    divided over several tasks.
    """
    offers = c.offer.filter(F.col("price_monthly").isNull()).select(
        "offer_id", "entity_id", "plan_name", "price_monthly", "billing_model"
    )
    offers = join_lookup(offers, c.entity.select("entity_id", "name"), "entity_id")
    return in_order(offers, ordered, "name", "offer_id").select(
        "name", "plan_name", "price_monthly", "billing_model"
    )


def custom_share(c: Catalogue) -> DataFrame:
    """One row: the percentage of offers without a price."""
    custom = F.count_if(F.col("price_monthly").isNull())
    return c.offer.agg(half_up(percent(custom, F.count("*")), 1).alias("pct_custom_pricing"))


def duplicate_keys(rows: DataFrame, key: str = "slug") -> DataFrame:
    """Values of a column meant to be unique that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def duplicate_slugs(c: Catalogue) -> DataFrame:
    """Entity slugs that occur more than once."""
    return duplicate_keys(c.entity)


def entities_without_offers(c: Catalogue) -> DataFrame:
    return c.entity.select("entity_id", "name").join(
        entity_keys(c.offer), "entity_id", "left_anti"
    )


def entities_without_attributes(c: Catalogue) -> DataFrame:
    return c.entity.select("entity_id", "name").join(
        entity_keys(c.attribute), "entity_id", "left_anti"
    )


def unit_mismatch_probe(
    c: Catalogue, slug: str = fixed.NOT_COMPARABLE_SLUG, limit: int = 10
) -> DataFrame:
    """The lowest positive prices in a category suspected of another unit."""
    suspect = c.category.filter(F.col("slug") == slug).select("category_id")
    entities = c.entity.select("entity_id", "name", "category_id")
    members = join_lookup(entities, suspect, "category_id", small=c.category_is_small)
    paid_offers = c.offer.filter(F.col("price_monthly") > 0)
    return (
        join_lookup(paid_offers, members, "entity_id", small=is_small(entities))
        .orderBy("price_monthly", "offer_id")
        .limit(limit)
        .select("name", "plan_name", "price_monthly", "billing_model")
    )


def placeholder_profile(rows: DataFrame, column: str) -> DataFrame:
    """Least, greatest and mean value: all equal means the column is not filled in."""
    return rows.agg(
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
        half_up(F.avg(column), 6).alias("avg_value"),
    )


def review_count_profile(c: Catalogue) -> DataFrame:
    """Is the review count filled in?"""
    return placeholder_profile(c.entity, "review_count")


def umbrella_rollup(
    c: Catalogue,
    prefix: str = fixed.ROLLUP_PREFIX,
    slugs: tuple[str, ...] = fixed.ROLLUP_SLUGS,
) -> DataFrame:
    """One row: entities in the categories an umbrella stands for (0 if there are none).

    The prefix is matched in any letter case, the single slugs exactly.
    """
    slug = F.col("slug")
    chosen = F.lower(slug).startswith(prefix.lower()) | slug.isin(*slugs)
    members = c.entity.groupBy("category_id").agg(F.count("*").alias("members"))
    return (
        members.join(c.per_category(c.category.filter(chosen).select("category_id")), "category_id")
        .agg(F.coalesce(F.sum("members"), F.lit(0)).alias("subcategory_total"))
    )


def value_variants(c: Catalogue) -> DataFrame:
    """Every spelling of an attribute value, and how often it occurs."""
    return (
        c.attribute.groupBy("feature_value")
        .agg(F.count("*").alias("row_count"))
        .withColumn("lowered", F.lower("feature_value"))
    )


def mart_counters(marts: dict[str, DataFrame]) -> DataFrame:
    """counter, value: rows of each mart, entities without rating or with a custom price."""

    def counters(df: DataFrame, **values) -> DataFrame:
        one_row = df.agg(*(v.cast("bigint").alias(name) for name, v in values.items()))
        return one_row.unpivot([], list(values), "counter", "value")

    return _stacked(
        [
            counters(
                marts["products_clean"],
                products_clean_rows=F.count("*"),
                missing_rating=F.count_if(F.col("overall_rating").isNull()),
                with_custom_price=F.count_if("has_custom_pricing"),
            ),
            *(
                counters(marts[name], **{f"{name}_rows": F.count("*")})
                for name in ("category_summary", "pricing_plans_clean", "features_clean")
            ),
        ]
    )
