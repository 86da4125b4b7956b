"""The three named views."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import is_set
from ..functions.rounding import half_up, percent, ratio
from ..operators.joins import join_lookup
from ..operators.ordering import in_order
from ..operators.per_entity import entry_prices, entry_prices_with_ties
from ..sources.catalogue import Catalogue, is_small


def category_stats(c: Catalogue, dedupe: bool = False) -> DataFrame:
    """Stated count, mean rating, mean starting price and free share per category.

    An entity with several offers tied at its lowest price counts once per such offer;
    ``dedupe`` counts it once.  The ties are carried as a weight, so no rows are multiplied.
    """
    prices = entry_prices(c.offer) if dedupe else entry_prices_with_ties(c.offer)
    times = F.lit(1) if dedupe else F.coalesce("ties", F.lit(1))
    rating, price = F.col("overall_rating"), F.col("entry_price")
    groups = (
        c.entity.select("entity_id", "category_id", "overall_rating", "has_free_tier")
        .join(prices, "entity_id", "left")
        .withColumn("times", times)
        .groupBy("category_id")
        .agg(
            F.sum("times").alias("rows"),
            F.sum(F.when(is_set(F.col("has_free_tier")), F.col("times")).otherwise(0)).alias("free"),
            ratio(
                F.sum(F.col("times") * rating), F.sum(F.when(rating.isNotNull(), F.col("times")))
            ).alias("avg_rating"),
            ratio(
                F.sum(F.col("times") * price), F.sum(F.when(price.isNotNull(), F.col("times")))
            ).alias("avg_starting_price"),
        )
    )
    return c.categories.join(groups, "category_id").select(
        "name",
        "slug",
        "product_count",
        half_up(F.col("avg_rating"), 2).alias("avg_rating"),
        half_up(F.col("avg_starting_price"), 2).alias("avg_starting_price"),
        half_up(percent(F.col("free"), F.col("rows")), 1).alias("free_tier_pct"),
    )


def category_offers(c: Catalogue, slug: str = "llm", ordered: bool = True) -> DataFrame:
    """All offers of one category by price, those without a price first."""
    chosen = c.category.filter(F.col("slug") == slug).select("category_id")
    entities = c.entity.select(
        "entity_id", "category_id", "name", "slug", "overall_rating", "has_free_tier"
    )
    members = join_lookup(entities, chosen, "category_id", small=c.category_is_small)
    offers = join_lookup(
        c.offer.select("offer_id", "entity_id", "plan_name", "price_monthly", "billing_model"),
        members,
        "entity_id",
        small=is_small(entities),
    )
    return in_order(offers, ordered, F.asc_nulls_first("price_monthly"), "offer_id").select(
        "name", "slug", "overall_rating", "has_free_tier",
        "plan_name", "price_monthly", "billing_model",
    )


def free_entities(c: Catalogue, ordered: bool = True) -> DataFrame:
    """Entities with a free tier by rating, unrated ones last."""
    names = c.category.select("category_id", F.col("name").alias("category"))
    free = c.entity.filter(is_set(F.col("has_free_tier")))
    free = join_lookup(free, names, "category_id", small=c.category_is_small)
    return in_order(free, ordered, F.desc_nulls_last("overall_rating"), "entity_id").select(
        "name", "slug", "category", "overall_rating", "detail_url"
    )


def register_views(c: Catalogue, category_slug: str = "llm") -> None:
    """Make the three views available to ``spark.sql``."""
    category_stats(c).createOrReplaceTempView("v_category_stats")
    category_offers(c, category_slug).createOrReplaceTempView(
        f"v_{category_slug.replace('-', '_')}_comparison"
    )
    free_entities(c).createOrReplaceTempView("v_free_tier_products")
