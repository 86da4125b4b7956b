"""The aggregates and projections shown on the boards."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.display import monthly_price_text, percent_text
from ..functions.rounding import half_up, percent
from ..operators.median import global_median
from ..operators.shares import listed_shares
from .marts import comparable_price


def entity_board(mart: DataFrame) -> DataFrame:
    """Eighteen columns of the entity mart and the entry price where comparable."""
    return mart.select(
        "entity_id", "name", "category_slug", "category_name",
        "overall_rating", "g2_rating", "capterra_rating", "founded_year",
        "hq_location", "has_free_tier", "has_free_trial", "has_custom_pricing",
        "price_comparable", "entry_price", "max_price_monthly", "plan_count",
        "feature_count", "website_url",
        comparable_price().alias("entry_price_comparable"),
    )


def offer_board(offers: DataFrame) -> DataFrame:
    return offers.select(
        "offer_id", "product_name", "plan_name", "price_monthly", "price_annual", "billing_model"
    )


def category_board(mart: DataFrame) -> DataFrame:
    """Counts and means per category name, sorted by name; a mean of nothing is NULL."""
    return (
        mart.dropna(subset=["category_name"])
        .groupBy("category_name")
        .agg(
            F.count("*").alias("product_count"),
            half_up(F.avg("overall_rating"), 2).alias("avg_rating"),
            half_up(F.avg(comparable_price()), 2).alias("avg_entry_price"),
            F.count_if("has_free_tier").alias("free_tier_count"),
            half_up(percent(F.count_if("has_free_tier"), F.count("*")), 1).alias("free_tier_pct"),
            half_up(F.avg("feature_count"), 2).alias("avg_feature_count"),
        )
        .orderBy("category_name")
    )


def billing_board(offers: DataFrame, models: tuple[str, ...] = fixed.BILLING_MODELS) -> DataFrame:
    """billing_model, plan_count, pct_of_plans for the listed models, in their order."""
    return listed_shares(offers, "billing_model", models).select(
        "billing_model", F.col("count").alias("plan_count"), F.col("pct").alias("pct_of_plans")
    )


def kpi_board(mart: DataFrame) -> DataFrame:
    """One row: entities, categories, median entry price and free share, with display texts.

    Categories are counted from one row per category, not by a distinct count over entities.
    """
    median = global_median(mart.withColumn("price", comparable_price()), "price").scalar()
    return (
        mart.groupBy("category_name")
        .agg(F.count("name").alias("named"), F.count_if("has_free_tier").alias("free"))
        .agg(
            F.coalesce(F.sum("named"), F.lit(0)).alias("total_products"),
            F.count("category_name").alias("categories"),
            half_up(percent(F.sum("free"), F.sum("named")), 1).alias("free_tier_pct"),
        )
        .withColumn("median_entry_price", half_up(median, 2))
        .select(
            "total_products",
            "categories",
            "median_entry_price",
            "free_tier_pct",
            monthly_price_text(F.col("median_entry_price")).alias("median_entry_price_text"),
            percent_text(F.col("free_tier_pct")).alias("free_tier_pct_text"),
        )
    )
