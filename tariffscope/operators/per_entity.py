"""One row per entity, from its offers or attributes.

All of these aggregate before anything is joined: partial sums are combined
inside each task, so an entity holding a large part of all rows costs no more
in the shuffle than any other.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import is_true_text, paid


def entry_prices(offer: DataFrame) -> DataFrame:
    """entity_id, entry_price: the lowest positive monthly price; unpaid entities are absent."""
    return (
        offer.filter(F.col("price_monthly") > 0)
        .groupBy("entity_id")
        .agg(F.min("price_monthly").alias("entry_price"))
    )


def entry_prices_with_ties(offer: DataFrame) -> DataFrame:
    """entity_id, entry_price, ties: how many offers carry the lowest positive price."""
    per_price = (
        offer.filter(F.col("price_monthly") > 0)
        .groupBy("entity_id", "price_monthly")
        .agg(F.count("*").alias("offers"))
    )
    return per_price.groupBy("entity_id").agg(
        F.min("price_monthly").alias("entry_price"),
        F.min_by("offers", "price_monthly").alias("ties"),
    )


def offer_summary(offer: DataFrame) -> DataFrame:
    """entity_id, plan_count, has_custom_pricing, max_price_monthly, entry_price.

    The entry price is NULL for an entity without a paid offer.
    """
    price = F.col("price_monthly")
    return offer.groupBy("entity_id").agg(
        F.count("offer_id").alias("plan_count"),
        F.bool_or(price.isNull()).alias("has_custom_pricing"),
        F.max(price).alias("max_price_monthly"),
        F.min(paid(price)).alias("entry_price"),
    )


def true_attribute_counts(attribute: DataFrame) -> DataFrame:
    """entity_id, feature_count: attributes whose value is 'true' in any letter case."""
    return (
        attribute.filter(is_true_text(F.col("feature_value")))
        .groupBy("entity_id")
        .agg(F.count("feature_name").alias("feature_count"))
    )


def entity_keys(df: DataFrame) -> DataFrame:
    """The distinct entities a table mentions, each once, for existence tests."""
    return df.select("entity_id").distinct()
