"""Medians and distinct counts from stored sketches, which new rows are merged into.

A category's or attribute group's sketch is a few kilobytes, however many rows it has seen.  When rows are added, only these are
read, sketched and merged with what is stored (``refreshed``).  Counts of distinct entities (HyperLogLog) don't
mind rows that come twice; quantiles (KLL) count them twice, so for prices a refresh must bring new entities only.
A stored sketch can't forget: after rows were changed or deleted, it is made anew.

Errors: a median's rank is within ``RANK_ERROR`` of a half, a count within ``COUNT_ERROR`` of the true one, each with
a probability above 99 percent (three standard errors for counts).  Few values are held exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import is_true_text
from ..functions.rounding import half_even, percent
from ..sources.catalogue import Catalogue
from .marts import CATEGORY, categorised

# Sizes of the sketches, and the errors that follow from them.
QUANTILE_K, COUNT_LG_K = 800, 14
RANK_ERROR = 2.296 / QUANTILE_K**0.9723
COUNT_ERROR = 3 * 1.04 / 2 ** (COUNT_LG_K / 2)

GROUP = ["feature_category"]


def _entities(where: Column | None = None) -> Column:
    entity = F.col("entity_id") if where is None else F.when(where, F.col("entity_id"))
    return F.hll_sketch_agg(entity, F.lit(COUNT_LG_K))


def category_sketches(mart: DataFrame) -> DataFrame:
    """Per category: its entities, those with an entry price, those with a free tier, and comparable entry prices."""
    return (
        categorised(mart)
        .groupBy(*CATEGORY)
        .agg(
            _entities().alias("entities"),
            _entities(F.col("entry_price").isNotNull()).alias("paid"),
            _entities(F.col("has_free_tier")).alias("free"),
            F.kll_sketch_agg_double("price", F.lit(QUANTILE_K)).alias("prices"),
        )
    )


def attribute_sketches(c: Catalogue) -> DataFrame:
    """Per attribute group: the entities with a true attribute in it."""
    true = c.attribute.filter(is_true_text(F.col("feature_value")))
    return true.groupBy(F.col("category").alias("feature_category")).agg(_entities().alias("adopters"))


def refreshed(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Sketches of both: rows of one category or group are merged."""
    keys = [c for c, kind in stored.dtypes if kind != "binary"]
    merged = {
        c: F.kll_merge_agg_double(c) if c == "prices" else F.hll_union_agg(c)
        for c, kind in stored.dtypes
        if kind == "binary"
    }
    return stored.unionByName(new).groupBy(*keys).agg(*(sketch.alias(c) for c, sketch in merged.items()))


def _middle(prices: Column) -> Column:
    """The estimated median; NULL where there is no price."""
    has_any = F.kll_sketch_get_n_double(prices) > 0
    return F.when(has_any, F.kll_sketch_get_quantile_double(prices, F.lit(0.5)))


def estimated_medians(sketches: DataFrame) -> DataFrame:
    """category_slug, median: for ``marts.category_summary``, in place of exact medians."""
    return sketches.select("category_slug", _middle(F.col("prices")).alias("median"))


def category_estimates(sketches: DataFrame) -> DataFrame:
    """Estimated counts, free-tier share and median entry price per category, without reading any entity."""
    count = F.hll_sketch_estimate
    return sketches.select(
        *CATEGORY,
        count("entities").alias("product_count"),
        count("paid").alias("paid_count"),
        count("free").alias("free_tier_count"),
        half_even(percent(count("free"), count("entities")), 1).alias("free_tier_pct"),
        half_even(_middle(F.col("prices")), 2).alias("median_entry_price"),
    )


def adoption_estimates(sketches: DataFrame) -> DataFrame:
    """Estimated adopters per attribute group."""
    return sketches.select(*GROUP, F.hll_sketch_estimate("adopters").alias("product_count"))


def median_errors(mart: DataFrame, sketches: DataFrame) -> DataFrame:
    """How far in rank each category's estimated median is from the middle, counted over all its prices.

    ``rank_error`` is the share of prices between the two; 0 where the estimate is a value that the middle falls on.
    """
    prices = categorised(mart).filter(F.col("price").isNotNull()).select("category_slug", "price")
    ranks = (
        prices.join(estimated_medians(sketches), "category_slug")
        .groupBy("category_slug")
        .agg(
            F.count("*").alias("prices"),
            F.count_if(F.col("price") < F.col("median")).alias("below"),
            F.count_if(F.col("price") <= F.col("median")).alias("up_to"),
        )
    )
    half = F.lit(0.5)
    error = F.greatest(F.col("below") / F.col("prices") - half, half - F.col("up_to") / F.col("prices"), F.lit(0.0))
    return ranks.select("category_slug", "prices", error.alias("rank_error"))


def count_errors(mart: DataFrame, sketches: DataFrame) -> DataFrame:
    """Estimated and exact numbers of entities per category."""
    exact = categorised(mart).groupBy("category_slug").agg(F.count_distinct("entity_id").alias("exact"))
    estimated = category_estimates(sketches).select("category_slug", F.col("product_count").alias("estimate"))
    error = F.abs(F.col("estimate") - F.col("exact")) / F.col("exact")
    return exact.join(estimated, "category_slug").select("category_slug", "exact", "estimate", error.alias("error"))
