"""Statistics over the marts.  Each is one small aggregate of the entity mart."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.rounding import half_up, percent, ratio
from ..functions.significance import f_upper, t_two_sided
from ..operators.histogram import equal_width_histogram
from ..operators.median import global_median
from ..operators.shares import value_shares
from .marts import comparable_price


def _comparable(mart: DataFrame) -> DataFrame:
    return mart.filter("price_comparable")


def _paired(mart: DataFrame) -> DataFrame:
    """Comparable entities with both a rating and a positive entry price."""
    return (
        _comparable(mart)
        .dropna(subset=["overall_rating", "entry_price"])
        .filter(F.col("entry_price") > 0)
    )


def median_entry_price(mart: DataFrame) -> DataFrame:
    """One row: the exact median entry price of comparable entities."""
    return global_median(_comparable(mart), "entry_price").select(
        F.col("median").alias("median_entry_price")
    )


def free_share(mart: DataFrame) -> DataFrame:
    """One row: the percentage of entities with a free tier."""
    return mart.agg(
        half_up(percent(F.count_if("has_free_tier"), F.count("*")), 1).alias("free_tier_pct")
    )


def _correlation(rows: DataFrame, x: str, y: str, alpha: float) -> DataFrame:
    """n, r, t, p and the flag p < alpha for Pearson's correlation of two columns."""
    r, n = F.col("r"), F.col("n")
    # Not F.corr, which fails where a column is constant.
    correlation = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    correlation = F.when(F.abs(correlation) > 1, F.signum(correlation)).otherwise(correlation)  # by its last digit
    perfect, two = (F.abs(r) == 1) & (F.col("df") > 0), F.col("n") == 2
    t = F.when(perfect, F.signum(r) * F.lit(float("inf"))).otherwise(r * F.sqrt(ratio(F.col("df"), 1 - r * r)))
    test = (
        rows.agg(F.count("*").alias("n"), correlation.alias("r"))
        .withColumn("df", n - 2)
        .withColumn("t", t)
        .withColumn("p", t_two_sided("t", "df"))
        # A perfect line through more than two points is certain; two points always lie on one.
        .withColumn("p", F.when(r.isNull(), None).when(perfect, 0.0).when(two, 1.0).otherwise(F.col("p")))
    )
    return test.select("n", "r", "t", "p", (F.col("p") < alpha).alias("significant"))


def price_rating_correlation(mart: DataFrame, alpha: float = fixed.ALPHA) -> DataFrame:
    """Does a higher entry price go with a higher rating?"""
    return _correlation(_paired(mart), "entry_price", "overall_rating", alpha)


def attribute_price_correlation(mart: DataFrame, alpha: float = fixed.ALPHA) -> DataFrame:
    """Do more attributes go with a higher entry price?  (Rated entities only.)"""
    return _correlation(_paired(mart), "feature_count", "entry_price", alpha)


def rating_anova(
    mart: DataFrame, min_rated: int = fixed.MIN_RATED_PER_GROUP, alpha: float = fixed.ALPHA
) -> DataFrame:
    """Does the mean rating differ between categories?  One-way analysis of variance.

    Rows are reduced to size, mean and variance per category, and these to one row.
    """
    groups = (
        mart.dropna(subset=["category_slug", "overall_rating"])
        .groupBy("category_slug")
        .agg(
            F.count("*").alias("n"),
            F.avg("overall_rating").alias("mean"),
            F.var_samp("overall_rating").alias("variance"),
        )
        .filter(F.col("n") >= min_rated)
    )
    grand_mean = groups.select(ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    deviation = F.col("mean") - grand_mean
    squares = (
        groups.withColumn("between", F.col("n") * deviation * deviation)
        .agg(
            F.count("*").alias("groups"),
            F.sum("n").alias("n"),
            F.sum("between").alias("between"),
            F.sum((F.col("n") - 1) * F.col("variance")).alias("within"),
        )
        .withColumn("df_between", F.col("groups") - 1)
        .withColumn("df_within", F.col("n") - F.col("groups"))
    )
    # Means that differ while no category varies within itself: certain.
    certain = (F.col("within") == 0) & (F.col("between") > 0) & (F.col("df_within") > 0)
    f = ratio(
        ratio(F.col("between"), F.col("df_between")), ratio(F.col("within"), F.col("df_within"))
    )
    test = squares.withColumn("f", F.when(certain, float("inf")).otherwise(f)).withColumn(
        "p", F.when(certain, 0.0).otherwise(f_upper("f", "df_between", "df_within"))
    )
    return test.select("df_between", "df_within", "f", "p", (F.col("p") < alpha).alias("significant"))


def price_histogram(mart: DataFrame, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """bin, lo, hi, count of comparable entry prices."""
    return equal_width_histogram(_comparable(mart), "entry_price", bins)


def price_rating_line(mart: DataFrame) -> DataFrame:
    """One row: the least-squares line of rating on entry price."""
    line = {
        "slope": F.regr_slope("overall_rating", "entry_price"),
        "intercept": F.regr_intercept("overall_rating", "entry_price"),
        "r2": F.regr_r2("overall_rating", "entry_price"),
    }
    return _paired(mart).agg(*(value.alias(name) for name, value in line.items()))


def value_leaders(mart: DataFrame, limit: int = 5) -> DataFrame:
    """Comparable entities by rating per unit of entry price, not rounded."""
    score = ratio(F.col("overall_rating"), F.col("entry_price"))
    return (
        _paired(mart)
        .withColumn("value_score", score)
        .orderBy(F.desc("value_score"), "entity_id")
        .limit(limit)
        .select("name", "category_name", "overall_rating", "entry_price", "value_score")
    )


def billing_share(offers: DataFrame) -> DataFrame:
    """billing_model, plan_count, pct of all offers that have a model."""
    return value_shares(offers, "billing_model").withColumnRenamed("count", "plan_count")


def top_categories_by_price(summary: DataFrame, limit: int = 15) -> DataFrame:
    """The dearest categories to enter; those without a price come last."""
    return (
        summary.orderBy(F.desc_nulls_last("avg_entry_price"), "category_slug")
        .limit(limit)
        .select("category_slug", "category_name", "avg_entry_price")
    )


def category_extremes(summary: DataFrame) -> DataFrame:
    """finding, category_name, value: dearest, cheapest, most and least often free category.

    Of categories with the same value, the one with the fewest entities is named, and of
    these the last by slug.
    """

    def first(value: str, sign: int):
        tie_break = (-F.col("product_count"), F.col("category_slug"))
        place = F.when(F.col(value).isNotNull(), F.struct(sign * F.col(value), *tie_break))
        return F.max_by(F.struct("category_name", F.col(value).alias("value")), place)

    findings = {
        "most_expensive": first("avg_entry_price", 1),
        "cheapest": first("avg_entry_price", -1),
        "highest_free_share": first("free_tier_pct", 1),
        "lowest_free_share": first("free_tier_pct", -1),
    }
    return (
        summary.agg(*(value.alias(name) for name, value in findings.items()))
        .unpivot([], list(findings), "finding", "category")
        .select("finding", "category.category_name", "category.value")
    )
