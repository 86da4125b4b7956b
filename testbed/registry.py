"""Every query, bound to the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.functions.rounding import half_up
from tariffscope.plans import estimates, jobs, market, marts, quality
from tariffscope.sources.catalogue import Catalogue
from tariffscope.session import shared_folder
from tariffscope.sources.loading import first_wins
from tariffscope.sources.readers import read_mart
from tariffscope.sources.writers import write_csv
from tariffscope.streaming.alerts import ALERT_SCHEMA, alert_stream

from . import binding as b

Query = Callable[[SparkSession, str], DataFrame]

# Parameters that name something in the test tables.
OPTIONS: dict[str, dict] = {
    "dq_unit_mismatch_probe": {"slug": b.NOT_COMPARABLE},
    "dq_umbrella_rollup": {"prefix": b.ROLLUP_PREFIX, "slugs": b.ROLLUP_SLUGS},
    "clean_categories": b.CLEANING,
    "q01_entry_price_by_category": {"exclude": (b.NOT_COMPARABLE,)},
    "view_category_offers": {"slug": b.SHOWN_CATEGORY},
    "billing_board": {"models": b.BILLING_MODELS},
    "price_on_dates": {"dates": b.REPORT_DATES},
}


def _mart(c: Catalogue) -> DataFrame:
    return marts.entity_mart(c, not_comparable=b.NOT_COMPARABLE, **b.CLEANING)


def _summary(c: Catalogue) -> DataFrame:
    return marts.category_summary(_mart(c), c.category_is_small)


def _mart_counters(c: Catalogue) -> DataFrame:
    return quality.mart_counters(
        {
            "products_clean": _mart(c),
            "category_summary": marts.category_means(_mart(c)),
            "pricing_plans_clean": marts.offers_enriched(c),
            "features_clean": marts.clean_attributes(c),
        }
    )


def _query(name: str, plan: jobs.Plan, source: Callable[[Catalogue], object]) -> Query:
    return lambda spark, sf_dir: plan(source(b.bind(spark, sf_dir)), **OPTIONS.get(name, {}))


_SOURCES = (
    (jobs.ON_CATALOGUE | jobs.AT_DATES, lambda c: c),
    ({"entity_mart": lambda mart: mart} | jobs.ON_MART, _mart),
    ({"category_summary": lambda summary: summary}, _summary),
    # These need no median, so none is made for them.
    (jobs.ON_SUMMARY, lambda c: marts.category_means(_mart(c))),
    (jobs.ON_OFFERS, lambda c: c.offer),
    (jobs.ON_ENRICHED, marts.offers_enriched),
    ({"dq_mart_counters": lambda counters: counters}, _mart_counters),
)

QUERIES: dict[str, Query] = {
    name: _query(name, plan, source) for plans, source in _SOURCES for name, plan in plans.items()
}
def _rounded(query: Query, places: int = 6) -> Query:
    """Sums of doubles depend on their order, so results are compared to so many places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = query(spark, sf_dir)
        return rows.select(
            *(half_up(F.col(c), places).alias(c) if t == "double" else c for c, t in rows.dtypes)
        )

    return run


QUERIES |= {
    name: _rounded(QUERIES[name])
    for name in (
        "stat_price_rating_corr", "stat_attribute_price_corr", "stat_rating_anova", "stat_price_rating_line",
    )
}

# Customer names are unique; part names are not.
QUERIES["dq_duplicate_keys"] = lambda spark, sf_dir: quality.duplicate_keys(
    b.part_slugs(spark, sf_dir)
)
# Loading parts into a table keyed by slug: the first part of each name stays.
QUERIES["load_first_wins"] = lambda spark, sf_dir: first_wins(
    b.part_slugs(spark, sf_dir), None, (("slug",),), ["part_id"]
)

# Loading parts that clash under two keys: a part stays if no part that stays has either key before it.
QUERIES["load_two_keys"] = lambda spark, sf_dir: first_wins(
    b.part_keys(spark, sf_dir), None, (("slug",), ("kind",)), ["part_id"]
)


def load_into_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the parts added to what was loaded of the others: stored names win."""
    parts = b.part_keys(spark, sf_dir).select("part_id", "slug")
    is_old = F.col("part_id") % 3 == 0
    stored = first_wins(parts.filter(is_old), None, (("slug",),), ["part_id"])
    return first_wins(parts.filter(~is_old), stored, (("slug",),), ["part_id"])


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity mart written as CSV and read back under its declared schema."""
    folder = shared_folder(spark, "csv")
    write_csv(_mart(b.bind(spark, sf_dir)), f"{folder}/products_clean")
    return read_mart(spark, folder, "products_clean", "csv")


QUERIES["load_into_stored"] = load_into_stored
QUERIES["csv_round_trip"] = csv_round_trip
# The market by vertical: nations by their region.
QUERIES["market_export"] = lambda spark, sf_dir: market.market_export(
    _mart(b.bind(spark, sf_dir)), b.verticals(spark, sf_dir), b.bind(spark, sf_dir).category_is_small
)
QUERIES["benchmark_by_vertical"] = lambda spark, sf_dir: market.benchmark_by_vertical(
    b.bind(spark, sf_dir), b.verticals(spark, sf_dir), **b.CLEANING
)


def _sketches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mart, and category sketches made of two halves of it and merged."""
    mart = _mart(b.bind(spark, sf_dir))
    halves = [estimates.category_sketches(mart.where(F.col("entity_id") % 2 == half)) for half in (0, 1)]
    return mart, estimates.refreshed(*halves)


def estimated_median_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each category's estimated median is as near to the middle as it should be."""
    errors = estimates.median_errors(*_sketches(spark, sf_dir))
    near = F.col("rank_error") <= estimates.RANK_ERROR + 1 / F.col("prices")
    return errors.select("category_slug", "prices", near.alias("is_near"))


def estimated_count_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each category's estimated number of entities is as near to the true one as it should be."""
    errors = estimates.count_errors(*_sketches(spark, sf_dir))
    return errors.select("category_slug", "exact", (F.col("error") <= estimates.COUNT_ERROR).alias("is_near"))


QUERIES["estimated_median_errors"] = estimated_median_errors
QUERIES["estimated_count_errors"] = estimated_count_errors


def price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price log as a stream: changes of the days that its last snapshot, less the delay, has passed."""
    folder = shared_folder(spark, "alerts")
    query = alert_stream(b.price_log_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state", b.ALERT_DELAY)
    query.awaitTermination()
    return spark.read.schema(ALERT_SCHEMA).parquet(f"{folder}/out")


QUERIES["price_alerts"] = price_alerts
