"""All jobs by name, grouped by what they read."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.catalogue import Catalogue
from . import boards, highlights, history, marts, quality, questions, statistics, views

Plan = Callable[..., DataFrame]

# Read the catalogue's tables.
AUDIT: dict[str, Plan] = {
    "dq_table_row_counts": quality.table_row_counts,
    "category_listing": quality.category_listing,
    "dq_count_reconcile": quality.count_reconcile,
    "dq_missing_rating": quality.missing_rating,
    "dq_custom_offers": quality.custom_offers,
    "dq_custom_share": quality.custom_share,
    "dq_duplicate_keys": quality.duplicate_slugs,
    "dq_entities_without_offers": quality.entities_without_offers,
    "dq_entities_without_attributes": quality.entities_without_attributes,
    "dq_year_outliers": quality.year_outliers,
    "dq_unit_mismatch_probe": quality.unit_mismatch_probe,
    "dq_placeholder_profile": quality.review_count_profile,
    "dq_rating_out_of_range": quality.rating_out_of_range,
    "dq_umbrella_rollup": quality.umbrella_rollup,
    "dq_value_variants": quality.value_variants,
}
CLEANING: dict[str, Plan] = {
    "clean_categories": marts.clean_categories,
    "clean_attributes": marts.clean_attributes,
    "attribute_summary": marts.attribute_summary,
    "offer_summary": marts.offer_summary,
    "offers_enriched": marts.offers_enriched,
}
QUESTIONS: dict[str, Plan] = {
    "q01_entry_price_by_category": questions.entry_price_by_category,
    "q02_free_tier_share": questions.free_tier_share,
    "q03_billing_model_mix": questions.billing_model_mix,
    "q04_top_rated": questions.top_rated,
    "q05_category_leaders": questions.category_leaders,
    "q06_attributes_vs_price": questions.attributes_vs_price,
    "q07_best_free": questions.best_free,
    "q08_custom_price_by_category": questions.custom_price_by_category,
    "q09_age_cohort": questions.age_cohort,
    "q10_attribute_group_price": questions.attribute_group_price,
    "q11_common_attributes": questions.common_attributes,
    "q12_value_score": questions.value_score,
}
VIEWS: dict[str, Plan] = {
    "view_category_stats": views.category_stats,
    "view_category_offers": views.category_offers,
    "view_free_entities": views.free_entities,
}
HISTORY: dict[str, Plan] = {
    "price_changes": history.price_changes,
    "price_periods": history.price_periods,
    "price_by_month": history.price_by_month,
    "price_trends": history.price_trends,
}
HIGHLIGHTS: dict[str, Plan] = {
    "offer_highlights": highlights.offer_highlights,
    "highlight_counts": highlights.highlight_counts,
    "dq_highlight_format": highlights.highlight_formats,
}
ON_CATALOGUE = AUDIT | CLEANING | QUESTIONS | VIEWS | HISTORY | HIGHLIGHTS
# These also need to know the dates.
AT_DATES: dict[str, Plan] = {"price_on_dates": history.prices_on_dates}

# Read the entity mart.
ON_MART: dict[str, Plan] = {
    "stat_median_entry_price": statistics.median_entry_price,
    "stat_free_share": statistics.free_share,
    "stat_price_rating_corr": statistics.price_rating_correlation,
    "stat_attribute_price_corr": statistics.attribute_price_correlation,
    "stat_rating_anova": statistics.rating_anova,
    "stat_price_histogram": statistics.price_histogram,
    "stat_price_rating_line": statistics.price_rating_line,
    "value_top5": statistics.value_leaders,
    "entity_board": boards.entity_board,
    "category_board": boards.category_board,
    "kpi_board": boards.kpi_board,
}

# Read the category summary.
ON_SUMMARY: dict[str, Plan] = {
    "top_categories_by_price": statistics.top_categories_by_price,
    "category_extremes": statistics.category_extremes,
}

# Read the offers, with or without their entity's name.
ON_OFFERS: dict[str, Plan] = {
    "billing_share": statistics.billing_share,
    "billing_board": boards.billing_board,
}

# Read the offers with their entity's name.
ON_ENRICHED: dict[str, Plan] = {"offer_board": boards.offer_board}


def catalogue_results(c: Catalogue) -> dict[str, DataFrame]:
    """The audit, questions, views, price history and highlights of a catalogue, with their default parameters."""
    return {name: plan(c) for name, plan in (AUDIT | QUESTIONS | VIEWS | HISTORY | HIGHLIGHTS).items()}


def mart_results(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The statistics and boards over stored marts (see ``build.write_marts``)."""
    inputs = {
        "products_clean": ON_MART,
        "category_summary": ON_SUMMARY,
        "pricing_plans_clean": ON_OFFERS | ON_ENRICHED,
    }
    results = {
        name: plan(stored[mart]) for mart, plans in inputs.items() for name, plan in plans.items()
    }
    return results | {"dq_mart_counters": quality.mart_counters(stored)}
