import pytest

from tariffscope.plans import marts
from tariffscope.sources.roles import MART_SCHEMAS

from conftest import rows_of


@pytest.fixture(scope="module")
def mart(catalogue):
    return marts.entity_mart(catalogue).cache()


def test_clean_categories(catalogue):
    cleaned = rows_of(marts.clean_categories(catalogue), "category_slug", "category_name")
    assert cleaned == [
        ("llm", "Large Models"), ("ai-image", "AI Image"), ("crm", "CRM"), ("dex", "DEX")
    ]


def test_clean_attributes_flag_is_false_for_missing(catalogue):
    flags = rows_of(marts.clean_attributes(catalogue), "feature_value", "is_true")
    assert ("by request", False) in flags and (None, False) in flags
    assert flags.count(("true", True)) == 5


def test_summaries(catalogue):
    assert set(rows_of(marts.attribute_summary(catalogue))) == {(1, 2), (2, 2), (6, 1)}
    assert set(rows_of(marts.offer_summary(catalogue))) == {
        (1, 4, True, 10.0, 10.0), (2, 1, False, 20.0, 20.0), (3, 1, True, None, None),
        (4, 2, False, 80.0, 8.0), (6, 2, False, 3.0, 2.0), (7, 1, False, 0.01, 0.01),
        (8, 1, False, 5.0, 5.0),
    }


def test_entity_mart_schema(mart, spark):
    expected = spark.createDataFrame([], MART_SCHEMAS["products_clean"])
    assert mart.dtypes == expected.dtypes


def test_entity_mart_fills_only_counts_and_flags(mart):
    columns = ("category_slug", "has_free_tier", "has_custom_pricing", "price_comparable",
               "entry_price", "plan_count", "feature_count")
    rows = {r[0]: r[1:] for r in rows_of(mart, "entity_id", *columns)}
    assert rows[5] == ("crm", False, False, True, None, None, 0)
    assert rows[7] == ("dex", True, False, False, 0.01, 1, 0)
    assert rows[8] == (None, True, False, True, 5.0, 1, 0)
    assert len(rows) == 9


def test_ordered_mart(catalogue):
    names = rows_of(marts.entity_mart(catalogue, ordered=True), "name", "entity_id")
    assert names == sorted(names)


@pytest.mark.parametrize("few", [True, False])
def test_category_summary(mart, few):
    assert rows_of(marts.category_summary(mart, few)) == [
        ("crm", "CRM", 3, 4.0, 1, 0.33, 5.0, 5.0, 33.3),
        ("ai-image", "AI Image", 2, -1.0, 2, 0.0, None, None, 100.0),
        ("llm", "Large Models", 2, 4.5, 1, 2.0, 15.0, 15.0, 50.0),
        ("dex", "DEX", 1, 4.9, 1, 0.0, None, None, 100.0),
    ]


def test_offers_enriched_keeps_every_offer(catalogue):
    enriched = marts.offers_enriched(catalogue)
    assert enriched.count() == 12
    assert rows_of(enriched.filter("offer_id = 12"), "product_name") == [("Hub",)]
