"""Sketches: their errors at a size where they do estimate, and merging stored ones with new rows."""

import pytest
from pyspark.sql import functions as F

from tariffscope.plans import estimates, marts
from tariffscope.sources.roles import MART_SCHEMAS

from conftest import rows_of

N = 120_000


@pytest.fixture(scope="module")
def mart(spark):
    """Half of all entities in one category; skewed prices, some missing."""
    key = F.col("id")
    given = spark.range(N).select(
        key.alias("entity_id"),
        F.when(key % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), key % 5)).alias("category_slug"),
        F.when(key % 7 != 0, F.exp(F.pmod(key * 7919, F.lit(100_003)) / 9000)).alias("entry_price"),
        (key % 3 == 0).alias("has_free_tier"),
        (key % 11 != 0).alias("price_comparable"),
    )
    given = given.withColumn("category_name", F.upper("category_slug"))
    types = dict(f.split() for f in MART_SCHEMAS["products_clean"].split(", "))
    rest = {c: F.lit(None).cast(t) for c, t in types.items() if c not in given.columns}
    return given.withColumns(rest).select(*types).repartition(8)


def test_errors_are_within_their_bounds(mart):
    sketches = estimates.category_sketches(mart)
    errors = rows_of(estimates.median_errors(mart, sketches))
    assert len(errors) == 6 and all(e <= estimates.RANK_ERROR for _, _, e in errors)
    assert any(e > 0 for _, _, e in errors)  # at this size it is an estimate
    counts = rows_of(estimates.count_errors(mart, sketches))
    assert all(e <= estimates.COUNT_ERROR for *_, e in counts) and sum(exact for _, exact, _, _ in counts) == N


def test_stored_sketches_are_merged_with_those_of_new_rows(spark, mart, tmp_path):
    path = str(tmp_path / "sketches")
    old, new = mart.filter("entity_id < 90000"), mart.filter("entity_id >= 90000 OR category_slug = 'c9'")
    estimates.category_sketches(old).write.parquet(path)
    stored = spark.read.parquet(path)
    merged = estimates.refreshed(stored, estimates.category_sketches(new))
    assert merged.columns == stored.columns
    assert all(e <= 2 * estimates.RANK_ERROR for _, _, e in rows_of(estimates.median_errors(mart, merged)))
    assert all(e <= estimates.COUNT_ERROR for *_, e in rows_of(estimates.count_errors(mart, merged)))
    assert all(len(r.prices) < 20_000 for r in merged.collect())


def test_category_summary_with_estimated_medians(mart):
    exact = {r.category_slug: r for r in marts.category_summary(mart).collect()}
    medians = estimates.estimated_medians(estimates.category_sketches(mart))
    for r in marts.category_summary(mart, medians=medians).collect():
        e = exact[r.category_slug]
        assert r.asDict() | {"median_entry_price": 0} == e.asDict() | {"median_entry_price": 0}
        assert r.median_entry_price == pytest.approx(e.median_entry_price, rel=0.1)


def test_few_values_are_exact_and_none_are_null(catalogue):
    mart = marts.entity_mart(catalogue)
    found = {r.category_slug: tuple(r)[2:] for r in estimates.category_estimates(estimates.category_sketches(mart)).collect()}
    assert found["llm"][:4] == (2, 2, 1, 50.0) and found["llm"][4] in (10.0, 15.0, 20.0)
    assert found["ai-image"] == (2, 0, 2, 100.0, None)
    assert found["dex"][4] is None  # its price can't be compared


def test_adopters_count_once_however_often_rows_come(catalogue):
    sketches = estimates.attribute_sketches(catalogue)
    again = estimates.refreshed(sketches, sketches)
    assert dict(rows_of(estimates.adoption_estimates(again))) == {"security": 2, "ai": 2}
