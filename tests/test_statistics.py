import random
import statistics as st
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s

from tariffscope.operators.histogram import equal_width_histogram
from tariffscope.operators.shares import listed_shares, value_shares
from tariffscope.plans import boards, marts, statistics
from tariffscope.sources.roles import MART_SCHEMAS

from conftest import rows_of

few_examples = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@pytest.fixture(scope="module")
def mart(catalogue):
    return marts.entity_mart(catalogue).cache()


@pytest.fixture(scope="module")
def large_mart(spark):
    """Two hundred entities in three categories and none, made by a fixed seed."""
    rng = random.Random(7)
    names = [f.split()[0] for f in MART_SCHEMAS["products_clean"].split(", ")]
    rows = []
    for i in range(200):
        row = dict.fromkeys(names)
        slug = rng.choice(["a", "b", "dex", None])
        row |= {
            "entity_id": i, "name": f"n{i}", "category_slug": slug, "category_name": slug,
            "overall_rating": rng.choice([None, rng.uniform(1, 5), rng.uniform(3, 5)]),
            "entry_price": rng.choice([None, rng.lognormvariate(3, 1)]),
            "price_comparable": slug != "dex", "feature_count": rng.randrange(20),
            "has_free_tier": rng.random() < 0.6, "has_custom_pricing": False,
        }
        rows.append(row)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], MART_SCHEMAS["products_clean"])
    return df.cache(), rows


def paired(rows):
    return [
        r for r in rows
        if r["price_comparable"] and r["overall_rating"] is not None and r["entry_price"] is not None
    ]


def test_median_entry_price(large_mart):
    df, rows = large_mart
    prices = [r["entry_price"] for r in rows if r["price_comparable"] and r["entry_price"] is not None]
    assert rows_of(statistics.median_entry_price(df)) == [(st.median(prices),)]


def test_correlations(large_mart):
    df, rows = large_mart
    price = [r["entry_price"] for r in paired(rows)]
    rating = [r["overall_rating"] for r in paired(rows)]
    count = [r["feature_count"] for r in paired(rows)]
    for plan, x, y in (
        (statistics.price_rating_correlation, price, rating),
        (statistics.attribute_price_correlation, count, price),
    ):
        [(n, r, t, p, flag)] = rows_of(plan(df))
        expected = st.correlation(x, y)
        assert n == len(x) and r == pytest.approx(expected, abs=1e-6)
        assert t == pytest.approx(expected * ((n - 2) / (1 - expected**2)) ** 0.5, abs=1e-5)
        assert 0 < p <= 1 and flag == (p < 0.05)


def test_perfect_correlation_is_certain(spark, large_mart):
    df, _ = large_mart
    for factor, sign in ((2, 1), (-2, -1)):
        line = df.withColumn("overall_rating", df.entry_price * factor)
        [(_, r, t, p, flag)] = rows_of(statistics.price_rating_correlation(line))
        assert r == pytest.approx(sign) and t * sign > 1e6 and p == pytest.approx(0, abs=1e-9) and flag
    rows = [(True, float(x), float(2 * x), 1) for x in (1, 2, 3)]
    exact = spark.createDataFrame(rows, "price_comparable boolean, entry_price double, overall_rating double, feature_count int")
    assert rows_of(statistics.price_rating_correlation(exact)) == [(3, 1.0, float("inf"), 0.0, True)]
    [(n, _, _, p, flag)] = rows_of(statistics.price_rating_correlation(exact.filter("entry_price < 3")))
    assert (n, p, flag) == (2, 1.0, False)


def test_categories_that_do_not_vary_within_differ_for_certain(spark):
    rows = [(c, r) for c, r in (("a", 1.0), ("b", 2.0), ("c", 2.0)) for _ in range(6)]
    df = spark.createDataFrame(rows, "category_slug string, overall_rating double")
    assert rows_of(statistics.rating_anova(df)) == [(2, 15, float("inf"), 0.0, True)]


def test_results_keep_their_precision(spark):
    rows = [(True, x * 1e12, x * 1e-9 + (x % 2) * 1e-10) for x in range(1, 30)]
    df = spark.createDataFrame(rows, "price_comparable boolean, entry_price double, overall_rating double")
    [(slope, _, r2)] = rows_of(statistics.price_rating_line(df))
    assert slope == pytest.approx(1e-21, rel=0.01) and 0.9 < r2 < 1


def test_tests_on_constant_or_no_values_are_null(spark, large_mart):
    df, _ = large_mart
    constant = df.withColumn("overall_rating", df.entry_price * 0 + 4)
    [(n, r, t, p, flag)] = rows_of(statistics.price_rating_correlation(constant))
    assert n > 0 and (r, t, p, flag) == (None,) * 4
    none = df.filter("false")
    assert rows_of(statistics.price_rating_correlation(none)) == [(0, None, None, None, None)]
    assert rows_of(statistics.rating_anova(none))[0][2:] == (None, None, None)
    assert rows_of(statistics.price_rating_line(none)) == [(None, None, None)]
    assert rows_of(statistics.median_entry_price(none)) == [(None,)]
    assert rows_of(statistics.free_share(none)) == [(None,)]
    assert rows_of(boards.kpi_board(none)) == [(0, 0, None, None, None, None)]
    assert {r[3] for r in rows_of(statistics.price_histogram(none))} == {0}


def test_anova_uses_all_entities_with_a_category(large_mart):
    df, rows = large_mart
    groups = [
        [r["overall_rating"] for r in rows if r["category_slug"] == g and r["overall_rating"] is not None]
        for g in ("a", "b", "dex")
    ]
    n, k = sum(map(len, groups)), len(groups)
    grand = st.mean(x for g in groups for x in g)
    between = sum(len(g) * (st.mean(g) - grand) ** 2 for g in groups) / (k - 1)
    within = sum((x - st.mean(g)) ** 2 for g in groups for x in g) / (n - k)
    [(df1, df2, f, p, flag)] = rows_of(statistics.rating_anova(df))
    assert (df1, df2) == (k - 1, n - k)
    assert f == pytest.approx(between / within, abs=1e-6)
    assert flag == (p < 0.05)


def test_anova_leaves_out_small_groups(mart):
    [(df1, df2, f, p, flag)] = rows_of(statistics.rating_anova(mart, min_rated=2))
    assert (df1, df2) == (1, 3)  # only llm (2 rated) and crm (3 rated)


def test_line(large_mart):
    df, rows = large_mart
    expected = st.linear_regression(
        [r["entry_price"] for r in paired(rows)], [r["overall_rating"] for r in paired(rows)]
    )
    [(slope, intercept, r2)] = rows_of(statistics.price_rating_line(df))
    assert slope == pytest.approx(expected.slope, abs=1e-6)
    assert intercept == pytest.approx(expected.intercept, abs=1e-6)
    assert 0 <= r2 <= 1


def test_value_leaders(mart):
    assert rows_of(statistics.value_leaders(mart, 2), "name", "value_score") == [
        ("Fox", 2.5), ("Hub", 0.96)
    ]


def test_free_share(mart):
    assert rows_of(statistics.free_share(mart)) == [(66.7,)]


def test_category_findings(mart):
    summary = marts.category_summary(mart)
    assert rows_of(statistics.top_categories_by_price(summary), "category_slug") == [
        ("llm",), ("crm",), ("ai-image",), ("dex",)
    ]
    assert set(rows_of(statistics.category_extremes(summary))) == {
        ("most_expensive", "Large Models", 15.0), ("cheapest", "CRM", 5.0),
        ("highest_free_share", "DEX", 100.0), ("lowest_free_share", "CRM", 33.3),
    }


def test_billing_shares_differ_in_what_they_divide_by(catalogue):
    assert rows_of(statistics.billing_share(catalogue.offer)) == [
        ("flat", 7, 63.6), ("per-seat", 2, 18.2), ("usage-based", 1, 9.1), ("weekly", 1, 9.1)
    ]
    assert rows_of(boards.billing_board(catalogue.offer)) == [
        ("flat", 7, 70.0), ("per-seat", 2, 20.0), ("usage-based", 1, 10.0), ("per-project", 0, 0.0)
    ]


def test_billing_board_without_offers(catalogue):
    none = catalogue.offer.filter("false")
    assert {r[1:] for r in rows_of(boards.billing_board(none))} == {(0, None)}


def test_category_board(mart):
    assert rows_of(boards.category_board(mart)) == [
        ("AI Image", 2, -1.0, None, 2, 100.0, 0.0), ("CRM", 3, 4.0, 5.0, 1, 33.3, 0.33),
        ("DEX", 1, 4.9, None, 1, 100.0, 0.0), ("Large Models", 2, 4.5, 15.0, 1, 50.0, 2.0),
    ]


def test_kpi_board(mart):
    assert rows_of(boards.kpi_board(mart)) == [(9, 4, 8.0, 66.7, "$8.00/mo", "66.7%")]


def test_entity_board_hides_prices_not_comparable(mart, catalogue):
    board = boards.entity_board(mart)
    assert len(board.columns) == 19
    prices = dict(rows_of(board, "entity_id", "entry_price_comparable"))
    assert prices[7] is None and prices[8] == 5.0
    offers = boards.offer_board(marts.offers_enriched(replace(catalogue)))
    assert len(offers.columns) == 6 and offers.count() == 12


@few_examples
@given(s.lists(s.floats(-1e6, 1e6), min_size=1, max_size=60), s.integers(1, 30))
def test_histogram_counts_every_value_once(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    bars = rows_of(equal_width_histogram(df, "v", bins))
    assert [b[0] for b in bars] == list(range(bins))
    assert sum(b[3] for b in bars) == len(values)


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 10)], "v double")
    assert rows_of(equal_width_histogram(df, "v", 5)) == [
        (0, 0.0, 2.0, 3), (1, 2.0, 4.0, 1), (2, 4.0, 6.0, 0), (3, 6.0, 8.0, 0), (4, 8.0, 10.0, 1)
    ]
    one = df.filter("v = 10")
    assert rows_of(equal_width_histogram(one, "v", 2)) == [(0, 9.5, 10.0, 0), (1, 10.0, 10.5, 1)]


def test_histogram_of_large_constants_and_what_is_no_number(spark):
    for value in (1e17, -1e300):
        df = spark.createDataFrame([(value,), (float("nan"),), (None,), (value,)], "v double")
        bars = rows_of(equal_width_histogram(df, "v", 4))
        assert [b[3] for b in bars] == [0, 0, 2, 0] and bars[0][1] < value < bars[-1][2]


@few_examples
@given(s.lists(s.sampled_from(["x", "y", "z", None]), max_size=50))
def test_shares_add_up(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "m string")
    shares = rows_of(value_shares(df, "m"))
    present = [v for v in values if v is not None]
    assert {m: n for m, n, _ in shares} == {m: present.count(m) for m in set(present)}
    listed = rows_of(listed_shares(df, "m", ("y", "w")))
    assert [(m, n) for _, m, n, _ in listed] == [("y", present.count("y")), ("w", 0)]
    if present:
        assert sum(p for _, _, p in shares) == pytest.approx(100, abs=0.2)
