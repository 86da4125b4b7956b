from dataclasses import replace

from tariffscope.plans import questions, views

from conftest import role_frame, rows_of


def test_entry_price_counts_only_paid_entities(catalogue):
    assert rows_of(questions.entry_price_by_category(catalogue)) == [
        ("Large Models", 2, 15.0, 10.0, 20.0), ("Crm", 2, 5.0, 2.0, 8.0)
    ]
    included = rows_of(questions.entry_price_by_category(catalogue, exclude=()), "category")
    assert ("Dex",) in included


def test_free_tier_share(catalogue):
    assert rows_of(questions.free_tier_share(catalogue)) == [
        ("AI Image", 2, 2, 100.0), ("Dex", 1, 1, 100.0), ("Large Models", 2, 1, 50.0), ("Crm", 3, 1, 33.3)
    ]


def test_billing_model_mix_counts_free_but_not_custom(catalogue):
    assert rows_of(questions.billing_model_mix(catalogue)) == [
        ("flat", 6, 16.84), ("per-seat", 2, 15.0), ("usage-based", 1, 2.0), ("weekly", 1, 5.0)
    ]


def test_top_rated_needs_a_category(catalogue):
    rated = rows_of(questions.top_rated(catalogue, 3), "name", "category")
    assert rated == [("Fox", "Crm"), ("Gas", "Dex"), ("Alpha", "Large Models")]


def test_leaders_keep_ties(catalogue):
    assert rows_of(questions.category_leaders(catalogue)) == [
        ("Crm", "Fox", 5.0), ("Dex", "Gas", 4.9), ("Large Models", "Alpha", 4.5),
        ("Large Models", "Beta", 4.5), ("AI Image", "Ink", -1.0),
    ]


def test_attributes_vs_price(catalogue):
    assert rows_of(questions.attributes_vs_price(catalogue)) == [
        ("Alpha", 2, 10.0), ("Beta", 2, 20.0), ("Fox", 1, 2.0)
    ]


def test_best_free_uses_the_stated_count(catalogue):
    assert rows_of(questions.best_free(catalogue)) == [("Twin", "Crm", 4.0, 0)]
    assert rows_of(questions.best_free(catalogue, min_stated=2), "name") == [
        ("Alpha",), ("Twin",), ("Ink",)
    ]


def test_custom_price_by_category(catalogue):
    assert rows_of(questions.custom_price_by_category(catalogue)) == [("Large Models", 5, 1, 20.0)]
    assert rows_of(questions.custom_price_by_category(catalogue, 1))[0] == ("AI Image", 1, 1, 100.0)


def test_age_cohort_keeps_unpaid_entities(catalogue):
    assert rows_of(questions.age_cohort(catalogue)) == [
        (1985, 1, 4.5, 20.0), (2010, 2, 4.25, 9.0), (2015, 3, 4.9, 2.34), (2025, 1, -1.0, None),
        (2030, 1, 3.0, None),
    ]


def test_attribute_group_price_weights(catalogue):
    assert rows_of(questions.attribute_group_price(catalogue)) == [
        ("security", 2, 13.33), ("ai", 2, 11.0)
    ]
    assert rows_of(questions.attribute_group_price(catalogue, weight="entity")) == [
        ("security", 2, 15.0), ("ai", 2, 11.0)
    ]


def test_common_attributes(catalogue):
    assert rows_of(questions.common_attributes(catalogue, 2)) == [
        ("Chat", "ai", 2), ("SSO", "security", 2)
    ]


def test_value_score_is_ranked_rounded(catalogue):
    assert rows_of(questions.value_score(catalogue, 3), "name", "value_score") == [
        ("Gas", 490.0), ("Fox", 2.5), ("Twin", 0.5)
    ]


def test_category_stats_count_tied_offers(catalogue):
    stats = {r[1]: r[2:] for r in rows_of(views.category_stats(catalogue))}
    # Alpha counts twice: 2/3 free, (10 + 10 + 20) / 3.
    assert stats["llm"] == (2, 4.5, 13.33, 66.7)
    assert stats["crm"] == (7, 4.0, 5.0, 33.3)
    assert "ai-tools" not in stats
    deduped = {r[1]: r[2:] for r in rows_of(views.category_stats(catalogue, dedupe=True))}
    assert deduped["llm"] == (2, 4.5, 15.0, 50.0)


def test_category_offers_start_with_those_without_a_price(catalogue):
    offers = rows_of(views.category_offers(catalogue), "name", "plan_name", "price_monthly")
    assert offers == [
        ("Alpha", "Sales", None), ("Alpha", "Free", 0.0), ("Alpha", "Plus", 10.0),
        ("Alpha", "Team", 10.0), ("Beta", "Pro", 20.0),
    ]


def test_free_entities_end_with_unrated_ones(catalogue):
    assert rows_of(views.free_entities(catalogue), "name") == [
        ("Gas",), ("Alpha",), ("Twin",), ("Ink",), ("Twin",)
    ]


def test_views_can_be_queried(catalogue, spark):
    views.register_views(catalogue)
    assert spark.sql("SELECT count(*) FROM v_category_stats").first()[0] == 4
    assert spark.sql("SELECT count(*) FROM v_llm_comparison").first()[0] == 5
    assert spark.sql("SELECT count(*) FROM v_free_tier_products").first()[0] == 5


def test_small_and_large_category_tables_give_the_same(catalogue):
    small, large = (replace(catalogue, category_is_small=flag) for flag in (True, False))
    for plan in (questions.category_leaders, questions.top_rated, questions.free_tier_share):
        assert rows_of(plan(small)) == rows_of(plan(large))


def test_no_rated_entity_gives_no_leader(catalogue, spark):
    entity = role_frame(spark, "entity", [{"entity_id": 1, "category_id": 2}])
    assert rows_of(questions.category_leaders(replace(catalogue, entity=entity))) == []
