"""What the plans must look like: what is broadcast, what is shuffled, how skew is met."""

import contextlib
import os
import re

import pytest
from pyspark.sql import functions as F

from tariffscope.plans import marts, quality, questions, views
from tariffscope.sources.catalogue import Catalogue, catalogue_of, is_small
from tariffscope.sources.readers import read_parquet
from tariffscope.sources.roles import ROLES
from testbed.registry import QUERIES

from conftest import rows_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The plan as adaptive execution ran it (without the one it started from)."""
    rows = df.collect()
    return rows, planned(df).split("== Initial Plan ==")[0]


@contextlib.contextmanager
def settings(spark, **values):
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A catalogue in Parquet where one entity has half of all offers and attributes,
    and one category half of all entities."""
    root = str(tmp_path_factory.mktemp("skewed"))
    n = 20000
    key = F.col("id")
    hot_half = F.when(key % 2 == 0, 0).otherwise(key % 500).cast("bigint")
    frames = {
        "category": spark.range(40).selectExpr(
            "id AS category_id", "concat('c', id) AS slug", "concat('C', id) AS name",
            "CAST(NULL AS STRING) AS description", "id AS product_count",
        ),
        "entity": spark.range(n).select(
            key.alias("entity_id"),
            F.concat(F.lit("e"), key).alias("name"),
            F.when(key % 2 == 0, 0).otherwise(key % 40).cast("bigint").alias("category_id"),
            (key % 50 / 10).cast("double").alias("overall_rating"),
            (key % 3 == 0).alias("has_free_tier"),
        ),
        "offer": spark.range(n).select(
            key.alias("offer_id"), hot_half.alias("entity_id"),
            F.sha2(key.cast("string"), 256).alias("plan_name"),
            F.when(key % 7 != 0, key % 97 * 1.0).alias("price_monthly"),
            F.lit("flat").alias("billing_model"),
        ),
        "attribute": spark.range(n).select(
            key.alias("attribute_id"), hot_half.alias("entity_id"),
            F.lit("SSO").alias("feature_name"), F.lit("True").alias("feature_value"),
            F.lit("security").alias("category"),
        ),
        "price_log": spark.range(10).select(key.alias("log_id")),
    }
    roles = {}
    for name, df in frames.items():
        role = ROLES[name]
        missing = [c for c in role.columns if c.name not in df.columns]
        df = df.select("*", *(F.lit(None).cast(c.type).alias(c.name) for c in missing))
        df.select(*role.names).repartition(8).write.parquet(f"{root}/{name}")
        roles[name] = read_parquet(spark, f"{root}/{name}", role.schema)
    return catalogue_of(roles)


def test_small_category_table_is_found_by_its_file_size(stored):
    assert stored.category_is_small and is_small(stored.category)


def test_existence_tests_are_anti_joins_on_distinct_keys(stored):
    plan = planned(quality.entities_without_offers(stored))
    assert "LeftAnti" in plan and "keys=[entity_id" in plan


def test_top_k_is_not_a_total_sort(stored):
    for plan in (questions.top_rated, questions.best_free, questions.value_score,
                 questions.common_attributes):
        text = planned(plan(stored))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_filters_and_columns_reach_the_scan(stored):
    plan = stored.offer.sparkSession._jvm.PythonSQLUtils.explainString(
        questions.billing_model_mix(stored)._jdf.queryExecution(), "formatted"
    )
    assert "PushedFilters: [IsNotNull(price_monthly)]" in plan
    assert "ReadSchema: struct<price_monthly:double,billing_model:string>" in plan


def test_rows_are_grouped_before_the_category_is_joined(stored, spark):
    """Free-tier share shuffles partial sums per category, not entities."""
    plan = planned(questions.free_tier_share(stored))
    assert "partial_count" in plan
    assert "SortMergeJoin" not in plan


def test_entities_are_shuffled_once_for_both_summaries(stored, spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = planned(marts.entity_mart(stored))
    assert len(re.findall(r"Exchange hashpartitioning\(entity_id", plan)) == 3


def broadcast_parts(plan):
    """The lines below each broadcast of a plan."""
    lines = plan.splitlines()
    depths = [len(re.match(r"[ :+-]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


def is_bounded(part):
    """A broadcast part that starts from the fixed small tables."""
    return re.search(r"(nation|region)\.parquet", part)


def test_large_lookups_are_not_broadcast(stored, spark, monkeypatch):
    monkeypatch.setattr("tariffscope.operators.joins.is_small", lambda df: False)
    large = Catalogue(**stored.roles)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for plan in (questions.top_rated, questions.category_leaders, views.free_entities,
                     quality.custom_offers, marts.offers_enriched):
            text = planned(plan(large))
            assert "SortMergeJoin" in text
            assert not list(broadcast_parts(text))


def test_half_of_the_rows_on_one_key_are_split(stored, spark, monkeypatch):
    """Half of the offers are one entity's; their partition is read by several tasks."""
    monkeypatch.setattr("tariffscope.operators.joins.is_small", lambda df: False)
    with settings(spark, **SKEW):
        rows, plan = final(marts.offers_enriched(stored))
    assert len(rows) == 20000 and all(r.product_name is not None for r in rows)
    assert "skew=true" in plan


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "16KB",
    "spark__sql__shuffle__partitions": "8",
}


def test_entities_of_one_category_give_the_same_where_it_cannot_be_broadcast(stored, spark):
    large = Catalogue(**stored.roles)
    with settings(spark, **SKEW):
        rows = rows_of(views.free_entities(large))
    assert rows == rows_of(views.free_entities(stored))


def test_hot_groups_shrink_before_the_shuffle(stored, spark):
    """One entity has half of the offers, yet each task sends one row for it."""
    summary = marts.offer_summary(stored)
    spark_plan = planned(summary)
    assert "partial_min" in spark_plan
    assert rows_of(summary.filter("entity_id = 0"), "plan_count") == [(10000,)]


@pytest.fixture(scope="module")
def registered(spark):
    """The plans of all queries as for large tables, without Spark's own choice to broadcast."""
    with pytest.MonkeyPatch.context() as patch, settings(
        spark, spark__sql__autoBroadcastJoinThreshold="-1"
    ):
        for module in ("operators.joins", "plans.quality", "plans.views"):
            patch.setattr(f"tariffscope.{module}.is_small", lambda df: False)
        return {name: planned(query(spark, SF)) for name, query in QUERIES.items()}


@needs_data
def test_no_query_multiplies_rows_or_leaves_the_jvm(registered):
    for name, plan in registered.items():
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert unwanted not in plan, (name, unwanted)


# Their medians are a row for each of the categories, which were found to be few.
PER_CATEGORY = {"category_summary", "benchmark_by_vertical"}


@needs_data
def test_only_what_is_bounded_is_broadcast(registered):
    for name, plan in registered.items():
        for part in broadcast_parts(plan):
            assert is_bounded(part) or (name in PER_CATEGORY and "[__group" in part), (name, part)


# Scans of files where nothing is small: without hints, Spark plans each use of a frame anew.
MOST_SCANS = {"q05_category_leaders": 8, "category_summary": 12, "category_extremes": 12, "dq_mart_counters": 18, "offers_enriched": 2, "view_category_offers": 6}


@needs_data
def test_scans_stay_few_where_nothing_is_small(registered):
    for name, most in MOST_SCANS.items():
        assert registered[name].count("FileScan") <= most, (name, registered[name].count("FileScan"))
