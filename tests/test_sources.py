import datetime
from dataclasses import replace

import pytest

from tariffscope.__main__ import run
from tariffscope.plans import build, marts
from tariffscope.sources import readers, writers
from tariffscope.sources.catalogue import catalogue_of, estimated_bytes, is_small
from tariffscope.sources.roles import BENCHMARK_SCHEMA, ENTITY, FLAT_EXPORT_SCHEMA, ROLES

from conftest import rows_of

STORED = {
    "categories": "id,slug,name,description,product_count\n1,llm,Large Models,,2\n",
    "products": (
        "id,slug,name,category_id,description,short_description,website_url,logo_url,g2_rating,"
        "capterra_rating,overall_rating,review_count,founded_year,hq_location,has_free_tier,"
        "has_free_trial,last_updated,detail_url\n"
        '7,a,"Alpha ""One"", Inc",1,,,https://a,,4.5,,4.5,0,2012,,1,0,2026-04-27,/a\n'
    ),
    "pricing_plans": (
        "id,product_id,plan_name,price_monthly,price_annual,billing_model,currency,features\n"
        '1,7,Free,0.0,,flat,USD,"[""one"", ""two""]"\n2,7,Sales,,,flat,USD,\n'
    ),
    "features": "id,product_id,feature_name,feature_value,category\n1,7,SSO,True,security\n",
    "price_history": "id,product_id,recorded_date,plan_name,price,notes\n1,7,2026-04-27,Free,0.0,x\n",
}


@pytest.fixture
def csv_root(tmp_path):
    for table, text in STORED.items():
        (tmp_path / f"{table}.csv").write_text(text)
    return str(tmp_path)


def test_csv_catalogue(spark, csv_root):
    c = readers.catalogue_from_csv(spark, csv_root)
    [entity] = c.entity.collect()
    assert entity.name == 'Alpha "One", Inc' and entity.has_free_tier is True
    assert entity.capterra_rating is None and entity.last_updated == datetime.date(2026, 4, 27)
    assert rows_of(c.offer, "entity_id", "price_monthly", "features") == [
        (7, 0.0, '["one", "two"]'), (7, None, None)
    ]
    assert c.category_is_small
    assert {name: df.columns for name, df in c.roles.items()} == {n: r.names for n, r in ROLES.items()}


def test_parquet_catalogue_with_other_column_names(spark, csv_root, tmp_path):
    for table in STORED:
        df = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(
            f"{csv_root}/{table}.csv"
        )
        stored = {r.table: r.stored_schema for r in ROLES.values()}[table]
        df = df.select([df[c.split()[0].strip("`")].cast(c.split()[1]) for c in stored.split(", ")])
        if table == "products":
            df = df.withColumnRenamed("detail_url", "page")
        df.write.parquet(f"{tmp_path}/p/{table}")
    c = readers.catalogue_from_parquet(spark, f"{tmp_path}/p", {"entity": {"detail_url": "page"}})
    assert rows_of(c.entity, "entity_id", "detail_url") == [(7, "/a")]
    readers.catalogue_views(c)
    assert spark.sql("SELECT count(*) FROM pricing_plans").first()[0] == 2


def test_unknown_role_column_is_refused():
    with pytest.raises(ValueError, match="no role columns"):
        ENTITY.stored_with({"nothing": "x"})


def test_jdbc_reads_are_divided_by_id():
    options = readers.jdbc_options(ROLES["offer"], "jdbc:x", (1, 1013), 8)
    assert options["partitionColumn"] == "id" and options["dbtable"] == "pricing_plans"
    assert options["numPartitions"] == "8"


def test_flat_files(spark, tmp_path):
    (tmp_path / "flat.csv").write_text(
        "tool_name,category,vertical,free_plan,starting_price_usd,highest_plan_price_usd,"
        "plan_count,rating,features_count,website\n"
        '"A, B",crm,Business,true,0,18,4,4.7,32,https://a\nC,dex,Crypto,false,,,2,,1,\n'
    )
    (tmp_path / "bench.csv").write_text(
        "category,vertical,tool_count,avg_rating,median_price,free_plan_pct\ncrm,Business,18,4.43,32,39\n"
    )
    flat = readers.read_csv(spark, str(tmp_path / "flat.csv"), FLAT_EXPORT_SCHEMA)
    assert rows_of(flat, "tool_name", "free_plan", "rating") == [("A, B", True, 4.7), ("C", False, None)]
    bench = readers.read_csv(spark, str(tmp_path / "bench.csv"), BENCHMARK_SCHEMA)
    assert rows_of(bench, "tool_count", "median_price") == [(18, 32.0)]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_stored_marts_read_back_the_same(catalogue, tmp_path, format):
    stored = build.write_marts(catalogue, str(tmp_path), format)
    planned = {
        "products_clean": marts.entity_mart(catalogue),
        "pricing_plans_clean": marts.offers_enriched(catalogue),
        "features_clean": marts.clean_attributes(catalogue),
        "category_summary": marts.category_summary(marts.entity_mart(catalogue)),
    }
    for name, df in planned.items():
        assert stored[name].dtypes == df.dtypes, name
        assert sorted(rows_of(stored[name]), key=str) == sorted(rows_of(df), key=str), name


def test_staged_entities_join_without_a_shuffle(catalogue, spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS staged")
    small = replace(catalogue, category_is_small=True)
    staged = build.stage_per_entity(small, "staged", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mart = build.staged_entity_mart(small, staged)
        plan = explained(mart)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan
    assert sorted(rows_of(mart), key=str) == sorted(rows_of(marts.entity_mart(catalogue)), key=str)


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_size_check(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_parquet(spark.range(1000), path)
    scan = spark.read.parquet(path)
    assert 0 < estimated_bytes(scan) < 100_000
    assert is_small(scan) and not is_small(scan, limit=10)


def test_large_category_table_is_not_broadcast(frames, monkeypatch):
    monkeypatch.setattr("tariffscope.sources.catalogue.is_small", lambda df: False)
    c = catalogue_of(frames)
    assert not c.category_is_small
    assert c.categories is c.category


def test_everything_runs_from_stored_tables(spark, csv_root, tmp_path):
    names = run(spark, csv_root, str(tmp_path / "out"), "csv", "parquet")
    assert len(names) == 54 == len(set(names))
    counts = spark.read.parquet(str(tmp_path / "out/results/dq_table_row_counts"))
    assert dict(rows_of(counts))["pricing_plans"] == 2
    kpis = spark.read.parquet(str(tmp_path / "out/results/kpi_board"))
    assert rows_of(kpis, "total_products", "free_tier_pct_text") == [(1, "100%")]
