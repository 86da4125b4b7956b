"""The test tables read as a catalogue.

Nations (and one umbrella region) are the categories, customers the entities, orders
the offers and the price log, events the attributes.  All rows of these tables are
used.  The tables hold no missing values, so some are derived: one order status
stands for offers without a price, low balances for missing ratings.  Prices are few, so that they tie.
"""

from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.sources.catalogue import Catalogue, is_small

UMBRELLA = "asia"
ROLLUP_PREFIX = "asia-"
ROLLUP_SLUGS = ("europe-nation_3",)
NOT_COMPARABLE = "asia-nation_22"
SHOWN_CATEGORY = "africa-nation_5"
NAME_FIXES = {"NATION_3": "Nation Three", "NATION_17": "Nation Seventeen"}
BILLING_MODELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "6-NEVER")
CLEANING = {"umbrella": UMBRELLA, "name_fixes": NAME_FIXES}


# Schemas are declared: inferring them would run a job per table.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}

_LEAF_COLUMNS = (
    "CAST(n_nationkey AS BIGINT) AS category_id",
    "lower(replace(r_name, ' ', '_') || '-' || n_name) AS slug",
    "n_name AS name",
    # The stated count is wrong for every sixth nation, and small for one.
    "CASE WHEN n_nationkey = 24 THEN 4L ELSE coalesce(customers, 0) - CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END"
    " END AS product_count",
)
_UMBRELLA_COLUMNS = (
    "CAST(-1 AS BIGINT) AS category_id",
    "lower(r_name) AS slug",
    "initcap(r_name) AS name",
    "coalesce(customers, 0) AS product_count",
)
_ENTITY_COLUMNS = (
    "c_custkey AS entity_id",
    "lower(c_name) AS slug",
    "c_name AS name",
    # One nation keeps only a few customers, and of their orders a few.
    "CAST(CASE WHEN c_nationkey = 24 AND c_custkey % 40 <> 7 THEN 23 ELSE c_nationkey END AS BIGINT) AS category_id",
    "c_acctbal / 2000 AS g2_rating",
    "CASE WHEN c_acctbal >= 0 THEN 5 - c_acctbal / 2000 END AS capterra_rating",
    "CASE WHEN c_acctbal >= 0 THEN c_acctbal / 2000 END AS overall_rating",
    "CAST(0 AS BIGINT) AS review_count",
    "CAST(CASE WHEN c_custkey % 50 <> 0 THEN 1980 + c_custkey % 50 END AS INT) AS founded_year",
    "c_mktsegment AS hq_location",
    "c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') AS has_free_tier",
    "c_mktsegment = 'MACHINERY' AS has_free_trial",
    "'https://example.org/' || c_custkey AS website_url",
    "'/tools/' || lower(c_name) AS detail_url",
)
_OFFER_COLUMNS = (
    "o_orderkey AS offer_id",
    # One customer in forty passes most of their orders on to the one before, and may have none.
    "CASE WHEN o_custkey % 40 = 7 AND o_orderkey % 8 <> 0 THEN o_custkey - 1 ELSE o_custkey END AS entity_id",
    "o_orderstatus AS plan_name",
    # Few prices, so that an entity's offers tie.
    "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 0D "
    "ELSE CAST(floor(o_totalprice / 25000) + 1 AS DOUBLE) * 25 END AS price_monthly",
    "o_totalprice / 100 AS price_annual",
    "CASE WHEN o_orderkey % 29 <> 4 THEN o_orderpriority END AS billing_model",
    "'USD' AS currency",
    # Lists of highlights, and what is none: missing, empty, cut off, no list, or with something behind it.
    """CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["' || o_orderpriority || '"'
    WHEN 3 THEN '{"a": 1}' WHEN 4 THEN ' ' WHEN 5 THEN 'null' WHEN 6 THEN '["a"] and more'
    WHEN 7 THEN '["Twice", "Twice", 7, {"x": 1}]'
    ELSE '["' || o_orderpriority || '", " Plan ' || o_orderstatus || ' ", null, "", "tier '
    || CAST(o_orderkey % 7 AS STRING) || '"]' END AS features""",
)
_ATTRIBUTE_COLUMNS = (
    "event_id AS attribute_id",
    "user_id AS entity_id",
    "event_type || '_' || (event_id % 5) AS feature_name",
    "CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'False' ELSE 'n/a' END "
    "AS feature_value",
    "event_type AS category",
)
_PRICE_LOG_COLUMNS = (
    "o_orderkey AS log_id",
    # One customer has a quarter of the log; every third snapshot is dated at the beginning of its month.
    "CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE o_custkey END AS entity_id",
    "CAST(CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE)"
    " AS recorded_date",
    "CASE WHEN o_orderkey % 17 <> 3 THEN o_orderstatus END AS plan_name",
    # Few prices, so that many snapshots repeat the one before.
    "CASE WHEN o_orderkey % 13 <> 5 THEN CAST(floor(o_totalprice / 100000) AS DOUBLE) * 10 END AS price",
)
ALERT_DELAY = "30 days"
REPORT_DATES = (date(1996, 6, 30), date(1998, 1, 1), date(2000, 2, 29))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _category(nation: DataFrame, region: DataFrame, customer: DataFrame, small: bool) -> DataFrame:
    """Categories.  Their number is bounded by nations and regions, so if these two tables
    were found small, joining them is broadcast; the counts of customers are left joins
    on unique keys, which Spark drops where no count is asked for."""
    bounded = F.broadcast if small else lambda df: df
    customers = customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    leaves = nation.join(
        bounded(region), nation["n_regionkey"] == region["r_regionkey"]
    ).join(customers, F.expr("n_nationkey = c_nationkey"), "left")
    per_region = (
        customers.join(bounded(nation), F.expr("c_nationkey = n_nationkey"))
        .groupBy("n_regionkey")
        .agg(F.sum("customers").alias("customers"))
    )
    umbrella = region.filter(F.lower("r_name") == UMBRELLA).join(
        per_region, F.expr("r_regionkey = n_regionkey"), "left"
    )
    return leaves.selectExpr(*_LEAF_COLUMNS).unionByName(umbrella.selectExpr(*_UMBRELLA_COLUMNS))


@lru_cache(maxsize=8)
def bind(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The catalogue over the tables in ``sf_dir``, opened once per session.

    It holds plans, not data: every query on it scans the tables anew.
    """
    nation, region, customer, orders, events = (
        table(spark, sf_dir, name) for name in ("nation", "region", "customer", "orders", "events")
    )
    small = is_small(nation) and is_small(region)
    return Catalogue(
        category=_category(nation, region, customer, small),
        entity=customer.selectExpr(*_ENTITY_COLUMNS),
        offer=orders.selectExpr(*_OFFER_COLUMNS),
        attribute=events.selectExpr(*_ATTRIBUTE_COLUMNS),
        price_log=orders.selectExpr(*_PRICE_LOG_COLUMNS),
        category_is_small=small,
    )


def verticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's region; one region is no vertical."""
    region = F.substring_index("slug", "-", 1)
    leaves = bind(spark, sf_dir).category.filter(F.col("slug") != UMBRELLA)
    return leaves.select(F.col("slug").alias("category_slug"), region.alias("vertical")).filter("vertical != 'europe'")


def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their name as slug: unlike customer names, part names do repeat."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.lower("p_name").alias("slug"), "p_brand"
    )


def price_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price log as its files are found, one a batch."""
    orders = spark.readStream.schema(_SCHEMAS["orders"]).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/orders.parquet*")
    return orders.selectExpr(*_PRICE_LOG_COLUMNS)


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with two keys that both repeat: name and brand, and type with size."""
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").alias("part_id"),
        F.concat_ws("-", F.lower("p_name"), "p_brand").alias("slug"),
        F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("kind"),
    )
