from collections import Counter

import pytest
from pyspark.sql import functions as F

from tariffscope.operators.joins import join_lookup

from conftest import rows_of


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows have key 1, a sixth key 2 (which the lookup lacks), a sixth none."""
    keys = [1] * 1000 + [2] * 500 + [None] * 500 + [k for k in range(3, 503)] * 2
    return spark.createDataFrame(list(enumerate(keys)), "id long, k long").repartition(7)


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([(k, f"n{k}") for k in range(600) if k != 2 and k % 5], "k long, name string")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_the_way_of_joining_does_not_change_the_result(rows, lookup, how):
    large = join_lookup(rows, lookup, "k", how, small=False)
    plain = rows.join(lookup, "k", how)
    assert large.columns == plain.columns
    assert Counter(rows_of(large)) == Counter(rows_of(plain))
    assert Counter(rows_of(join_lookup(rows, lookup, "k", how))) == Counter(rows_of(plain))


def test_rows_are_scanned_once(spark, rows, lookup, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    lookup.write.parquet(str(tmp_path / "lookup"))
    rows, lookup = (spark.read.parquet(str(tmp_path / name)) for name in ("rows", "lookup"))
    for how in ("inner", "left"):
        plan = join_lookup(rows, lookup, "k", how, small=False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2


def test_rows_without_a_key_are_spread(spark, rows, lookup):
    joined = join_lookup(rows, lookup, "k", "left", small=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as dealt, before partitions are merged or split
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = joined.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("k").isNull())).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for _, n in tasks) == 500 and max(n for _, n in tasks) < 250


def test_no_rows(rows, lookup):
    none = rows.filter("false")
    assert rows_of(join_lookup(none, lookup, "k", "left", small=False)) == []


def test_other_joins_are_refused(rows, lookup):
    with pytest.raises(ValueError, match="right"):
        join_lookup(rows, lookup, "k", "right")
