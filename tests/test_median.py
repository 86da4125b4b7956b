import math
import random
import statistics
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tariffscope.operators import median
from tariffscope.operators.median import exact_medians, global_median

from conftest import rows_of


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_medians_are_exact(spark, few, seed):
    """A hot group, ties, signs, few and no values."""
    rng = random.Random(seed)
    values = {
        "hot": [rng.lognormvariate(3, 2) for _ in range(5001)],
        "tied": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(1000)],
        "even": [rng.uniform(-5, 5) for _ in range(400)],
        "negative": [-rng.expovariate(3) for _ in range(77)],
        "zeros": [0.0, -0.0, 0.0, 1e-300, -1e-300],
        "one": [7.5],
        "two": [1.0, 2.0],
        "far apart": [1e-308, 1e308, 5e-324, 3.0],
        "endless": [math.inf, math.inf, 1.7e308],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rows += [("hot", None), ("none", None), ("none", None), (None, 4.0), (None, 6.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    expected = {g: statistics.median(vs) for g, vs in values.items()}
    found = dict(rows_of(exact_medians(df, "g", "v", few)))
    found.pop(None, None)  # a missing key is no group to join by
    assert found == expected


def test_neighbouring_doubles_are_told_apart(spark):
    """What the last level must separate: values one bit apart, across a power of two, beside very different ones."""
    first = struct.unpack("<q", struct.pack("<d", 1.0))[0]
    near = [struct.unpack("<d", struct.pack("<q", first + i))[0] for i in range(-700, 701)]
    dense = [1.0 + i * 2.0**-40 for i in range(3000)]
    rows = [("near", v) for v in near] + [("dense", v) for v in dense + [1e9, 1e-9]]
    df = spark.createDataFrame(rows, "g string, v double")
    found = dict(rows_of(exact_medians(df, "g", "v")))
    assert found == {"near": statistics.median(near), "dense": statistics.median(dense + [1e9, 1e-9])}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(allow_nan=False), min_size=1, max_size=9), min_size=1, max_size=12))
def test_any_doubles(spark, groups):
    rows = [(g, v) for g, vs in enumerate(groups) for v in vs]
    found = dict(rows_of(exact_medians(spark.createDataFrame(rows, "g int, v double"), "g", "v", True)))
    for g, vs in enumerate(groups):
        low, high = sorted(vs)[(len(vs) - 1) // 2], sorted(vs)[len(vs) // 2]
        expected = (low + high) / 2
        assert found[g] == expected or (math.isnan(expected) and math.isnan(found[g]))


@pytest.mark.parametrize("size", [0, 1, 2, 999, 1000])
def test_global_median(spark, size):
    rng = random.Random(size)
    values = [rng.expovariate(0.1) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    expected = statistics.median(values) if values else None
    assert rows_of(global_median(df, "v")) == [(expected,)]


def test_a_hot_group_is_spread_over_tasks_and_only_buckets_are_ordered(spark, monkeypatch):
    """Half of all rows in one group, all values distinct."""
    kept = []
    store = median.checkpointed
    monkeypatch.setattr(median, "checkpointed", lambda df: kept.append(store(df)) or kept[-1])
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.sqrt("id") * 7).alias("v"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one task's
    try:
        found = exact_medians(rows, "g", "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    [values] = kept
    per_task = values.filter("__group = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 20_000 / 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("value" not in line for line in windows)
    assert "raise_error" not in plan and "hashpartitioning(__group" in plan and "__salt" in plan
    assert dict(rows_of(found))["hot"] == statistics.median(math.sqrt(i) * 7 for i in range(0, 40_000, 2))


def test_ordered_buckets_are_few(spark):
    """Prices of a cent to a million fall into fewer than 80,000 buckets, however many they are."""
    prices = spark.range(200_000).select((F.pow(F.lit(10.0), F.col("id") / 25_000 - 2)).alias("v"))
    assert prices.select(median._place(F.col("v"))).distinct().count() < 80_000
