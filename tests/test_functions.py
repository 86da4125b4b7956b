import math

import pytest
from pyspark.sql import functions as F

from tariffscope.functions.display import monthly_price_text, percent_text
from tariffscope.functions.flags import is_comparable, is_set, is_true_text, paid
from tariffscope.functions.rounding import half_even, half_up, percent, ratio
from tariffscope.functions.significance import f_upper, t_two_sided

from conftest import rows_of


def test_rounding_ties(spark):
    df = spark.createDataFrame([(11.125,), (4.125,), (1.005,), (2.675,), (-2.345,), (None,)], "x double")
    up, even = half_up(F.col("x"), 2), half_even(F.col("x"), 2)
    assert rows_of(df.select(up.alias("up"), even.alias("even"))) == [
        (11.13, 11.12), (4.13, 4.12), (1.01, 1.0), (2.68, 2.68), (-2.35, -2.34), (None, None)
    ]


def test_percent_and_ratio_by_zero(spark):
    df = spark.createDataFrame([(1, 4), (1, 0)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    assert rows_of(df.select(percent(a, b), ratio(a, b))) == [(25.0, 0.25), (None, None)]


def test_flags_are_never_null(spark):
    df = spark.createDataFrame([("TRUE", True, "dex", 1.0), (None, None, None, None), ("n/a", False, "x", 0.0)],
                               "v string, f boolean, s string, p double")
    result = df.select(
        is_true_text(F.col("v")), is_set(F.col("f")), is_comparable(F.col("s"), "dex"), paid(F.col("p"))
    )
    assert rows_of(result) == [
        (True, True, False, 1.0), (False, False, True, None), (False, False, True, None)
    ]


def test_display_text(spark):
    df = spark.createDataFrame([(16.0, 74.3), (2.5, 70.0), (None, None)], "p double, s double")
    assert rows_of(df.select(monthly_price_text(F.col("p")), percent_text(F.col("s")))) == [
        ("$16.00/mo", "74.3%"), ("$2.50/mo", "70%"), (None, None)
    ]


def test_t_critical_values(spark):
    known = [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.0, 1, 0.5), (-2.228139, 10, 0.05),
             (0.0, 5, 1.0), (3.169273, 10, 0.01)]
    df = spark.createDataFrame([(float(t), n) for t, n, _ in known], "t double, n int")
    for (p,), (_, _, expected) in zip(rows_of(df.select(t_two_sided("t", "n"))), known):
        assert p == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("size", [0.01, 0.5, 1.959964, 4.0])
def test_t_with_many_degrees_of_freedom_is_normal(spark, size):
    df = spark.createDataFrame([(size, 10**9)], "t double, n long")
    [(p,)] = rows_of(df.select(t_two_sided("t", "n")))
    assert p == pytest.approx(math.erfc(size / math.sqrt(2)), rel=1e-5)


def test_f_critical_values(spark):
    known = [(4.102821, 2, 10, 0.05), (161.447639, 1, 1, 0.05), (1.0, 7, 7, 0.5)]
    df = spark.createDataFrame([k[:3] for k in known], "f double, a int, b int")
    for (p,), (*_, expected) in zip(rows_of(df.select(f_upper("f", "a", "b"))), known):
        assert p == pytest.approx(expected, abs=1e-6)


def test_f_of_two_groups_is_t_squared(spark):
    df = spark.createDataFrame([(1.7, 23)], "t double, n int").withColumn("f", F.expr("t * t"))
    [(t, f)] = rows_of(df.withColumn("one", F.lit(1)).select(t_two_sided("t", "n"), f_upper("f", "one", "n")))
    assert t == pytest.approx(f, rel=1e-9)


def test_undefined_tests_are_null(spark):
    df = spark.createDataFrame([(None, 5), (1.0, 0)], "t double, n int")
    assert rows_of(df.select(t_two_sided("t", "n"), f_upper("t", "n", "n"))) == [(None, None)] * 2


def test_numbers_without_decimals_stay(spark):
    df = spark.createDataFrame([(1e18,), (-3.5e200,), (float("inf"),), (1e16 + 2,), (float("nan"),)], "x double")
    rounded = [tuple(r) for r in df.select(half_up(F.col("x"), 2), half_even(F.col("x"), 2)).collect()]
    assert rounded == [(1e18,) * 2, (-3.5e200,) * 2, (float("inf"),) * 2, (1e16 + 2,) * 2, (None,) * 2]
