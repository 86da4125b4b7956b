import pytest

from tariffscope.sources.roles import CATEGORY, PRICE_LOG
from tariffscope.streaming.ingest import load_stream, read_loaded

from conftest import rows_of


def arrive(spark, role, rows, folder):
    spark.createDataFrame(rows, role.stored_schema).coalesce(1).write.mode("append").parquet(folder)


def load(spark, role, root, order, state="state"):
    query = load_stream(spark, role, f"{root}/in", f"{root}/out", f"{root}/{state}", [order])
    query.awaitTermination()
    assert query.exception() is None


def test_keyed_rows_are_loaded_once(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, CATEGORY, [(1, "a", "A", None, 1), (2, "b", "B", None, 2), (3, "a", "C", None, 3)], f"{root}/in")
    load(spark, CATEGORY, root, "category_id")
    arrive(spark, CATEGORY, [(1, "z", "Z", None, 9), (4, "d", "D", None, 4)], f"{root}/in")
    load(spark, CATEGORY, root, "category_id")
    loaded = read_loaded(spark, CATEGORY, f"{root}/out")
    assert set(rows_of(loaded, "name", "batch")) == {("A", 0), ("B", 0), ("D", 1)}


def test_log_rows_are_all_loaded(spark, tmp_path):
    root = str(tmp_path)
    row = (1, 7, "2026-04-27", "Free", 0.0, None)
    arrive(spark, PRICE_LOG, [row, row], f"{root}/in")
    load(spark, PRICE_LOG, root, "log_id")
    arrive(spark, PRICE_LOG, [row], f"{root}/in")
    load(spark, PRICE_LOG, root, "log_id")
    assert read_loaded(spark, PRICE_LOG, f"{root}/out").count() == 3


def test_a_new_state_folder_keeps_all_rows_and_adds_none_twice(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, CATEGORY, [(1, "a", "A", None, 1), (2, "b", "B", None, 2)], f"{root}/in")
    load(spark, CATEGORY, root, "category_id")
    arrive(spark, CATEGORY, [(3, "c", "C", None, 3), (4, "a", "again", None, 3)], f"{root}/in")
    load(spark, CATEGORY, root, "category_id", "other")
    load(spark, CATEGORY, root, "category_id")
    assert sorted(rows_of(read_loaded(spark, CATEGORY, f"{root}/out"), "name")) == [("A",), ("B",), ("C",)]


def test_rows_without_keys_are_not_loaded_twice(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, PRICE_LOG, [(1, 7, "2026-04-27", "Free", 0.0, None)], f"{root}/in")
    load(spark, PRICE_LOG, root, "log_id")
    with pytest.raises(ValueError, match="no key"):
        load(spark, PRICE_LOG, root, "log_id", "other")
    assert read_loaded(spark, PRICE_LOG, f"{root}/out").count() == 1
