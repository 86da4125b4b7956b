import random

import pytest

from tariffscope.sources.loading import first_wins, load_table
from tariffscope.sources.roles import CATEGORY, OFFER

from conftest import role_frame, rows_of

KEYS = (("id",), ("slug",))
SCHEMA = "position int, id int, slug string"


def one_by_one(rows, stored):
    """What adding the rows in order keeps, where both id and slug are unique."""
    ids, slugs, kept = {r[1] for r in stored}, {r[2] for r in stored}, set()
    for position, id, slug in sorted(rows, key=lambda r: r[0]):
        if id is not None and slug is not None and id not in ids and slug not in slugs:
            ids.add(id)
            slugs.add(slug)
            kept.add((position, id, slug))
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_two_keys_match_loading_one_by_one(spark, seed):
    """Few values make long chains of clashes; a third of the rows share one slug."""
    rng = random.Random(seed)
    slugs = ["hot"] * 10 + [f"s{i}" for i in range(20)]
    rows = [
        (i, rng.choice([None, *range(25)]), rng.choice([None, *slugs])) for i in range(120)
    ]
    stored = [(0, 3, "s1"), (0, 4, "other")]
    result = first_wins(
        spark.createDataFrame(rows, SCHEMA).repartition(5),
        spark.createDataFrame(stored, SCHEMA), KEYS, ["position"],
    )
    assert set(rows_of(result, "position", "id", "slug")) == one_by_one(rows, stored)


def test_a_row_that_is_dropped_does_not_block_others(spark):
    rows = [(1, 1, "a"), (2, 2, "a"), (3, 2, "b")]
    result = first_wins(spark.createDataFrame(rows, SCHEMA), None, KEYS, ["position"])
    assert set(rows_of(result)) == {(1, 1, "a"), (3, 2, "b")}


def test_one_key(spark):
    rows = [(2, 1, "b"), (1, 1, "a"), (3, 2, "c"), (4, None, "d")]
    result = first_wins(spark.createDataFrame(rows, SCHEMA), None, (("id",),), ["position"])
    assert set(rows_of(result)) == {(1, 1, "a"), (3, 2, "c")}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(first_wins(none, None, KEYS, ["position"])) == []


def test_keyed_tables_load_once_and_others_each_time(spark, frames, tmp_path):
    for role, df, order, expected in (
        (CATEGORY, frames["category"], "category_id", 5), (OFFER, frames["offer"], "offer_id", 24)
    ):
        path = str(tmp_path / role.table)
        load_table(df, None, role, path, [order])
        load_table(df, spark.read.parquet(path), role, path, [order])
        assert spark.read.parquet(path).count() == expected


def test_stored_rows_win(spark, frames, tmp_path):
    path = str(tmp_path / "categories")
    load_table(frames["category"], None, CATEGORY, path, ["category_id"])
    new = role_frame(
        spark, "category",
        [{"category_id": 9, "slug": "crm", "name": "Again"}, {"category_id": 9, "slug": "new", "name": "New"}],
    )
    load_table(new, spark.read.parquet(path), CATEGORY, path, ["category_id"])
    names = {r[0] for r in rows_of(spark.read.parquet(path), "name")}
    assert "New" in names and "Again" not in names
