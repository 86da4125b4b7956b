"""Alerts over a stream, in whatever batches it comes, against price changes over the whole log."""

import datetime
import random
from dataclasses import replace

import pytest

from tariffscope.plans import history
from tariffscope.sources.roles import PRICE_LOG
from tariffscope.streaming import alerts
from tariffscope.streaming.alerts import alert_stream, price_log_stream

from conftest import role_frame, rows_of

DAY = datetime.date(2024, 1, 1)
STORED = [c.name for c in PRICE_LOG.columns]


def at(day):
    return DAY + datetime.timedelta(days=day)


def snapshot(n, entity, plan, day, price):
    return {"log_id": n, "entity_id": entity, "plan_name": plan, "recorded_date": at(day), "price": price}


def arrive(spark, rows, folder):
    stored = [(r["log_id"], r["entity_id"], str(r["recorded_date"]), r["plan_name"], r["price"], None) for r in rows]
    spark.createDataFrame(stored, PRICE_LOG.stored_schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, root, **options):
    query = alert_stream(price_log_stream(spark, f"{root}/in", 1), f"{root}/out", f"{root}/state", **options)
    query.awaitTermination()
    assert query.exception() is None


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


def expected(spark, catalogue, rows):
    log = role_frame(spark, "price_log", rows)
    return by_text(rows_of(history.price_changes(replace(catalogue, price_log=log))))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_equal_the_batch_query(spark, catalogue, tmp_path, seed):
    """Snapshots come out of order by less than the delay, in batches cut anywhere; one plan has half of them."""
    rng, root = random.Random(seed), str(tmp_path)
    rows = [
        snapshot(n, rng.choice([1, 1, 2, None]), rng.choice(["Pro", "Pro", None]), rng.randint(0, 120), rng.choice([None, 0.0, 5.0, 5.0, 8.0]))
        for n in range(160)
    ]
    arriving = sorted(rows, key=lambda r: (r["recorded_date"] - DAY).days + rng.uniform(0, 9))
    cuts = [0, *sorted(rng.sample(range(1, 160), 4)), 160]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        arrive(spark, arriving[a:b], f"{root}/in")
        if i == 2:
            run(spark, root, delay="10 days")
    arrive(spark, [snapshot(1000, 77, "Clock", 1000, 1.0)], f"{root}/in")  # time goes on
    run(spark, root, delay="10 days")
    found = by_text(rows_of(spark.read.parquet(f"{root}/out")))
    assert len(found) > 15 and found == expected(spark, catalogue, rows)


def test_late_rows_open_days_and_thresholds(spark, catalogue, tmp_path):
    root = str(tmp_path)
    first = [snapshot(1, 1, "Pro", 0, 10.0), snapshot(2, 1, "Pro", 10, 10.2), snapshot(3, 1, "Pro", 40, 20.0)]
    arrive(spark, first, f"{root}/in")
    run(spark, root, delay="5 days", least_pct=5.0)
    # Day 10 is settled, 40 is open; 2 percent are too little.
    assert rows_of(spark.read.schema("entity_id long").parquet(f"{root}/out")) == []
    late = [snapshot(4, 1, "Pro", 12, 99.0)]  # long passed
    again = [snapshot(5, 1, "Pro", 40, 30.0), snapshot(6, 1, "Pro", 50, None), snapshot(7, 1, "Pro", 90, None)]
    arrive(spark, late + again, f"{root}/in")
    run(spark, root, delay="5 days", least_pct=5.0)
    found = by_text(rows_of(spark.read.parquet(f"{root}/out")))
    whole = expected(spark, catalogue, first + again)
    assert found == [r for r in whole if r[6] is None or abs(r[6]) >= 5] and len(found) == 2


def test_a_batch_that_runs_again_stores_nothing_twice(spark, tmp_path):
    """As after a failure between storing the changes and noting that the batch is done."""
    root = str(tmp_path)
    prices = {0: 1.0, 10: 2.0, 20: 3.0, 60: 4.0}
    arrive(spark, [snapshot(n, entity, None, day, price) for n, (day, price) in enumerate(prices.items()) for entity in (1, None)], f"{root}/in")
    run(spark, root)
    once = by_text(rows_of(spark.read.parquet(f"{root}/out")))
    assert len(once) == 4
    for commit in (tmp_path / "state" / "commits").iterdir():
        commit.unlink()
    run(spark, root)
    assert by_text(rows_of(spark.read.parquet(f"{root}/out"))) == once


def test_no_python_on_rows(spark):
    """Before, every plan was a call of Python in each batch."""
    rows = spark.createDataFrame([], "entity_id bigint, plan_name string, recorded_date date, price double")
    plan = alerts.changes_between(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "__span" in plan
