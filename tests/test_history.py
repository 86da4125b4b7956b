"""Price history against loops over each plan's snapshots."""

import datetime
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tariffscope.operators.timeline import as_of, with_neighbour
from tariffscope.plans import history

from conftest import role_frame, rows_of

DAY = datetime.date(2020, 1, 1)


def snapshots(seed, plans=6, most=40):
    rng = random.Random(seed)
    rows = []
    for plan in range(plans):
        for _ in range(rng.randint(1, most)):
            rows.append({
                "log_id": len(rows), "entity_id": rng.choice([None, 1, 1, 1, 2, 3]),
                "plan_name": rng.choice([None, "Pro", "Pro", "Free"]),
                "recorded_date": rng.choice([None, *[DAY + datetime.timedelta(days=rng.randint(0, 1500))] * 9]),
                "price": rng.choice([None, 0.0, 10.0, 10.0, 12.5, 20.0]),
            })
    rng.shuffle(rows)
    return rows


def daily(rows):
    """(entity, plan) -> [(day, price)] in order, the last snapshot of each day."""
    last = {}
    for r in sorted(rows, key=lambda r: r["log_id"]):
        if r["recorded_date"]:
            last.setdefault((r["entity_id"], r["plan_name"]), {})[r["recorded_date"]] = r["price"]
    return {k: sorted(v.items(), key=lambda d: d[0]) for k, v in last.items()}


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.fixture
def log(spark, catalogue):
    def make(rows):
        return replace(catalogue, price_log=role_frame(spark, "price_log", rows).repartition(4))

    return make


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_and_periods(log, seed):
    rows = snapshots(seed)
    changes, periods = [], []
    for (entity, plan), days in daily(rows).items():
        starts = [days[0]]
        for (before, old), (day, new) in zip(days, days[1:]):
            if old != new:
                pct = None if old in (None, 0) or new is None else round(100 * (new - old) / old, 2)
                changes.append((entity, plan, day, before, old, new, pct))
                starts.append((day, new))
        for (day, price), after in zip(starts, [*starts[1:], None]):
            periods.append((entity, plan, price, day, after and after[0], after and (after[0] - day).days))
    assert len(changes) > 20
    assert by_text(rows_of(history.price_changes(log(rows)))) == by_text(changes)
    assert by_text(rows_of(history.price_periods(log(rows)))) == by_text(periods)


def test_price_at_a_date(spark, log):
    rows = snapshots(3)
    known = daily(rows)
    rng = random.Random(4)
    asks = [(rng.choice([None, 1, 2, 9]), rng.choice([None, "Pro", "Free"]), rng.choice([None, *[DAY + datetime.timedelta(days=rng.randint(-50, 1700))] * 6]))
            for _ in range(200)]
    asks += asks[:30] + [(k[0], k[1], d) for k, days in known.items() for d, _ in days[:5]]

    def answer(entity, plan, day):
        earlier = [d for d in known.get((entity, plan), []) if day and d[0] <= day]
        return (earlier[-1][1], earlier[-1][0]) if earlier else (None, None)

    frame = spark.createDataFrame(asks, "entity_id long, plan_name string, as_of date")
    found = rows_of(history.prices_at(log(rows), frame))
    assert by_text(found) == by_text((*a, *answer(*a)) for a in asks)


@pytest.mark.parametrize("seed", [5, 6])
def test_months_and_trends(log, seed):
    rows = snapshots(seed, plans=3, most=12)
    months, trends = [], []
    for (entity, plan), days in daily(rows).items():
        ends = {d.replace(day=1): p for d, p in days}
        at, price, series = min(ends), None, []
        while at <= max(ends):
            price = ends.get(at, price)
            series.append((at, price))
            months.append((entity, plan, at, price, at in ends))
            at = (at + datetime.timedelta(days=32)).replace(day=1)
        points = [(m.year * 12 + m.month, p) for m, p in series if p is not None]
        if points:
            slope = change = None
            if len(points) > 1:
                mx, my = (sum(v) / len(points) for v in zip(*points))
                slope = round(sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points), 6)
                change = round(100 * (points[-1][1] - points[0][1]) / points[0][1], 2) if points[0][1] else None
            trends.append((entity, plan, len(points), slope, points[0][1], points[-1][1], change))
    assert by_text(rows_of(history.price_by_month(log(rows)))) == by_text(months)
    found = by_text(rows_of(history.price_trends(log(rows))))
    for mine, expected in zip(found, by_text(trends), strict=True):
        assert mine[:3] + mine[4:6] == expected[:3] + expected[4:6]
        assert mine[3] == pytest.approx(expected[3], abs=2e-6) and mine[6] == pytest.approx(expected[6], abs=0.011)


def test_an_empty_log(log):
    for plan in (history.price_changes, history.price_periods, history.price_by_month, history.price_trends):
        assert rows_of(plan(log([]))) == []
    assert rows_of(history.prices_on_dates(log([]), [DAY])) == []


@pytest.mark.parametrize("span", [F.year, lambda t: F.trunc(t, "month"), lambda t: F.lit(0)])
def test_spans_do_not_change_the_answer(spark, span):
    rng = random.Random(7)
    days = rng.sample(range(900), 60)
    rows = [("k", DAY + datetime.timedelta(days=d), rng.choice([None, 1, 2])) for d in sorted(days)]
    frame = spark.createDataFrame(rows, "key string, day date, v int")
    for backwards in (False, True):
        found = dict(rows_of(with_neighbour(frame, ["key"], "day", ["v"], "n", backwards, span), "day", "n"))
        order = rows[::-1] if backwards else rows
        assert found == {r[1]: before and (before[2],) for before, r in zip([None, *order], order)}
    asks = spark.createDataFrame([("k", DAY + datetime.timedelta(days=d)) for d in range(-3, 910, 7)], "key string, at date")
    for key, at, v, day in rows_of(as_of(asks, frame, ["key"], "at", "day", ["v", "day"], span)):
        earlier = [r for r in rows if r[1] <= at]
        assert (v, day) == ((earlier[-1][2], earlier[-1][1]) if earlier else (None, None))


def test_windows_hold_a_span_of_one_plan_and_days_are_combined_first(log):
    """A plan with most of the log reaches the shuffle as one row a task and day."""
    rows = [{"log_id": i, "entity_id": 1, "plan_name": "Pro", "recorded_date": DAY + datetime.timedelta(days=i % 400), "price": float(i % 7)} for i in range(4000)]
    plan = history.price_changes(log(rows))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by(price" in plan and "Python" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("__span" in w.split("],")[1] for w in windows)


def test_prices_on_dates_is_two_aggregates(log):
    """Few dates or many, the answer is that of asking; a few need neither window nor join."""
    rows = snapshots(11) + [{"log_id": 999, "entity_id": 9, "plan_name": "Undated", "recorded_date": None, "price": 1.0}]
    few = [DAY + datetime.timedelta(days=d) for d in (-1, 300, 700, 1600)]
    plan = history.prices_on_dates(log(rows), few)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Join", "Window", "Sort"))
    known = daily(rows) | {(9, "Undated"): []}
    for dates in (few, few + [DAY + datetime.timedelta(days=d) for d in range(history.FEW_DATES)]):
        answers = []
        for key, days in known.items():
            for at in dates:
                earlier = [(p, d) for d, p in days if d <= at]
                answers.append((*key, at, *(earlier[-1] if earlier else (None, None))))
        keys = {(r["entity_id"], r["plan_name"]) for r in rows}
        answers += [(*key, at, None, None) for key in keys - set(known) for at in dates]
        assert by_text(rows_of(history.prices_on_dates(log(rows), dates))) == by_text(answers)
