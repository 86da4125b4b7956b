"""What the price log tells: changes, periods, the price at a date, monthly series, trends.

The log holds snapshots.  Of several snapshots of a plan on one day the last (largest
``log_id``) is that day's price; a NULL price is a quote on request, which is a price of its
own kind: going to or from it is a change, without a percentage.  A plan is an entity's offer by name;
plans without a name are one plan.  Snapshots without a date tell nothing.

A plan's history is at most a row a day when it reaches a window, and windows hold a year of it
(``operators.timeline``), so an entity with a large part of the log is no heavier than others.
"""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up, percent
from ..operators.timeline import as_of, last_per_time, with_neighbour
from ..sources.catalogue import Catalogue

PLAN = ["entity_id", "plan_name"]
# So many dates are aggregates of one pass.
FEW_DATES = 32


def daily_prices(price_log: DataFrame) -> DataFrame:
    """entity_id, plan_name, recorded_date, price: one row a plan and day."""
    return last_per_time(price_log, PLAN, "recorded_date", "log_id", "price")


def _with_previous(price_log: DataFrame) -> DataFrame:
    return with_neighbour(daily_prices(price_log), PLAN, "recorded_date", ["recorded_date", "price"])


def _is_change():
    return ~F.col("price").eqNullSafe(F.col("previous.price"))


def price_changes(c: Catalogue) -> DataFrame:
    """Every change of a plan's price: its day, the snapshot before, old and new price and the change in percent.

    The percentage is NULL from or to a quote on request, and from a price of zero.
    """
    changed = _with_previous(c.price_log).filter(F.col("previous").isNotNull() & _is_change())
    return changed.select(
        *PLAN,
        "recorded_date",
        F.col("previous.recorded_date").alias("previous_date"),
        F.col("previous.price").alias("old_price"),
        F.col("price").alias("new_price"),
        half_up(percent(F.col("price") - F.col("previous.price"), F.col("previous.price")), 2).alias("change_pct"),
    )


def price_periods(c: Catalogue) -> DataFrame:
    """Spells of an unchanged price: from its first snapshot to the day of the next change, which is not in it.

    ``valid_to`` and ``days`` are NULL for the price that still holds.
    """
    starts = _with_previous(c.price_log).filter(F.col("previous").isNull() | _is_change()).drop("previous")
    spells = with_neighbour(starts, PLAN, "recorded_date", ["recorded_date"], "next", backwards=True)
    return spells.select(
        *PLAN,
        "price",
        F.col("recorded_date").alias("valid_from"),
        F.col("next.recorded_date").alias("valid_to"),
        F.datediff("next.recorded_date", "recorded_date").alias("days"),
    )


def prices_at(c: Catalogue, asks: DataFrame, asked: str = "as_of") -> DataFrame:
    """``asks`` (entity_id, plan_name and a date) with the price that held at that date and when it was recorded.

    A snapshot of the same day counts.  Both are NULL where the plan has no snapshot that early.
    """
    daily = daily_prices(c.price_log)
    answers = as_of(asks, daily, PLAN, asked, "recorded_date", ["price", "recorded_date"])
    same = [asks[k].eqNullSafe(answers[k]) for k in (*PLAN, asked)]
    return asks.join(answers, same, "left").select(asks["*"], "price", "recorded_date")


def prices_on_dates(c: Catalogue, dates: Sequence[date]) -> DataFrame:
    """The price of every plan in the log on each of the ``dates``, as ``prices_at``.

    A few dates are a few aggregates over a plan's days, which need no sorting, no window and no join; more of them are asked like any others.
    """
    days = sorted(set(dates))
    if not 0 < len(days) <= FEW_DATES:
        asks = c.price_log.select(*PLAN).distinct()
        return prices_at(c, asks.select("*", F.explode(F.array(*(F.lit(d) for d in days)).cast("array<date>")).alias("as_of")))
    # Snapshots without a date make a row of their plan, which is in no date's aggregates.
    daily = c.price_log.groupBy(*PLAN, "recorded_date").agg(F.max_by("price", "log_id").alias("price"))
    found = []
    for n, d in enumerate(days):
        until = F.when(F.col("recorded_date") <= F.lit(d), F.col("recorded_date"))
        found += [F.max_by("price", until).alias(f"price_{n}"), F.max(until).alias(f"day_{n}")]
    each = F.array(
        *(F.struct(F.lit(d).alias("as_of"), F.col(f"price_{n}").alias("price"), F.col(f"day_{n}").alias("recorded_date")) for n, d in enumerate(days))
    )
    return daily.groupBy(*PLAN).agg(*found).select(*PLAN, F.inline(each))


def price_by_month(c: Catalogue) -> DataFrame:
    """A plan's price at the end of every month from its first to its last snapshot.

    Months without a snapshot carry the price of the month before; ``is_recorded`` tells which have one.
    """
    daily = daily_prices(c.price_log).withColumn("month", F.trunc("recorded_date", "month"))
    months = last_per_time(daily, PLAN, "month", "recorded_date", "price")
    spells = with_neighbour(months, PLAN, "month", ["month"], "next", backwards=True)
    last = F.coalesce(F.add_months("next.month", -1), F.col("month"))
    calendar = F.sequence("month", last, F.expr("interval 1 month"))
    return spells.select(*PLAN, "price", F.posexplode(calendar).alias("since", "month")).select(
        *PLAN, "month", "price", (F.col("since") == 0).alias("is_recorded")
    )


def price_trends(c: Catalogue) -> DataFrame:
    """The straight line through each plan's monthly prices: months with a price, slope a month, first and last price.

    Sums of squares and products are combined inside each task, so the line needs no plan's months in one place.
    A plan with one priced month has no slope, and no change.
    """
    at = F.year("month") * 12 + F.month("month")
    priced = price_by_month(c).filter(F.col("price").isNotNull()).withColumn("at", at.cast("double"))
    lines = priced.groupBy(*PLAN).agg(
        F.count("*").alias("months"),
        F.regr_slope("price", "at").alias("slope"),
        F.min_by("price", "month").alias("first_price"),
        F.max_by("price", "month").alias("last_price"),
    )
    several = F.col("months") > 1
    change = percent(F.col("last_price") - F.col("first_price"), F.col("first_price"))
    return lines.select(
        *PLAN,
        "months",
        F.when(several, half_up(F.col("slope"), 6)).alias("slope_per_month"),
        "first_price",
        "last_price",
        F.when(several, half_up(change, 2)).alias("change_pct"),
    )
