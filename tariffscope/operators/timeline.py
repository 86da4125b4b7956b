"""Ordered lookups along each key's time line, without a whole time line in one window.

Time is cut into spans (calendar years, unless given).  A window holds one span of one key;
what earlier spans leave behind comes in as one more row at the span's beginning, found
from one row per key and span.  All keys may be null; null keys are equal.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Span = Callable[[Column], Column]

_SPAN, _TIME, _VALUE, _KIND = "__span", "__time", "__value", "__kind"
# At the same time, what enters a span comes first, then what is known, then who asks.
_ENTERS, _KNOWN, _ASKS = 0, 1, 2


def _with_entering(rows: DataFrame, keys: list[str], backwards: bool) -> DataFrame:
    """Rows (keys, span, time, value, kind) and, at each span's beginning, the last value before it."""
    known = F.when(F.col(_VALUE).isNotNull(), F.col(_TIME))
    last = (F.min_by if backwards else F.max_by)(_VALUE, known)
    ends = rows.groupBy(*keys, _SPAN).agg(last.alias("last"))
    order = F.desc(_SPAN) if backwards else F.asc(_SPAN)
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    entering = (
        ends.withColumn(_VALUE, F.last("last", ignorenulls=True).over(earlier))
        .filter(F.col(_VALUE).isNotNull())
        .withColumn(_KIND, F.lit(_ENTERS))
    )
    return rows.unionByName(entering.drop("last"), allowMissingColumns=True)


def _within(keys: list[str], backwards: bool):
    """The order within a span: first what enters it."""
    time = F.desc_nulls_first(_TIME) if backwards else F.asc_nulls_first(_TIME)
    return Window.partitionBy(*keys, _SPAN).orderBy(time, _KIND)


def with_neighbour(
    rows: DataFrame,
    keys: list[str],
    time: str,
    values: list[str],
    name: str = "previous",
    backwards: bool = False,
    span: Span = F.year,
) -> DataFrame:
    """``rows`` and a struct of the ``values`` of the row before (``backwards``: after) in its key's time line.

    A key holds each time at most once.  The struct is null at a time line's end, and only there.  Rows without
    a time are left out.
    """
    timed = rows.filter(F.col(time).isNotNull()).withColumns(
        {
            _SPAN: span(F.col(time)),
            _TIME: F.col(time),
            _VALUE: F.struct(*values),
            _KIND: F.lit(_KNOWN),
        }
    )
    neighbour = F.lag(_VALUE).over(_within(keys, backwards))
    return (
        _with_entering(timed, keys, backwards)
        .withColumn(name, neighbour)
        .filter(F.col(_KIND) == _KNOWN)
        .drop(_SPAN, _TIME, _VALUE, _KIND)
    )


def as_of(
    asks: DataFrame,
    facts: DataFrame,
    keys: list[str],
    asked: str,
    time: str,
    values: list[str],
    span: Span = F.year,
) -> DataFrame:
    """Each distinct (keys, ``asked``) of ``asks`` with the ``values`` of the last fact up to and at that time.

    ``facts`` hold a key and time at most once (see ``last_per_time``).  Where no fact is that old, the
    values are null; asks without a time are left out.  Rows that ask alike ask once here: join the answer to
    them by keys and time.
    """
    wanted = asks.filter(F.col(asked).isNotNull()).select(*keys, F.col(asked).alias(_TIME)).distinct()
    wanted = wanted.withColumns({_VALUE: F.lit(None), _KIND: F.lit(_ASKS)})
    known = facts.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias(_TIME), F.struct(*values).alias(_VALUE), F.lit(_KNOWN).alias(_KIND)
    )
    both = known.unionByName(wanted).withColumn(_SPAN, span(F.col(_TIME)))
    so_far = _within(keys, False).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _with_entering(both, keys, False)
        .withColumn("fact", F.last(_VALUE, ignorenulls=True).over(so_far))
        .filter(F.col(_KIND) == _ASKS)
        .select(*keys, F.col(_TIME).alias(asked), *(F.col("fact").getField(v).alias(v) for v in values))
    )


def last_per_time(rows: DataFrame, keys: list[str], time: str, order: str, value: str) -> DataFrame:
    """keys, time, value: of rows of one key and time, the value of the one that is last by ``order``.

    Partial aggregates leave one row a task, key and time, however many rows a key has.
    """
    timed = rows.filter(F.col(time).isNotNull())
    return timed.groupBy(*keys, time).agg(F.max_by(value, order).alias(value))
