"""First-wins loading: of rows that clash on a unique key, the first one stays.

Rows already stored win over new ones.  With several unique keys a row counts
only if it is kept, so whether a row stays can depend on a chain of others; this
is settled in rounds, each keeping every row that is first under all its keys
and dropping the rows that clash with those.  A round settles at least the first
row of every chain, and rows of long chains are few, so rounds are few.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .roles import Role

_POSITION, _KEPT = "__position", "__kept"
_Keys = tuple[tuple[str, ...], ...]


def _first_per(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of each group, by an aggregate that combines before the shuffle."""
    everything = F.struct(*rows.columns)
    return rows.groupBy(*columns).agg(F.min_by(everything, _POSITION).alias("row")).select("row.*")


def _without_clashes(rows: DataFrame, kept: DataFrame, keys: _Keys) -> DataFrame:
    for key in keys:
        rows = rows.join(kept.select(*key).distinct(), list(key), "left_anti")
    return rows


def first_wins(new: DataFrame, stored: DataFrame | None, keys: _Keys, order_by: list[str]) -> DataFrame:
    """The rows of ``new`` to add to ``stored``; ``order_by`` is the order they come in.

    Rows with a missing key are not added.  Without keys every row is added.
    With several keys, rounds are cut by ``checkpoint()``, which needs a checkpoint
    folder (see ``session.ensure_checkpoint_dir``).
    """
    if not keys:
        return new
    key_columns = sorted({column for key in keys for column in key})
    position = F.struct(*(F.col(c) for c in [*order_by, *key_columns]))
    rows = new.dropna(subset=key_columns).withColumn(_POSITION, position)
    rows = _first_per(rows, key_columns)  # copies go here, before anything is joined
    if stored is not None:
        rows = _without_clashes(rows, stored, keys)
    if len(keys) == 1:
        return rows.select(*new.columns)

    rows, kept = checkpointed(rows), None
    while not rows.isEmpty():
        winners = [_first_per(rows, list(key)) for key in keys]
        first_under_all = reduce(
            lambda a, b: a.join(b.select(*key_columns), key_columns, "left_semi"), winners
        )
        # One table a round: what is kept so far, and what is still open.
        winning = first_under_all.withColumn(_KEPT, F.lit(True))
        rest = _without_clashes(rows, first_under_all, keys).withColumn(_KEPT, F.lit(False))
        settled = checkpointed(winning.unionByName(rest))
        won, rows = (settled.filter(F.col(_KEPT) == is_won).drop(_KEPT) for is_won in (True, False))
        kept = won if kept is None else kept.unionByName(won)
    return (rows if kept is None else kept).select(*new.columns)


def load_table(
    new: DataFrame, stored: DataFrame | None, role: Role, path: str, order_by: list[str]
) -> None:
    """Append to the Parquet table at ``path`` the rows its keys admit.

    ``stored`` is the table as it is now (None: it does not exist yet).  Roles without
    keys take every row, so loading the same rows twice stores them twice.
    """
    first_wins(new, stored, role.keys, order_by).write.mode("append").parquet(path)
