"""Joining many rows to a table that holds each key once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalogue import is_small


# Parts, at most, that rows without a key are dealt to.
SALTS = 1 << 16
_SALT = "__salt"


def join_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", small: bool | None = None
) -> DataFrame:
    """``rows`` joined ("inner" or "left") to ``lookup``, which holds each key at most once.

    A lookup known to be small (``small``; None checks its size) is broadcast.  Beyond
    that, one key may hold a large part of all rows, which would all go to one task:
    adaptive execution, which ``session`` turns on, splits such partitions.  In a left join
    rows without a key, which could be as many, are dealt out by a hash of the row.  Rows are read once.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join_lookup cannot do a {how} join")
    if is_small(lookup) if small is None else small:
        return rows.join(F.broadcast(lookup), key, how)
    if how == "inner":
        return rows.filter(F.col(key).isNotNull()).join(lookup, key)
    dealt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0)
    salted = rows.withColumn(_SALT, dealt.cast("int"))
    # Always 0, but no literal: one would be moved out of the join's keys.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    return salted.join(lookup.withColumn(_SALT, zero), [key, _SALT], "left").drop(_SALT)
