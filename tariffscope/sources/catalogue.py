"""A catalogue: the five role frames, and what is known about the category table's size."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table below this size, by Spark's own estimate, may be broadcast.
BROADCAST_BYTES = 10 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Spark's size estimate of the frame (file sizes for a scan; no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether Spark's estimate is below the limit; a size that can't be asked for isn't small."""
    return hasattr(df, "_jdf") and estimated_bytes(df) <= limit


@dataclass(frozen=True)
class Catalogue:
    """``category_is_small`` must come from a check of the category table's size.

    It lets joins against at most one row per category be broadcast.  Without it
    groups are joined by a shuffle, and rows as in ``operators.joins.join_lookup``.
    """

    category: DataFrame
    entity: DataFrame
    offer: DataFrame
    attribute: DataFrame
    price_log: DataFrame
    category_is_small: bool = False

    def per_category(self, df: DataFrame) -> DataFrame:
        """Mark a frame holding at most one row per row of ``category``."""
        return F.broadcast(df) if self.category_is_small else df

    @property
    def categories(self) -> DataFrame:
        return self.per_category(self.category)

    @property
    def roles(self) -> dict[str, DataFrame]:
        return {
            "category": self.category,
            "entity": self.entity,
            "offer": self.offer,
            "attribute": self.attribute,
            "price_log": self.price_log,
        }


def catalogue_of(roles: dict[str, DataFrame]) -> Catalogue:
    """A catalogue over role frames, checking the size of the category table."""
    return Catalogue(**roles, category_is_small=is_small(roles["category"]))
