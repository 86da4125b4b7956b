"""Offers' highlights: a JSON array of short texts, kept as text in ``offer.features``.

Text that is no JSON array is malformed and has no highlights.  Elements are trimmed, null and blank
ones left out; numbers, truth values and nested JSON count as their text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up, percent, ratio
from ..operators.shares import value_shares
from ..sources.catalogue import Catalogue

# What an offer's text is: nothing, no array, an array of nothing, or one with highlights.
MISSING, MALFORMED, EMPTY, LISTED = "missing", "malformed", "empty", "listed"
_RECORD = "items array<string>, unreadable string"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable", "allowSingleQuotes": "false"}


def _read(text: Column) -> Column:
    """The text's array as ``items``, or, where it is none, the text as ``unreadable``."""
    return F.from_json(F.concat(F.lit('{"items":'), text, F.lit("}")), _RECORD, _OPTIONS)


def with_highlights(offers: DataFrame) -> DataFrame:
    """``offers`` with ``highlights`` (trimmed, null and blank ones still in place) and ``highlight_status``."""
    text = F.col("features")
    # Text behind the array can pass for more of the record, but not for the end of a list as well.
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", {"allowSingleQuotes": "false"})
    whole = F.coalesce(F.size(alone) == 1, F.lit(False))
    items = F.transform(F.col("record.items"), lambda h: F.trim(h))
    told = F.filter(items, lambda h: h != "")
    status = (
        F.when(text.isNull() | (F.trim(text) == ""), MISSING)
        .when(~whole | F.col("record.unreadable").isNotNull(), MALFORMED)
        .when(F.col("record.items").isNull(), MISSING)
        .when(F.size(told) == 0, EMPTY)
        .otherwise(LISTED)
    )
    read = offers.withColumn("record", _read(text)).withColumn("highlight_status", status)
    return read.withColumn("highlights", F.when(F.col("highlight_status") == LISTED, items)).drop("record")


def offer_highlights(c: Catalogue) -> DataFrame:
    """One row per highlight of an offer, with its place in the offer's list, from 1."""
    listed = with_highlights(c.offer).select(
        "offer_id", "entity_id", "plan_name", F.posexplode("highlights").alias("at", "highlight")
    )
    told = listed.filter(F.col("highlight") != "")
    return told.select("offer_id", "entity_id", "plan_name", (F.col("at") + 1).alias("position"), "highlight")


def highlight_counts(c: Catalogue) -> DataFrame:
    """Offers and entities with each highlight, and the mean monthly price of those offers that have one.

    An offer that lists a highlight twice has it once.  Offers are combined by highlight and entity first, so
    counting entities takes no set of them in one place.
    """
    once = with_highlights(c.offer).select(
        "entity_id", "price_monthly", F.explode(F.array_distinct("highlights")).alias("highlight")
    )
    per_entity = (
        once.filter(F.col("highlight") != "")
        .groupBy("highlight", "entity_id")
        .agg(
            F.count("*").alias("offers"),
            F.count("price_monthly").alias("priced"),
            F.sum("price_monthly").alias("price"),
        )
    )
    counts = per_entity.groupBy("highlight").agg(
        F.sum("offers").alias("offer_count"),
        F.count("entity_id").alias("entity_count"),
        half_up(ratio(F.sum("price"), F.sum("priced")), 2).alias("avg_monthly_price"),
    )
    return counts.orderBy(F.desc("offer_count"), "highlight")


def highlight_formats(c: Catalogue) -> DataFrame:
    """How many offers' highlights are listed, empty, missing or malformed, and the percentage of all offers."""
    return value_shares(with_highlights(c.offer), "highlight_status").withColumnRenamed("count", "offer_count")
