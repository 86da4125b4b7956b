"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask looks at some of the token positions in a window and ignores the others, so a hit survives
substitutions at those. Hashes of every window of every benchmark item under a few fixed masks, chosen so that no
overlap is without a hit, are joined with those of all training windows. A hit fixes how an item lies on a document; along that alignment, the
``WINDOW`` tokens with the most agreement decide: a share of ``SIMILARITY`` or more equal tokens is an overlap.

The benchmark's hashes are broadcast only where they number at most ``BROADCAST_HASHES``; then
documents are not shuffled at all, so a passage in a third of all documents costs each task its own
hits. Larger benchmarks are joined by a shuffle.

Defined results: texts are compared as lower-case runs of letters and digits; null or empty texts and
items match nothing; an overlap with an item shorter than the window is judged over
the whole item; repeated documents or items give one row for each pair of ids (a null id is
one id); the best-placed of several equal overlaps is the first; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch, document_key, once, unused

# Items of SPAN tokens and more have the masks of SPAN.
SPAN = 12
# 1 is a position that is looked at; and the lengths of the items that a mask is for. An item's masks hit every
# placement of as many substitutions as the verification allows: of four blocks of tokens two substitutions leave
# two equal, which are side by side, one apart or two apart.
MASKS = {
    "111111": (12,), "111000111": (12,), "111000000111": (12,),
    "1111": (4, 6, 7, 8, 9, 10, 11), "110011": (10, 11), "11000011": (10, 11),
    "11011": (5, 6, 7, 8, 9), "111": (3, 5), "11": (2,), "1": (1,),
}
WINDOW, SIMILARITY = 13, 0.8
BROADCAST_HASHES = 2_000_000


def token_hashes(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.split(F.when(words != "", words), " "), lambda word: F.xxhash64(word))


def _hashes(tokens: str, mask: str) -> Column:
    """Hashes of every window under a mask, none if there are too few tokens."""
    looked = [i for i, bit in enumerate(mask) if bit == "1"]
    places = F.sequence(F.lit(0), F.size(tokens) - len(mask))
    places = F.when(F.size(tokens) >= len(mask), places).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.xxhash64(F.lit(mask), *(F.get(F.col(tokens), p + i) for i in looked)))


def _windows(frame: DataFrame, tokens: str, masks: list[str], *columns: str) -> DataFrame:
    """``columns`` with ``seed`` and ``place`` of every window and mask."""
    # Token lists stay out of the rows that windows make, which are many.
    long_enough = frame.where(F.size(tokens) >= min(map(len, masks), default=1)).select(
        *columns, F.size(tokens).alias("n_tokens"), F.concat(F.array().cast("array<bigint>"), *(_hashes(tokens, m) for m in masks)).alias("seeds")
    )
    # The masks' lists lie one after the other.
    place, before = F.col("at"), F.lit(0)
    for mask in masks:
        place = F.when(F.col("at") >= before, F.col("at") - before).otherwise(place)
        before = before + F.greatest(F.col("n_tokens") - len(mask) + 1, F.lit(0))
    return long_enough.select(*columns, "n_tokens", F.posexplode_outer("seeds").alias("at", "seed")).where("seed is not null").select(
        *columns, "seed", place.alias("place")
    )


def _joined(large: DataFrame, small: DataFrame, on: list[str], most: int) -> DataFrame:
    """An inner join, ``small`` broadcast if it has at most ``most`` rows."""
    return large.join(F.broadcast(small) if small.count() <= most else small, on)


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document (doc_id, text) and item (item_id, text) that overlap: ``doc_start`` and ``item_start``,
    the tokens where the best window starts, its ``n_tokens`` and how many of them are ``n_equal``."""
    scratch = Scratch(documents.sparkSession, "decontam")
    tests = scratch.keep(
        benchmark.select("item_id", token_hashes(F.col("text")).alias("item_tokens")).distinct()
        .withColumn("item", F.xxhash64("item_id", "item_tokens")), "tests",
    )
    # Of each length, items have their own masks; documents have those of all lengths that there are.
    length = F.least(F.size("item_tokens"), F.lit(SPAN))
    lengths = {r[0] for r in tests.where("size(item_tokens) > 0").select(length).distinct().collect()}
    masks = {mask: found for mask, of in MASKS.items() if (found := sorted(lengths & set(of)))}
    seeds = _windows(tests.limit(0), "item_tokens", [], "item")
    for mask, found in masks.items():
        seeds = seeds.union(_windows(tests.where(length.isin(found)), "item_tokens", [mask], "item"))
    seeds = scratch.keep(seeds.withColumnRenamed("place", "item_place"), "seeds")
    keys = document_key()
    training = once(documents.select(*keys, "text"), "doc_tokens", token_hashes(F.col("text")))
    hits = _joined(_windows(training, "doc_tokens", list(masks), "doc", "doc_hash"), seeds, ["seed"], BROADCAST_HASHES)
    # One row per document, item and alignment, however many windows of it hit: the item's first token lies on the
    # document's token ``shift``.
    hits = hits.select("doc", "doc_hash", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = _joined(scratch.keep(hits, "hits"), tests, ["item"], BROADCAST_HASHES // 100)
    hits = _joined(documents.select("doc_id", *keys, "text"), hits, ["doc", "doc_hash"], BROADCAST_HASHES // 100)
    hits = once(hits, "doc_tokens", token_hashes(F.col("text")))
    # What of the item lies inside the document:
    hits = hits.withColumn("skipped", F.greatest(-F.col("shift"), F.lit(0)))
    hits = hits.withColumn(
        "n",
        F.least(F.size("item_tokens"), F.size("doc_tokens") - F.col("shift")) - F.col("skipped"),
    )
    equal = F.zip_with(
        F.slice("doc_tokens", F.col("shift") + F.col("skipped") + 1, F.col("n")),
        F.slice("item_tokens", F.col("skipped") + 1, F.col("n")),
        lambda a, b: (a == b).cast("int"),
    )
    aligned = hits.select("doc_id", "item_id", "shift", "skipped", "n", F.size("item_tokens").alias("of"), equal.alias("equal"))
    width = F.least(F.lit(WINDOW), F.col("of"), F.col("n"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("width")),
        lambda i: F.struct(
            F.aggregate(F.slice("equals", i + 1, F.col("width")), F.lit(0), lambda a, b: a + b).alias("n_equal"),
            (-i).alias("start"),
        ),
    )
    best = once(once(aligned, "equals", F.col("equal")).withColumn("width", width), "best", F.array_max(windows))
    best = best.where(F.col("best.n_equal") >= SIMILARITY * F.least(F.lit(WINDOW), F.col("of")))
    start = -F.col("best.start") + F.col("skipped")
    order = F.struct(
        F.col("best.n_equal").alias("n_equal"), (-(start + F.col("shift"))).alias("doc"), (-start).alias("item"),
        F.col("width").alias("width"),
    )
    return best.groupBy("doc_id", "item_id").agg(F.max(order).alias("m")).select(
        "doc_id", "item_id", (-F.col("m.doc")).alias("doc_start"), (-F.col("m.item")).alias("item_start"),
        F.col("m.width").alias("n_tokens"), F.col("m.n_equal").alias("n_equal"),
    )


def without_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` that overlap with no item; of ids that rows share, all go if one does."""
    name = unused(documents.columns, "found_id")
    found = overlaps(documents, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
