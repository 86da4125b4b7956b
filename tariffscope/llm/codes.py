"""Vector codes: product quantisation in whole numbers, with exact products from float64 matrix multiplication.

A vector's components become whole numbers, ``floor(SCALE * x)``; it is cut into ``PARTS`` equal parts, and each
part is replaced by the number of the nearest entry of its position's codebook. Codebooks start as the parts of the
vectors with the smallest ids and move, round by round, to the means of the parts assigned to them, rounded down.

Distances are exact. A part's nearest entry has the least ``|c|^2 - 2 v.c``; the products ``v.c`` of a batch are one
matrix multiplication per part position. Whole numbers are broken into limbs of so few bits that every sum of limbs'
products stays below 2^53, where float64 is exact whatever order BLAS adds in. The limbs' products are put together in
int64, and the first of equal distances wins. A limb that is zero throughout a batch is left out.

A task reduces its rows to one row per codebook entry, count and component sums, before anything is shuffled; only
the codebooks themselves (parts x entries x width numbers, whatever the table's size) pass the driver. Rows of a hot label are
summed in each task first, and the sums are broadcast only if they were counted to be few.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those of another
length than most (of equally many, the longer; a length must be a multiple of ``PARTS``, so empty vectors have empty parts and no error);
repeated rows and repeated ids are vectors of their own; the first entries go by id, null ids last, then by components;
with fewer rows than entries, there are as many entries as rows; null labels count as one label; other columns are
ignored; an empty table gives an empty result. Components so large that a vector's error could pass 2^63 raise a
ValueError: the result could not be held in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffscope.llm.common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
EXACT_BITS = 53
# Stands for whole numbers that an int64 does not hold; the caller refuses them.
HUGE = 1 << 62
BROADCAST_LABELS = 500_000


def limb_bits(width: int) -> int:
    """Bits of a limb, so that ``width`` products of two limbs add up to less than 2^53. Limbs are balanced: of b bits, they
    lie within 2^(b-1) of zero."""
    return (EXACT_BITS + 1 - max(width - 1, 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """(shift, limb) pairs of an int64 array, limbs as float64: values = sum of limb * 2^shift. Zero limbs are left out."""
    found, shift, half = [], 0, np.int64(1 << (bits - 1))
    while values.any():
        low = ((values + half) & np.int64((1 << bits) - 1)) - half
        if low.any():
            found.append((shift, low.astype(np.float64)))
        values = (values - low) >> np.int64(bits)
        shift += bits
    return found


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact where the result fits an int64."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for shift_a, limb_a in limbs(a, bits):
        for shift_b, limb_b in right:
            if shift_a + shift_b < 64:  # beyond, the product could not fit
                total += (limb_a @ limb_b.T).astype(np.int64) << np.int64(shift_a + shift_b)
    return total


def nearest(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors (n, dims) and codebooks (parts, entries, width): indexes (n, parts) of the nearest entries, the first
    of equal ones, and the squared distances to them."""
    parts, _, width = codebooks.shape
    codes = np.zeros((len(vectors), parts), np.int64)
    errors = np.zeros((len(vectors), parts), np.int64)
    rows = np.arange(len(vectors))
    for p in range(parts):
        part, book = vectors[:, p * width : (p + 1) * width], codebooks[p]
        score = (book * book).sum(axis=1)[None, :] - 2 * exact_products(part, book)
        codes[:, p] = score.argmin(axis=1)
        errors[:, p] = score[rows, codes[:, p]] + (part * part).sum(axis=1)
    return codes, errors


def _whole_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors have finite components only, these as whole numbers."""
    for batch in batches:
        lists = batch.column("vector")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        # A null list has no size but may have had values; flatten() leaves those out, so sizes are taken from the lists.
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes)
        good = ~flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        good &= np.isfinite(values)
        ends = np.cumsum(sizes)
        bad_before = np.concatenate([[0], np.cumsum(~good)])
        kept = lists.is_valid().to_numpy(zero_copy_only=False) & (bad_before[ends] == bad_before[ends - sizes])
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(values * SCALE)
            scaled = np.where(good, np.clip(np.nan_to_num(scaled), -float(HUGE), float(HUGE)), 0).astype(np.int64)
        index = np.flatnonzero(kept)
        of_kept = np.repeat(kept, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes[index])]).astype(np.int32)
        vector = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled[of_kept]))
        picked = batch.select(["vec_id", "label"]).take(pa.array(index))
        yield pa.RecordBatch.from_arrays([*picked.columns, vector], ["vec_id", "label", "vector"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _moves(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's count and component sums for each entry that any of its parts is nearest to."""
    parts, entries, width = codebooks.shape
    counts = np.zeros((parts, entries), np.int64)
    sums = np.zeros(codebooks.shape, np.int64)
    for batch in batches:
        vectors = _matrix(batch.column("vector"), parts * width)
        codes, _ = nearest(vectors, codebooks)
        for p in range(parts):
            counts[p] += np.bincount(codes[:, p], minlength=entries)
            np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
    part, entry = np.nonzero(counts)
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(sums[part, entry].ravel())
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), lists], ["part", "entry", "n", "sums"]
    )


def _coded(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = codebooks.shape
    for batch in batches:
        codes, errors = nearest(_matrix(batch.column("vector"), parts * width), codebooks)
        text = codes.astype(np.uint8).tobytes().hex()
        step = 2 * parts
        yield pa.RecordBatch.from_arrays(
            [
                *batch.select(["vec_id", "label"]).columns,
                pa.array([text[i : i + step] for i in range(0, step * len(codes), step)], pa.string()),
                pa.array(errors.sum(axis=1)),
            ],
            ["vec_id", "label", "code", "error"],
        )


def whole_vectors(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Stored vec_id, label and vector (whole numbers) of the vectors that take part, and their number of components."""
    label = rows.schema["label"].dataType
    schema = T.StructType([
        T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("label", label),
        T.StructField("vector", T.ArrayType(T.LongType())),
    ])
    vectors = scratch.keep(rows.select("vec_id", "label", "vector").mapInArrow(_whole_vectors, schema), "whole")
    largest = F.aggregate("vector", F.lit(0).cast("long"), lambda most, x: F.greatest(most, F.abs(x)))
    lengths = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("largest"))
    usual = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return vectors, 0
    if usual.dims % PARTS:
        raise ValueError(f"vectors of {usual.dims} components don't have {PARTS} equal parts")
    if usual.dims * (2 * usual.largest) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {usual.largest / SCALE} in size: a vector's error may pass a long")
    return vectors.where(F.size("vector") == usual.dims), usual.dims


def codebooks_of(vectors: DataFrame, dims: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` of assigning and moving."""
    width = dims // PARTS
    firsts = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    books = np.array([row.vector for row in firsts], np.int64).reshape(len(firsts), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = (
            vectors.select("vector")
            .mapInArrow(lambda batches, now=books: _moves(batches, now), "part long, entry long, n long, sums array<long>")
            .groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
        )
        after = books.copy()
        for part, entry, n, *sums in moved.collect():  # a row per entry at most
            after[part, entry] = [s // n for s in sums]
        if (after == books).all():  # further rounds would change nothing
            break
        books = after
    return books


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of ``rows`` (vec_id, label, vector)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "codes")
    vectors, dims = whole_vectors(rows, scratch)
    books = codebooks_of(vectors, dims) if dims else np.zeros((PARTS, 0 if vectors.isEmpty() else 1, 0), np.int64)
    label = rows.schema["label"].dataType
    schema = T.StructType([*vectors.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = scratch.keep(vectors.mapInArrow(lambda batches: _coded(batches, books), schema), "coded")
    scratch.drop("whole")
    sums = scratch.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "sums")
    few = sums.count() <= BROADCAST_LABELS
    return (
        coded.join(F.broadcast(sums) if few else sums, coded.label.eqNullSafe(sums.label))
        .select("vec_id", coded.label, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )
