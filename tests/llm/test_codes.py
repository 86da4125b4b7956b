"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tariffscope.llm import codes

SCHEMA = "vec_id long, label int, vector array<double>"


def brute(rows):
    """The same by the definition, in Python integers."""
    kept = [
        (i, label, [math.floor(codes.SCALE * x) for x in v])
        for i, label, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    width = len(kept[0][2]) // codes.PARTS
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(part(v, p)) for _, _, v in kept[: codes.ENTRIES]] for p in range(codes.PARTS)]

    def assign(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(part(v, p), c)) for c in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(codes.ROUNDS):
        moved = []
        for p in range(codes.PARTS):
            members = [[] for _ in books[p]]
            for _, _, v in kept:
                members[assign(v, p)[0]].append(part(v, p))
            moved.append([[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])])
        books = moved
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = []
    for i, label, v in kept:
        got = [assign(v, p) for p in range(codes.PARTS)]
        found.append((i, label, "".join(f"{c:02x}" for c, _ in got), sum(e for _, e in got)))
    by_label = {}
    for _, label, _, error in found:
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((i, l, c, e, by_label[l], sha) for i, l, c, e in found), key=repr)


def result(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in codes.compress(spark.createDataFrame(rows, schema)).collect()), key=repr)


def vectors(n, dims, scale=1.0, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0, 1, 2]), [rng.gauss(0, scale) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims, scale", [(16, 0.3), (24, 3000.0), (8, 1.0)])
def test_equals_brute_force(spark, dims, scale):
    rows = vectors(150, dims, scale)
    random.Random(1).shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = vectors(40, 8)
    rows += [(None, None, [0.5] * 8), (7, 3, [0.25] * 8), (7, 3, [0.25] * 8), (7, 3, [0.25] * 8)]
    rows += [(90, 1, None), (91, 1, [0.1] * 7 + [None]), (92, 1, [float("nan")] * 8), (93, 1, [float("-inf")] + [0.0] * 7)]
    assert result(spark, rows) == brute(rows)


def test_few_rows_empty_tables_and_other_lengths(spark):
    rows = vectors(5, 8)
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, 1, None)]) == []
    assert result(spark, [*rows, (9, 1, [1.0] * 16), (8, 1, [])]) == brute(rows)
    assert [r[:4] for r in result(spark, [(1, 2, []), (2, 2, [])])] == [(1, 2, "00" * 8, 0), (2, 2, "00" * 8, 0)]


def test_single_precision_and_other_columns(spark):
    rows = [(i, label, v, "x") for i, label, v in vectors(30, 16)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>, code string")
    plain = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v, _ in rows]
    assert sorted((tuple(r) for r in codes.compress(frame).collect()), key=repr) == brute(plain)


def test_errors_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError):
        result(spark, [(1, 1, [1e30] * 8)])
    with pytest.raises(ValueError):
        result(spark, [(1, 1, [1.0] * 9)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 40), st.randoms(use_true_random=False))
def test_products_are_exact(width, bits, rng):
    big = 1 << min(bits, 60 // 2 - width.bit_length() // 2)
    a = [[rng.randint(-big, big) for _ in range(width)] for _ in range(4)]
    b = [[rng.randint(-big, big) for _ in range(width)] for _ in range(3)]
    b[0] = a[0]
    expected = [[sum(x * y for x, y in zip(r, c)) for c in b] for r in a]
    assert codes.exact_products(np.array(a, np.int64), np.array(b, np.int64)).tolist() == expected


@given(st.integers(1, 5000))
def test_limbs_stay_exact(width):
    assert width * (1 << (codes.limb_bits(width) - 1)) ** 2 <= 1 << (codes.EXACT_BITS - 1)


@given(st.lists(st.integers(-(1 << 61), 1 << 61), min_size=1), st.integers(2, 26))
def test_limbs_add_up(values, bits):
    parts = codes.limbs(np.array(values, np.int64), bits)
    assert [sum(int(limb[i]) << shift for shift, limb in parts) for i in range(len(values))] == values
