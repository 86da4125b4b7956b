"""Conversation repair against a search over all edits, row by row."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tariffscope.llm import repair
from tariffscope.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256().hexdigest()


def brute_damage(rows):
    found = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        found += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return found


def cheapest(rows):
    """(cost, audit, repaired rows) by trying everything; rows are (role, text, fault)."""

    # Insertions may repeat, so a shortest path over (row, state) with at most three insertions in a row.
    @functools.cache
    def solve(i, given, inserted):
        state = {"": 0, "s": 1, "u": 2, "a": 3}[given]
        need = "a" if state == 2 else "u"
        full = {"u": "user", "a": "assistant"}[need]
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(cost, edit, row, rest):
            if rest is not None:
                options.append((cost + rest[0], edit + rest[1], row + rest[2]))

        if inserted < 3:
            add(5, "I", ((full, ""),), solve(i, need, inserted + 1))
        if i < len(rows):
            role, text, fault = rows[i]
            add(2, "D", (), solve(i + 1, given, 0))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == need or (role[:1] == "s" and state == 0):
                    add(more, "K", ((role, text),), solve(i + 1, role[:1], 0))
                add(1 + more, "R", ((full, text),), solve(i + 1, need, 0))
        return min(options, key=lambda o: o[:2]) if options else None

    return solve(0, "", 0)


def brute(rows):
    kept, result = {}, []
    for row in brute_damage(rows):
        kept.setdefault(row[0], []).append(row)
    for conv in {r[0] for r in rows}:
        mine = sorted(kept.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if not mine:
            result.append((conv, 0, 0, 0, 0, 0, 0, "", EMPTY))
            continue
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in mine:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, left = cheapest(tuple(judged))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        result.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return sorted(result, key=repr)


def result(spark, rows):
    return sorted((tuple(r) for r in repair.assess(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def conversations(n, seed, turns=9):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no end", "", " \t", "Why? ", "x.\n", " ", "Done.", "ok"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "u"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, turns)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randint(0, 9999)}."
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, None if rng.random() < 0.05 else text))
    return rows


def test_equals_brute_force(spark):
    rows = conversations(250, 1)
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hello!"), (None, None, None, None)]
    rows += [(900, 5, "user", "Twice.")] * 3 + [(900, 6, "assistant", "Twice.")] * 2
    random.Random(2).shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_a_conversation_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    rows = conversations(60, 3, turns=12) + [(None, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(40)]
    assert result(spark, rows) == brute(rows)


def test_one_conversation_over_all_tasks(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["So.", "And", f"{i}!"])) for i in range(120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        scratch = Scratch(spark, "test")
        assert repair.pieces_of(repair.placed(frame, scratch), scratch).count() > 1
        assert result(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_are_counted_not_moved(spark):
    rows = [(1, 1, "user", "Same.")] * 120 + [(1, 2, "assistant", "Answer.")]
    assert result(spark, rows) == brute(rows)


def test_all_rows_dropped_empty_tables_and_long_texts(spark):
    dropped = [(c, t) for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Gone.") for c, t in dropped]
    assert [r[1:] for r in result(spark, rows)] == [(0, 0, 0, 0, 0, 0, "", EMPTY)] * 3
    assert result(spark, []) == []
    long = [(1, 1, "user", "word " * 100_000 + "."), (1, 2, "assistant", " " * 100_000), (1, 3, "assistant", "?" * 50_000)]
    assert result(spark, long) == brute(long)


def test_other_columns_are_ignored(spark):
    rows = conversations(20, 8)
    extra = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA + ", at int, kind string")
    assert sorted((tuple(r) for r in repair.assess(extra).collect()), key=repr) == brute(rows)


def test_repaired_rows_are_legal(spark):
    rows = conversations(80, 5)
    undamaged = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for r in repair.repaired(undamaged).orderBy("conv_id", "place").collect():
        kept.setdefault(r.conv_id, []).append(r)
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    assert len(kept) > 40
    for found in kept.values():
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in found))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, repair.SYMBOLS - 1), max_size=14))
def test_blocks_of_any_length_agree_with_the_search(symbols):
    rows = tuple(
        (("system", "user", "assistant", "tool")[min(s // 2, 3)], str(i), "blank" if s == repair.GONE else "truncated" if s % 2 else "")
        for i, s in enumerate(symbols)
    )
    cost, audit, _ = cheapest(rows)
    for block in (1, 2, 3):
        tables = _tables(block)
        if symbols:
            edits, _, found = tables.repair(np.array(symbols), 0, 0, True)
            assert (found, "".join(edits)) == (cost, audit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, repair.SYMBOLS - 1), min_size=2, max_size=30), st.data())
def test_pieces_chain(symbols, data):
    tables, cut = _tables(3), data.draw(st.integers(1, len(symbols) - 1))
    whole, first, second = (np.array(s) for s in (symbols, symbols[:cut], symbols[cut:]))
    left, leave = tables.reduce(first)
    right_left, right_leave = tables.reduce(second)
    all_left, all_leave = tables.reduce(whole)
    assert (left[right_left] == all_left).all()
    state = leave[right_left[0], 0]
    assert right_leave[0, state] == all_leave[0, 0]
    one = tables.repair(first, int(right_left[0]), 0, False)
    two = tables.repair(second, 0, int(state), True)
    both = tables.repair(whole, 0, 0, True)
    assert (one[0] + two[0], one[1] + two[1], one[2] + two[2]) == both


@functools.cache
def _tables(block):
    return repair.Tables(block)


def test_vectors_are_few():
    assert len(repair.tables().vectors) < 64


@pytest.mark.parametrize("block", [1, 2, 4])
def test_block_tables_equal_single_steps(block):
    tables, rng = _tables(block), random.Random(block)
    for _ in range(200):
        symbols = [rng.randrange(repair.SYMBOLS) for _ in range(block)]
        number = sum(s * repair.SYMBOLS**i for i, s in enumerate(reversed(symbols)))
        for vector in range(len(tables.vectors)):
            at, cost = vector, 0
            for symbol in reversed(symbols):
                cost, at = cost + tables.add[at, symbol], tables.next[at, symbol]
            assert (tables.block_next[vector, number], tables.block_add[vector, number]) == (at, cost)
