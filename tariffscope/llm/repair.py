"""Repair of conversations' structure by cheapest edits, with block tables over normalised cost vectors.

A conversation's rows, in order, must come to give roles ``(s?(ua)+)?`` by their initials. Rows may be kept (free), given
another role, deleted, and empty rows inserted, at the costs below; faulty rows must go, and truncated ones cost more to keep.

The cheapest way from a row to the end, for each of four states (nothing yet, after s, after u, after a), is a vector
of four costs. Less its minimum it is one of a few dozen vectors, whatever the conversation's length. So for every such vector and every block of ``BLOCK`` row
symbols, what the vector becomes and what it adds is precomputed once; a conversation is then run through from its end, one lookup a
block. Blocks are afterwards expanded, each from the vector at its right border, in the opposite direction: at each row
the ASCII-least edit that keeps to the cheapest cost is taken. Edits' letters differ, so the first of all cheapest
edit sequences is found, whatever ties there are.

A conversation may hold any share of all rows. Rows are sorted over all tasks by range and numbered, so a long conversation lies in
several pieces; pieces are reduced to what they make of each vector and state, these small tables are chained, and then each piece is traced by itself.
Equal rows are counted before they are sorted. First occurrences are found by partial aggregates, not in windows.
Only ``digests``, whose results are one text and one hash for a whole conversation, reads a conversation's rows in one task: as a stream, in order.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are ordered by role, then by their text's first ``SORTED_CHARACTERS``
characters, then by its hash; equal rows stand next to each other; null conversation ids are one conversation; rows of any role but
those with initial s, u or a can't be kept as they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffscope.llm.common import Scratch

REROLE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
BLOCK = 4
SORTED_CHARACTERS = 64
# Rows of a piece at most, as a power of two.
PIECE_BITS = 20
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {"u": "user", "a": "assistant"}
SPACES = r"\x20\x09-\x0D"

STATES = 4
# The state that a user or assistant row leads to, where only one of the two may come next.
NEXT = (2, 2, 3, 2)
ROLE_OF_STATE = {2: "u", 3: "a"}
# Symbols: initial (s, u, a, other) * 2 + truncated; and rows that must go.
GONE = 8
SYMBOLS = 9


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for a row, without insertions; edits in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, extra = symbol // 2, KEEP_TRUNCATED * (symbol % 2)
        if initial == 0 and state == 0:
            found.append(("K", extra, 1))
        if initial in (1, 2) and NEXT[state] == initial + 1:
            found.append(("K", extra, NEXT[state]))
        found.append(("R", REROLE + extra, NEXT[state]))
    return found


class Tables:
    """What rows and blocks of rows make of cost vectors (to the end of the conversation) and states."""

    def __init__(self, block: int = BLOCK):
        end = self._with_inserts([0, np.inf, np.inf, 0])
        vectors, number, at = [end], {end: 0}, 0
        steps: list[list[tuple[int, int]]] = []
        while at < len(vectors):
            row = []
            for symbol in range(SYMBOLS):
                costs = self._before(vectors[at], symbol)
                low = min(costs)
                vector = tuple(c - low for c in costs)
                if vector not in number:
                    number[vector] = len(vectors)
                    vectors.append(vector)
                row.append((number[vector], low))
            steps.append(row)
            at += 1
        self.vectors = vectors
        self.next = np.array([[n for n, _ in row] for row in steps], np.int64)
        self.add = np.array([[a for _, a in row] for row in steps], np.int64)
        # For the vector after a row, its symbol and the state before it: the edits, the roles they give, and the state after it.
        self.edits = [
            [[self._trace(v, symbol, state) for state in range(STATES)] for symbol in range(SYMBOLS)] for v in vectors
        ]
        self.exit = np.array([[[e[2] for e in states] for states in symbols] for symbols in self.edits], np.int64)
        self.at_end = [self._trace_end(state) for state in range(STATES)]
        self.block = block
        self.block_next, self.block_add, self.block_exit = self._of_blocks(block)

    @staticmethod
    def _with_inserts(costs) -> tuple:
        """Costs where rows may be inserted first; more than two insertions in a row come back to a state."""
        once = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
        return tuple(int(min(c, INSERT + once[NEXT[s]])) for s, c in enumerate(once))

    def _row(self, after, symbol: int) -> list[int]:
        return [min(cost + after[to] for _, cost, to in _choices(symbol, state)) for state in range(STATES)]

    def _before(self, after, symbol: int) -> tuple:
        return self._with_inserts(self._row(after, symbol))

    def _trace(self, after, symbol: int, state: int) -> tuple[str, str, int]:
        edits, roles = "", ""
        before = self._before(after, symbol)
        while True:
            options = {edit: (cost + after[to], to) for edit, cost, to in _choices(symbol, state)}
            options["I"] = (INSERT + before[NEXT[state]], NEXT[state])
            edit = min(e for e, (cost, _) in options.items() if cost == before[state])
            state_after = options[edit][1]
            edits += edit
            roles += ROLE_OF_STATE[state_after] if edit in "IR" else "."
            state = state_after
            if edit != "I":
                return edits, roles, state

    def _trace_end(self, state: int) -> tuple[str, str]:
        edits, roles = "", ""
        while state in (1, 2):
            state = NEXT[state]
            edits, roles = edits + "I", roles + ROLE_OF_STATE[state]
        return edits, roles

    def _of_blocks(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector at a block's right border and each block (its symbols as a number, the first highest): the vector at its left
        border, the cost, and for each state before it the state after it."""
        n = len(self.vectors)
        following, cost, leave = self.next, self.add, self.exit
        for _ in range(length - 1):  # one more symbol in front
            left = self.next[following]  # (vector, block, symbol)
            more = cost[:, :, None] + self.add[following]
            entered = self.exit[following]  # (vector, block, symbol, state): the state after the new symbol
            rows = np.arange(n)[:, None, None, None]
            blocks = np.arange(following.shape[1])[None, :, None, None]
            left_exit = leave[rows, blocks, entered]
            order = (0, 2, 1)
            following = left.transpose(order).reshape(n, -1)
            cost = more.transpose(order).reshape(n, -1)
            leave = left_exit.transpose(0, 2, 1, 3).reshape(n, -1, STATES)
        return following, cost, leave

    def _parts(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """A piece's blocks, and the symbols behind the last whole one."""
        whole = len(symbols) // self.block * self.block
        weights = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        return (symbols[:whole].reshape(-1, self.block) @ weights).tolist(), symbols[whole:].tolist()

    def reduce(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector at a piece's right border: the one at its left, and for each state before it the state after it."""
        n = len(self.vectors)
        at, leave = np.arange(n), np.tile(np.arange(STATES), (n, 1))
        blocks, rest = self._parts(symbols)
        rows = np.arange(n)[:, None]
        for symbol in reversed(rest):
            leave = leave[rows, self.exit[at, symbol]]
            at = self.next[at, symbol]
        for block in reversed(blocks):
            leave = leave[rows, self.block_exit[at, block]]
            at = self.block_next[at, block]
        return at, leave

    def repair(self, symbols: np.ndarray, right: int, state: int, last: bool) -> tuple[list[str], list[str], int]:
        """Edits and roles for each row of a piece, from the vector at its right border and the state before it; and the cost
        to the end of the conversation, less what the vector at the right border holds."""
        blocks, rest = self._parts(symbols)
        cost, at = 0, right
        after = [0] * len(rest)
        for i in range(len(rest) - 1, -1, -1):
            after[i] = at
            cost += int(self.add[at, rest[i]])
            at = int(self.next[at, rest[i]])
        borders = [0] * len(blocks)
        for i in range(len(blocks) - 1, -1, -1):
            borders[i] = at
            cost += int(self.block_add[at, blocks[i]])
            at = int(self.block_next[at, blocks[i]])
        cost += self.vectors[at][state]
        edits, roles = [], []
        plain = symbols.tolist()
        for i, border in enumerate(borders):  # the block's own vectors, from its right border back to its second row
            part = plain[i * self.block : (i + 1) * self.block]
            inside = [border]
            for symbol in reversed(part[1:]):
                inside.append(int(self.next[inside[-1], symbol]))
            for symbol, vector in zip(part, reversed(inside)):
                edit, role, state = self.edits[vector][symbol][state]
                edits.append(edit)
                roles.append(role)
        for symbol, vector in zip(rest, after):
            edit, role, state = self.edits[vector][symbol][state]
            edits.append(edit)
            roles.append(role)
        if last:
            edit, role = self.at_end[state]
            edits[-1] += edit
            roles[-1] += role
        return edits, roles, cost - self.vectors[right][state]


@functools.cache
def tables() -> Tables:
    """One for each worker process."""
    return Tables()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with every twentieth row, by a checksum of id and turn, dropped, emptied, cut short of
    its sentence ends, repeated (``copies``) or made the user's. Nulls of role and text, and within the checksum, are one space."""
    space = F.lit(" ")
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(named) % 20
    text = F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind != 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _initial(role: Column | str) -> Column:
    return F.coalesce(*(F.when(F.startswith(role, F.lit(c)), i) for i, c in enumerate("sua")), F.lit(3))


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored rows in order (``at``), equal ones once with their number of ``copies``, and the ``fault`` of the first of these."""
    space = F.lit(" ")
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    counted = (
        rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.alias("copies"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        .withColumn("name", F.unhex(F.md5("text")))
    )
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = (
        counted.groupBy("conv_id", "role", "name").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(*(F.col(c).alias(f"first_{c}") for c in ("conv_id", "role", "name")), "first")
    )
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ("conv_id", "role", "name")]
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), BLANK)
        .when(F.col("first").isNotNull() & (turn != F.col("first")), DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), TRUNCATED)
        .otherwise(FINE)
    )
    order = ["conv_id", "turn", "role", "start", "name"]
    ordered = (
        counted.join(firsts, same, "left")
        .select("conv_id", "turn", "role", "text", "copies", "name", F.left("text", F.lit(SORTED_CHARACTERS)).alias("start"), fault.alias("fault"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    return scratch.keep(ordered.drop("name", "start"), "placed")


def pieces_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored conv_id, piece and its rows: (at, initial, fault, copies). A piece lies within one task's sorted rows."""
    row = F.struct("at", _initial("role").cast("byte").alias("initial"), F.col("fault").cast("byte").alias("fault"), "copies")
    pieces = rows.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return scratch.keep(pieces, "pieces")


def _symbols(initials: np.ndarray, faults: np.ndarray) -> np.ndarray:
    gone = (faults == BLANK) | (faults == DUPLICATE)
    return np.where(gone, GONE, initials.astype(np.int64) * 2 + (faults == TRUNCATED))


def _each_piece(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """at, initial, fault and copies of each piece's rows."""
    lists = batch.column("rows")
    flat, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
    columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
    for start, end in zip([0, *ends], ends):
        yield tuple(c[start:end] for c in columns)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, initials, faults, _ in _each_piece(batch):
            left, leave = tables().reduce(_symbols(initials, faults))
            found.append((left, leave.ravel(), int(initials[0]), int(initials[-1])))
        columns = list(zip(*found)) or [[]] * 4
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("piece"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["conv_id", "piece", "lefts", "leave", "first", "last"],
        )


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Pairs of initials su, ua and au."""
    return ((before == 0) & (after == 1)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1))


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """The vector at each piece's right border and the state before it; a row per piece of one conversation."""
    group = group.sort_values("piece", ignore_index=True)
    n = len(group)
    right, state, pairs, at, now = [0] * n, [0] * n, [0] * n, 0, 0
    for i in range(n - 1, -1, -1):
        right[i] = at
        at = int(group["lefts"][i][at])
    for i in range(n):
        state[i] = now
        now = int(group["leave"][i][right[i] * STATES + now])
        if i:
            pairs[i] = int(not _legal(np.array(group["last"][i - 1]), np.array(group["first"][i])))
    return pd.DataFrame(
        {"conv_id": group["conv_id"], "piece": group["piece"], "right": right, "state": state, "pairs": pairs, "is_last": [i == n - 1 for i in range(n)]}
    )


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and their roles for each row of each piece, with the piece's cost and illegal pairs."""
    for batch in batches:
        rows = []
        given = zip(*(batch.column(c).to_pylist() for c in ("right", "state", "pairs", "is_last")))
        for (at, initials, faults, copies), (right, state, pairs, last) in zip(_each_piece(batch), given):
            edits, roles, cost = tables().repair(_symbols(initials, faults), right, state, last)
            extra = int((copies - 1).sum())
            for i in np.flatnonzero(copies > 1).tolist():
                # Further copies go, right behind the first; what is inserted at the very end stays there.
                n, head = int(copies[i]) - 1, 1 + next(k for k, e in enumerate(edits[i]) if e != "I")
                edits[i] = edits[i][:head] + "D" * n + edits[i][head:]
                roles[i] = roles[i][:head] + "." * n + roles[i][head:]
            illegal = int((~_legal(initials[:-1], initials[1:])).sum()) + extra + pairs
            rows.append((cost + DELETE * extra, illegal, at, edits, roles))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["conv_id", "cost", "illegal", "at", "edits", "roles"],
        )


def traced(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored conv_id, cost, illegal and, as arrays, at, edits and roles of each piece."""
    conv = T.StructField("conv_id", pieces.schema["conv_id"].dataType)
    # A conversation of several pieces lies across the end of a task's rows or of 2^PIECE_BITS of them: these are few.
    long = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("long_id"))
    spread = pieces.join(long, pieces.conv_id.eqNullSafe(F.col("long_id")), "left_semi")
    reduced = spread.select("conv_id", "piece", "rows").mapInArrow(
        _reduced,
        T.StructType([
            conv, T.StructField("piece", T.LongType()), T.StructField("lefts", T.ArrayType(T.LongType())),
            T.StructField("leave", T.ArrayType(T.LongType())), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        ]),
    )
    chained = reduced.groupBy("conv_id").applyInPandas(
        _chained,
        T.StructType([
            conv, T.StructField("piece", T.LongType()), T.StructField("right", T.LongType()), T.StructField("state", T.LongType()),
            T.StructField("pairs", T.LongType()), T.StructField("is_last", T.BooleanType()),
        ]),
    )
    # A piece's number holds its task's, but one piece may hold several conversations' rows: both are needed.
    chained = chained.toDF("chained_id", "chained_piece", "right", "state", "pairs", "is_last")
    same = pieces.conv_id.eqNullSafe(F.col("chained_id")) & (pieces.piece == F.col("chained_piece"))
    given = pieces.join(chained, same, "left").select(
        "conv_id", "rows", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("right", "state", "pairs")),
        F.coalesce("is_last", F.lit(True)).alias("is_last"),
    )
    schema = T.StructType([
        conv, T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("at", T.ArrayType(T.LongType())),
        T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("roles", T.ArrayType(T.StringType())),
    ])
    return scratch.keep(given.mapInArrow(_traced, schema), "traced")


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``rows`` with their ``edits`` and ``roles``."""
    each = edits.select(F.explode(F.arrays_zip("at", "edits", "roles")).alias("e")).select("e.at", "e.edits", "e.roles")
    return rows.join(each, "at")


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, ``place`` (at, and number of the edit there), turn, role, text and the ``edit``
    that left it so; inserted rows have the turn of the row they were inserted at."""
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = placed(conversations, scratch)
    found = edited(rows, traced(pieces_of(rows, scratch), scratch))
    one = F.posexplode(F.split(F.regexp_replace("edits", "(.)(?=.)", "$1,"), ",")).alias("nth", "edit")
    by_role = F.substring("roles", F.col("nth") + 1, F.lit(1))
    return (
        found.select("*", one).where("edit != 'D'")
        .select(
            "conv_id", F.struct("at", "nth").alias("place"), "turn",
            F.when(F.col("edit") == "K", F.col("role")).when(by_role == "u", NAMES["u"]).otherwise(NAMES["a"]).alias("role"),
            F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit",
        )
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation; rows come in order."""
    names = ["conv_id", "audit", "repaired_sha256"]
    nothing = object()
    open_id, audit, sha, lines = nothing, [], None, 0
    for batch in batches:
        closed = []
        for conv_id, role, text, edits, roles in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edits", "roles"))):
            if open_id is nothing or conv_id != open_id:
                if open_id is not nothing:
                    closed.append((open_id, "".join(audit), sha.hexdigest()))
                open_id, audit, sha, lines = conv_id, [], hashlib.sha256(), 0
            audit.append(edits)
            for edit, given in zip(edits, roles):
                if edit != "D":
                    line = f"{role if edit == 'K' else NAMES[given]}:{'' if edit == 'I' else text}"
                    sha.update(("\n" + line if lines else line).encode())
                    lines += 1
        if closed:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*closed), (batch.schema.field("conv_id").type, pa.string(), pa.string()))], names
            )
    if open_id is not nothing:
        yield pa.RecordBatch.from_arrays(
            [pa.array([open_id], batch.schema.field("conv_id").type), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names
        )


def digests(found: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 from edited rows."""
    schema = T.StructType([found.schema["conv_id"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return (
        found.select("conv_id", "at", "role", "text", "edits", "roles")
        .repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at").mapInArrow(_digested, schema)
    )


def assess(conversations: DataFrame) -> DataFrame:
    """For each conv_id of ``conversations``, after ``damaged``: gaps between turns, rows by their first fault, illegal pairs of
    neighbours, the cheapest repair's cost, its edits, and a hash of what it leaves."""
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = placed(damaged(conversations), scratch)
    edits = traced(pieces_of(rows, scratch), scratch)
    scratch.drop("pieces")
    fault, copies = F.col("fault"), F.col("copies")
    turns = rows.where("turn is not null").select("conv_id", "turn").distinct()
    # Everything that is known of a conversation, one below the other; absent columns are null.
    known = [
        conversations.select("conv_id").distinct(),
        turns.groupBy("conv_id").agg(
            F.expr("try_subtract(try_add(try_subtract(max(turn), min(turn)), 1L), count(turn))").cast("long").alias("gaps")
        ),
        rows.groupBy("conv_id").agg(
            F.sum(F.when(fault == BLANK, copies).otherwise(0)).alias("blank"),
            F.sum(F.when(fault == DUPLICATE, copies).when(fault != BLANK, copies - 1).otherwise(0)).alias("duplicate"),
            F.sum((fault == TRUNCATED).cast("long")).alias("truncated"),
        ),
        edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost")),
        digests(edited(rows, edits)),
    ]
    together = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return together.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
