"""Chat transcripts to turns: a hidden Markov model over lines recovers who speaks.

A state is a role and whether the line opens a turn. A line is seen as its speaker marker's kind, its length and its
ending, so a marker that is missing, or words that look like one, can be outweighed by their surroundings.
Probabilities are counts over labelled lines, taken by Spark. The Viterbi path gives each line a state; lines of a turn
are joined, without the marker, into a canonical rendering.

A conversation is decoded in blocks, however long it is: each block of a conversation that has several is first reduced to
the best score from each state before it to each state at its end; these small tables are chained for the states at the
borders, and the blocks are then decoded between those. That is the same path as in one piece.

Defined results: a row without a conversation id is a conversation of its own; a null text is empty, a null turn comes
first; turns that tie are ordered by a hash of role and text; rows repeated in all of conv_id, turn, role and text are one
turn; a role outside ROLES counts as the user's when learning; empty lines belong to the turn they are in;
an empty table gives no turns, and without labelled lines all probabilities are equal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch, once

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2, plus 1 for a line that opens a turn
BLOCK_TURNS = 64
# What speakers are called in markers.
NAMES = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "client", "prompter", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a"),
}
# How transcripts may mark speakers, for system, user and assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System: ", "### Human: ", "### Assistant: "),
    ("[system] ", "[customer] ", "[agent] "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
    ("SYS> ", "Q> ", "A> "),
)
UNMARKED_PERCENT = 12
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:[#*]+\s*)?(?:[\[(<]\|?\s*({_NAME})\s*\|?[\])>]|({_NAME})\s*[:>])\**\s?", re.IGNORECASE | re.ASCII)
LENGTHS = (1, 60, 200)
SYMBOLS = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 3
KEY = ["conv", "block"]


def marker_role(line: str) -> tuple[int, int]:
    """The role a line's marker names, or len(ROLES), and how long the marker is."""
    found = MARKER.match(line)
    if not found:
        return len(ROLES), 0
    return ROLES.index(_ROLE_OF[(found[1] or found[2]).lower()]), found.end()


def symbol(line: str) -> int:
    """What the model sees of a line."""
    role, _ = marker_role(line)
    text = line.rstrip()
    length = sum(len(text) >= most for most in LENGTHS)
    ending = 0 if text.endswith("?") else 1 if text[-1:] in ".!:" else 2
    return (role * (len(LENGTHS) + 1) + length) * 3 + ending


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block at a time; a task's rows are sorted by block."""
    held = None
    for batch in batches:
        if held is not None and len(held):
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        change = (batch["conv"] != batch["conv"].shift()) | (batch["block"] != batch["block"].shift())
        starts = np.flatnonzero(change.to_numpy()).tolist()
        for start, end in zip(starts, starts[1:]):
            yield batch.iloc[start:end]
        held = batch.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held


class Model:
    """Log probabilities of first states, of states after states, and of symbols."""

    def __init__(self, counts: str):
        rows = json.loads(counts)
        start, step, seen = np.ones(STATES) * 0.1, np.ones((STATES, STATES)) * 0.1, np.ones((STATES, SYMBOLS)) * 0.1
        for kind, a, b, n in rows:
            if kind == "start":
                start[b] += n
            elif kind == "step":
                step[a, b] += n
            else:
                seen[a, b] += n
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.seen = np.log(seen / seen.sum(axis=1, keepdims=True))
        # Before the block: a state, or, as the last row, nothing.
        self.enter = np.vstack([self.step, self.start])

    def across(self, lines: list[str]) -> np.ndarray:
        """Best scores from each state before the lines (or none) to each state at their end."""
        best = self.enter
        for n, line in enumerate(lines):
            if n:
                best = (best[:, :, None] + self.step[None]).max(axis=1)
            best = best + self.seen[:, symbol(line)]
        return best

    def path(self, lines: list[str], before: int, at_end: int) -> list[int]:
        """The best states of the lines, given the state before (STATES for none) and, unless -1, at their end."""
        score, back = self.enter[before], []
        for n, line in enumerate(lines):
            if n:
                steps = score[:, None] + self.step
                back.append(steps.argmax(axis=0))
                score = steps.max(axis=0)
            score = score + self.seen[:, symbol(line)]
        state = int(score.argmax()) if at_end < 0 else at_end
        states = [state]
        for pointers in reversed(back):
            state = int(pointers[state])
            states.append(state)
        return states[::-1]


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Lines of ``conversations`` (conv_id, turn, role, text) written as transcripts: conv_id, conv (a key), block, turn, tie, nth
    and line, with the true ``role`` and whether the line ``opens`` a turn. Markers differ between conversations,
    and some turns have none."""
    rows = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    own = F.concat(F.lit("row-"), F.hex(F.xxhash64("turn", "role", "text")))
    rows = rows.withColumns({
        "conv": F.coalesce(F.concat(F.lit("id-"), F.col("conv_id").cast("string")), own),
        "block": F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), "tie": F.xxhash64("role", "text"),
    })
    index = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int"), F.lit(0))
    index = F.when(index == 0, ROLES.index("user")).otherwise(index - 1)
    styles = F.array(*(F.array(*map(F.lit, style)) for style in STYLES))
    style = F.get(styles, F.pmod(F.xxhash64("conv"), F.lit(len(STYLES))).cast("int"))
    bare = F.pmod(F.xxhash64("conv", "turn", "tie"), F.lit(100)) < UNMARKED_PERCENT
    rows = rows.withColumns({"index": index, "marker": F.when(bare, "").otherwise(F.get(style, index))})
    lines = rows.select(
        "conv_id", *KEY, "turn", "tie", F.col("index").alias("role"), "marker", F.posexplode_outer(F.split("text", "\n")).alias("nth", "line")
    )
    return lines.select(
        "conv_id", *KEY, "turn", "tie", "nth", "role", (F.col("nth") == 0).alias("opens"),
        F.when(F.col("nth") == 0, F.concat("marker", "line")).otherwise(F.col("line")).alias("line"),
    )


def _together(lines: DataFrame) -> DataFrame:
    return lines.repartition(*KEY).sortWithinPartitions(*KEY, "turn", "tie", "nth")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[tuple, int] = {}
    for rows in _blocks(batches):
        before = -1
        for role, opens, line in zip(rows["role"], rows["opens"], rows["line"]):
            state = 2 * int(role) + int(opens)
            for key in (("step", before, state) if before >= 0 else ("start", -1, state), ("seen", state, symbol(line))):
                found[key] = found.get(key, 0) + 1
            before = state
    yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "a", "b", "n"])


def learn(lines: DataFrame) -> str:
    """The model's counts, from lines as transcript_lines() gives them; a few hundred numbers whatever the lines."""
    counted = _together(lines.select(*KEY, "turn", "tie", "nth", "role", "opens", "line")).mapInPandas(
        _counts, "kind string, a long, b long, n long"
    )
    rows = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return json.dumps(sorted((r["kind"], r["a"], r["b"], r["n"]) for r in rows))


def _summaries(batches: Iterator[pd.DataFrame], model: str) -> Iterator[pd.DataFrame]:
    known = Model(model)
    for rows in _blocks(batches):
        best = known.across(rows["line"].tolist())
        yield pd.DataFrame({"conv": [rows["conv"].iloc[0]], "block": [rows["block"].iloc[0]], "best": [best.ravel().tolist()]})


def _borders(rows: pd.DataFrame) -> pd.DataFrame:
    """The states before and at the end of each block of one conversation."""
    rows = rows.sort_values("block")
    score, back = None, []
    for best in rows["best"]:
        best = np.asarray(best).reshape(STATES + 1, STATES)
        if score is None:
            score = best[STATES]
        else:
            steps = score[:, None] + best[:STATES]
            back.append(steps.argmax(axis=0))
            score = steps.max(axis=0)
    ends = [int(score.argmax())]
    for pointers in reversed(back):
        ends.append(int(pointers[ends[-1]]))
    ends = ends[::-1]
    return pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "before": [STATES, *ends[:-1]], "at_end": ends})


def _states(batches: Iterator[pd.DataFrame], model: str) -> Iterator[pd.DataFrame]:
    known = Model(model)
    made, size = [], 0
    for rows in _blocks(batches):
        states = known.path(rows["line"].tolist(), int(rows["before"].iloc[0]), int(rows["at_end"].iloc[0]))
        rows = rows.drop(columns=["before", "at_end"])
        opened = np.cumsum([s % 2 for s in states])
        rows = rows.assign(state=states, opened=opened, nth_line=np.arange(len(rows)))
        made.append(rows)
        size += len(rows)
        if size > 5000:
            yield pd.concat(made)
            made, size = [], 0
    if made:
        yield pd.concat(made)


def decode(lines: DataFrame, model: str, scratch: Scratch) -> DataFrame:
    """``lines`` (conv, block, turn, tie, nth, line, and others) with ``state``, its number of ``opened`` turns in the block
    so far, and ``nth_line`` in the block."""
    blocks = scratch.keep(lines.select(*KEY).distinct(), "blocks")
    several = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    several = scratch.keep(several, "several")
    plain = [F.lit(STATES).alias("before"), F.lit(-1).alias("at_end")]
    if several.isEmpty():
        bounded = lines.select("*", *plain)
    else:
        long = _together(lines.join(several, "conv", "left_semi").select(*KEY, "turn", "tie", "nth", "line"))
        summaries = long.mapInPandas(lambda b: _summaries(b, model), "conv string, block long, best array<double>")
        borders = scratch.keep(
            summaries.groupBy("conv").applyInPandas(_borders, "conv string, block long, before int, at_end int"), "borders"
        )
        bounded = lines.join(borders, KEY, "left")
        bounded = bounded.fillna({"before": STATES, "at_end": -1})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    return _together(bounded).mapInPandas(
        lambda b: _states(b, model), schema + ", state int, opened long, nth_line long"
    )


def rendered(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def turns(lines: DataFrame, model: str) -> DataFrame:
    """conv_id, turn_no, role, n_lines, text and rendered of every recovered turn."""
    scratch = Scratch(lines.sparkSession, "chat")
    decoded = scratch.keep(decode(lines.select("conv_id", *KEY, "turn", "tie", "nth", "line"), model, scratch), "decoded")
    # Turns opened in a conversation's earlier blocks: a row per block.
    opened = decoded.groupBy(*KEY).agg(F.max("opened").alias("in_block"))
    so_far = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(*KEY, F.sum("in_block").over(so_far).alias("offset"))
    numbered = decoded.join(offsets, KEY, "left").withColumn("turn_no", F.col("opened") + F.coalesce("offset", F.lit(0)))
    text = F.when(
        F.col("state") % 2 == 1, F.regexp_replace("line", "(?i)" + MARKER.pattern, "")
    ).otherwise(F.col("line"))
    numbered = numbered.select("conv_id", "conv", "turn_no", F.struct("block", "nth_line", text.alias("text"), "state").alias("part"))
    gathered = numbered.groupBy("conv_id", "conv", "turn_no").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    role = F.get(F.array(*map(F.lit, ROLES)), F.floor(F.col("parts")[0]["state"] / 2).cast("int"))
    gathered = once(gathered.withColumn("role", role), "text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    return gathered.select(
        "conv_id", "turn_no", "role", F.size("parts").alias("n_lines"), "text",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
    )


def is_held_out(conv: str = "conv") -> Column:
    return F.pmod(F.xxhash64(conv, F.lit(3)), F.lit(5)) == 0
