from itertools import product

import numpy as np
import pytest

from tariffscope.llm import chat
from tariffscope.llm.common import Scratch


@pytest.fixture(scope="module")
def conversations(spark):
    rows = []
    for c in range(120):
        if c % 4 == 0:
            rows.append((c, 0, "system", "Be helpful."))
        for t in range(1, 7):
            role = "user" if t % 2 else "assistant"
            text = f"what about {c} and {t}?" if role == "user" else "A long answer, " * (3 + t) + f"number {c}.\nA: second line of {t}.\n\nEnd."
            rows.append((c, t, role, text))
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, line string")


@pytest.fixture(scope="module")
def model(conversations):
    return chat.learn(chat.transcript_lines(conversations).where(~chat.is_held_out()))


def test_held_out_roles_are_recovered(conversations, model):
    lines = chat.transcript_lines(conversations).where(chat.is_held_out())
    rows = chat.decode(lines, model, Scratch(lines.sparkSession, "t")).toPandas()
    assert len(rows) > 300
    assert (rows.state // 2 == rows.role).mean() > 0.97
    assert (rows.state % 2 == rows.opens).mean() > 0.97


def test_turns_are_rendered_whole(conversations, model):
    found = chat.turns(chat.transcript_lines(conversations), model).toPandas()
    truth = {(r.conv_id, r.text) for r in conversations.collect()}
    right = [(int(c), t) in truth for c, t in zip(found.conv_id, found.text)]
    assert np.mean(right) > 0.95
    first = found[(found.conv_id == 4) & (found.turn_no == 1)].iloc[0]
    assert first.rendered == f"<|{first.role}|>\n{first.text}\n<|end|>\n"


def test_blocks_give_the_path_of_one_piece(conversations, model, monkeypatch):
    wanted = ["conv_id", "turn_no", "role", "n_lines", "text"]
    whole = chat.turns(chat.transcript_lines(conversations), model).select(*wanted).collect()
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    blocks = chat.turns(chat.transcript_lines(conversations), model).select(*wanted).collect()
    assert sorted(whole) == sorted(blocks)


def test_path_is_the_best_of_all(model):
    known = chat.Model(model)
    lines = ["User: hi", "what?", "an answer " * 10, "A: yes."]
    score = lambda s: known.start[s[0]] + sum(known.step[a, b] for a, b in zip(s, s[1:])) + sum(
        known.seen[a, chat.symbol(x)] for a, x in zip(s, lines)
    )
    best = max(product(range(chat.STATES), repeat=len(lines)), key=score)
    assert tuple(known.path(lines, chat.STATES, -1)) == best
    assert np.isclose(known.across(lines)[chat.STATES].max(), score(best))


def test_markers():
    cases = {"User: x": 1, "### Assistant: x": 2, "[system] x": 0, "<|user|> x": 1, "A> x": 2, "**Human:** x": 1, "Use: x": 3, "a cat": 3}
    assert {k: chat.marker_role(k)[0] for k in cases} == cases


def test_nulls_ties_and_repeats(spark, model):
    rows = [(None, 1, "user", "one?"), (None, 2, "user", "two?"), (1, None, "user", None), (1, 0, "user", "x?"), (1, 0, "user", "x?"), (2, 0, None, "y\n" * 2000), (3, 5, "odd", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = chat.turns(chat.transcript_lines(frame), model).collect()
    assert sum(r.n_lines for r in found) == 1 + 1 + 2 + 2001 + 1
    assert chat.turns(chat.transcript_lines(frame.limit(0)), model).count() == 0
    assert chat.turns(chat.transcript_lines(frame), chat.learn(chat.transcript_lines(frame.limit(0)))).count() > 0


def test_letters_that_only_fold_to_a_marker_are_text(spark, model):
    """The long s and the Kelvin sign are no letters of a marker, in Python as in Spark."""
    texts = ["u\u017fer: hi", "\u017fystem: x", "a\u017f\u017fistant: y", "\u212a: z"]
    assert [chat.marker_role(t) for t in texts] == [(3, 0)] * 4
    frame = spark.createDataFrame([(1, 0, "user", "hi\n" + "\n".join(texts))], "conv_id long, turn int, role string, text string")
    found = chat.turns(chat.transcript_lines(frame), model).collect()
    assert all(any(t in r.text for r in found) for t in texts)
