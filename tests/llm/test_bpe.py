"""BPE by shared chunks against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tariffscope.llm import bpe
from tariffscope.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string"

fragments = st.sampled_from(
    ["a", "the", "'s", "'r", "e", "'", "'ll", " ", "  ", "\n", "\n\n", "\t", " ", " ", "　", "\x85", "\x1c", "᠎", "​",
     "é", "ß", "日本", "語", "😀", "12", "3", "!", "<|endoftext|>", "<|endo", "ftext|>", "-", "—", "\r\n", "İ", "\x00", "word"]
)
texts = st.lists(fragments, max_size=40).map("".join)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def expected(rows):
    found = []
    for doc_id, text in rows:
        ids, decoded = library(text or "")
        raw = np.array(ids, "<u4").tobytes()
        found.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(found, key=repr)


def result(spark, rows):
    return sorted((tuple(r) for r in bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH).collect()), key=repr)


@settings(max_examples=400, deadline=None)
@given(texts)
@example("x  <|endoftext|>  y")
@example("a \x1c b")
def test_a_text_by_units(text):
    coder = bpe.codec(PATH)
    (coded,) = coder.encode([text])
    ids, decoded = library(text)
    assert coder.ids(coded).tolist() == ids
    assert coder.decode(coder.ids(coded)) == decoded


@settings(max_examples=400, deadline=None)
@given(texts, st.lists(st.integers(0, 200), max_size=6))
@example("I'll go", [2])
@example("a  b", [2])
@example("say <|endoftext|> now", [8])
@example("日本語" * 30, [20, 40, 41, 60])
def test_joined_pieces(text, cuts):
    coder = bpe.codec(PATH)
    borders = [0, *sorted(min(c, len(text)) for c in cuts), len(text)]
    pieces = coder.encode([text[a:b] for a, b in zip(borders, borders[1:])])
    assert coder.ids(coder.joined([pieces])[0]).tolist() == library(text)[0]


def test_long_texts_in_many_pieces():
    coder, rng = bpe.codec(PATH), random.Random(5)
    words = ["alpha", "'ll", "x", "  ", "\n", "42", "naïve", "end."]
    for text in (" ".join(rng.choice(words) for _ in range(20_000)), "日本" * 9_000, "ab" * 10_000):
        borders = [0, *sorted(rng.randrange(len(text)) for _ in range(60)), len(text)]
        pieces = coder.encode([text[a:b] for a, b in zip(borders, borders[1:])])
        assert coder.ids(coder.joined([pieces])[0]).tolist() == library(text)[0]


def test_windows_are_widened_until_they_agree(monkeypatch):
    """With a pattern that claims safe places where there are none, the agreement decides."""
    coder = bpe.codec(PATH)
    text = "one two three four five six seven eight nine ten " * 3
    left, right = text[:70], text[70:]
    pieces = coder.encode([left, right])
    wrong = bpe.Codec(PATH)
    calls = []
    encode = wrong.encode

    def first_wrong(windows):
        calls.append(windows)
        return [b"\x00\x00" * 3] if len(calls) == 1 else encode(windows)

    monkeypatch.setattr(wrong, "encode", first_wrong)
    assert coder.ids(wrong.joined([pieces])[0]).tolist() == library(text)[0]
    assert len(calls) == 2 and len(calls[1][0]) > len(calls[0][0])


@given(st.binary(max_size=3000).map(lambda b: b.decode("utf-8", "ignore")))
def test_chunks_add_up_at_characters(text):
    chunks = bpe._chunks(text)
    assert b"".join(chunks).decode() == text
    assert all(c.decode() for c in chunks)


def test_shared_passages_have_equal_chunks():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(words[:600])
    first, second = (set(bpe._chunks(" ".join(words[a:b]) + passage)) for a, b in ((700, 900), (1000, 1777)))
    assert len(first & second) >= 8


def documents():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "'s "]) for _ in range(n))
    passages = [text(300) for _ in range(3)]
    rows = [(i, text(rng.randint(0, 300)) + rng.choice(passages) + text(rng.randint(0, 100))) for i in range(60)]
    return rows


def test_documents_equal_the_library(spark):
    rows = documents()
    rows += [(100, None), (101, ""), (None, "no id"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (102, rows[3][1]), (103, "q" * 30_000)]
    rows += [(104, "<|endoftext|>" + rows[5][1] + " <|endoftext|>\n"), (105, "word " * 30_000), (106, " " * 5_000)]
    assert result(spark, rows) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    rows = [(i, t, "x", 1) for i, t in documents()[:20]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, chunks string, doc int")
    found = bpe.encode(frame, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected([r[:2] for r in rows])


def test_ids_and_texts_come_back(spark):
    rows = documents()[:25]
    found = bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, with_ids=True, with_text=True)
    ids = {r.doc_id: (r.ids, r.decoded) for r in found.collect()}
    assert ids == {i: library(t) for i, t in rows}
    again = bpe.decode(found, PATH)
    assert {r.doc_id: r.decoded for r in again.collect()} == dict(rows)


def test_a_filter_that_takes_all_chunks_for_shared(spark, monkeypatch):
    """What is mistaken for shared changes no result."""
    monkeypatch.setattr(bpe, "_filter_of", lambda shared: b"\xff" * (1 << 13))
    rows = documents()[:30]
    assert result(spark, rows) == expected(rows)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(tokenizer_path())
