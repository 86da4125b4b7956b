import zlib
from collections import defaultdict

import numpy as np
import pytest

from tariffscope.llm import packing
from tariffscope.llm.queries import tokenizer_path

TEXTS = [
    (1, "The cat, it's 12.5 cats!! THE\n\nend"), (2, None), (3, ""), (3, ""), (None, "Ünïcode ΑΣ ́a <|endoftext|> x'"),
    (4, "word " * 9000), (5, "a" * 500), (6, "don't 'S I'LL 'd\tx  y"),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_word_encoder_equals_the_tokenizer(tokenizer):
    texts = [t or "" for _, t in TEXTS] + ["\x1c a\x85b", "I'm İstanbul", "x.y,z", "ß ÿ", "'", "<|startoftext|>a"]
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words = packing.WordEncoder(tokenizer_path())
    assert words.encode(texts) == want
    assert words.encode(texts) == want  # from what it remembers


def test_round_trip_without_padding(spark, tokenizer):
    documents = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, sequence_id string")
    rows = packing.pack(documents, tokenizer_path(), with_ids=True).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    for doc_id, text in TEXTS:
        if doc_id == 3:
            assert sorted(documents[3]) == [(0, [2], 1), (0, [2], 1)]
            continue
        ids = [i for _, part, _ in sorted(documents[doc_id]) for i in part]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
