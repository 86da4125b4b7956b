import hashlib
import random

import numpy as np
import pytest

from tariffscope.llm import suffix

LENGTH = suffix.LENGTH


def brute(texts):
    """Per text: bytes, removed, spans and kept bytes, by comparing all strings."""
    seen = {}
    for t in texts:
        for k in range(len(t) - LENGTH + 1):
            seen[t[k : k + LENGTH]] = seen.get(t[k : k + LENGTH], 0) + 1
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                covered[k : k + LENGTH] = True
        kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def words(draw, n, letters="abcdefghijklmnop"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 8))) for _ in range(n))


def cases():
    draw = random.Random(3)
    passage, other = words(draw, 200), words(draw, 90, "éüñ漢字ab")
    exact = passage[:LENGTH]
    texts = [words(draw, 50) + passage + words(draw, 50), passage, "x" + exact + "y", "z" + exact[:-1], None, "", "short"]
    texts += [passage[300:] + other + passage[:450], other[40:] + " " + words(draw, 30), other + other]
    texts += ["be " * 400, "be " * 150, "a" * 399, "b" * 401, "ab" * 500, "Is this " * 60 + words(draw, 100) + "Is this " * 60]
    for _ in range(12):  # near copies: each differs from the others at one place
        at = draw.randrange(len(passage))
        texts.append(passage[:at] + "#" + passage[at + 1 :])
    return [(k, t) for k, t in enumerate(texts)] + [(1, passage), (None, "q" * 300 + other), (None, "r" + other[::-1])]


@pytest.mark.parametrize("with_text", [True, False])
def test_equals_comparing_all_strings(spark, with_text):
    rows = cases()
    documents = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_bytes string")
    out = suffix.without_repeats(documents, with_text).collect()
    want = brute([(t or "").encode() for _, t in rows])
    assert sorted(((r.doc_id is None, r.doc_id), *tuple(r)[1:5]) for r in out) == sorted(
        ((i is None, i), *w[:4]) for (i, _), w in zip(rows, want)
    )
    if with_text:
        kept = {hashlib.sha256(w[4]).hexdigest(): w[4] for w in want}
        for r in out:
            assert r.kept is None or bytes(r.kept) == kept[r.kept_sha256]


def test_anchors_are_chosen_from_content_alone():
    draw = random.Random(9)
    shared = words(draw, 300).encode()
    found = []
    for before in (b"", b"abc", words(draw, 40).encode()):
        text = before + shared + words(draw, 40).encode()
        sample = suffix.samples_of(suffix.Prefixes(text))
        found.append(sample[len(before) : len(before) + len(shared) - 200] - len(before))
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()


def test_nothing_repeated_and_empty_table(spark):
    documents = spark.createDataFrame([(1, "x" * 100), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in suffix.without_repeats(documents).collect()) == [(1, 100, 0, 0), (2, 0, 0, 0)]
    assert suffix.without_repeats(documents.limit(0)).count() == 0


def test_few_rows_are_made_where_only_a_short_core_repeats(spark, monkeypatch):
    """Before, every string around a repeated core was a row, though no 400 bytes occur twice."""
    kept = {}

    class Counted(suffix.Scratch):
        def keep(self, df, name):
            stored = super().keep(df, name)
            kept[name] = stored.count()
            return stored

    monkeypatch.setattr(suffix, "Scratch", Counted)
    draw = random.Random(21)
    passage, whole = words(draw, 60)[:280], words(draw, 150)[: LENGTH + 1]
    rows = [(k, words(draw, 100) + passage + words(draw, 100)) for k in range(60)]
    rows += [(100 + k, words(draw, 70) + whole + words(draw, 70)) for k in range(2)]
    out = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), False).collect()
    want = brute([t.encode() for _, t in rows])
    assert sorted(tuple(r) for r in out) == sorted((i, *w[:4]) for (i, _), w in zip(rows, want))
    assert kept["contexts"] >= 60 and sum(n for name, n in kept.items() if name.startswith("strings")) < 30 * kept["contexts"]
