import random

import numpy as np
import pyarrow as pa

from tariffscope.llm import minhash


def base_text(draw, n):
    return [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randrange(3000)) for _ in range(n)]


def corpus():
    draw = random.Random(11)
    rows = []
    for _ in range(12):
        words = base_text(draw, draw.randint(60, 200))
        rows.append(" ".join(words))
        for edits in (0, 1, 2, 5, 20):
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = "edited" + str(draw.randrange(10**6))
            rows.append(" ".join(copy))
    family = base_text(draw, 150)  # larger than what is compared pair by pair
    for k in range(60):
        copy = list(family)
        copy[k] = f"own{k}"
        rows.append(" ".join(copy))
    rows += ["one two", "One  two ", "one two three", "", None, "  \n ", "lorem " * 5000, " ".join(base_text(draw, 20_000))]
    return [(k, t) for k, t in enumerate(rows)] + [(0, rows[0]), (None, rows[0]), (None, None)]


def brute_classes(rows, weights):
    sets = [minhash.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and minhash.similarity(sets[a], sets[b], weights) >= minhash.SIMILARITY:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(rows))]


def test_classes_equal_comparing_all_pairs(spark):
    rows = corpus()
    documents = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class_id string")
    weights = minhash.learn_weights(documents)
    want = brute_classes(rows, weights)
    members = {}
    for root, (doc_id, _) in zip(want, rows):
        members.setdefault(root, []).append(doc_id)
    expected = [(i, min((d for d in m if d is not None), default=None), len(m)) for m in members.values() for i in m]
    got = [tuple(r) for r in minhash.classes(documents).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)

    kept = minhash.one_of_each(documents)
    assert kept.columns == documents.columns
    texts = {k for k, t in enumerate(rows) if t[1] is None or not t[1].strip()}
    assert kept.count() == len(set(want) - texts) + len(texts)
    assert {r.doc_id for r in kept.collect()} == {min((d for d in m if d is not None), default=None) for m in members.values()}


def test_samples_agree_as_often_as_texts_are_similar():
    draw, none = random.Random(2), minhash.Weights(np.zeros(0, np.uint64), np.zeros(0))
    gaps = []
    for _ in range(60):
        a = base_text(draw, 300)
        b = a[: draw.randrange(300)] + base_text(draw, 100)
        x, y = minhash.shingles(" ".join(a)), minhash.shingles(" ".join(b))
        agree = (minhash.signature(x[0], none.of(*x)) == minhash.signature(y[0], none.of(*y))).mean()
        gaps.append(agree - minhash.similarity(x, y, none))
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.09


def test_common_shingles_weigh_less(spark):
    draw = random.Random(4)
    notice = "this notice is on most of the pages here"
    rows = [(k, notice + " " + " ".join(base_text(draw, 20))) for k in range(300)]
    weights = minhash.learn_weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    hashes, counts = minhash.shingles(notice)
    assert np.allclose(weights.of(hashes, counts), 1.0)  # every document has it
    own = minhash.shingles(rows[0][1])
    assert weights.of(*own).max() > 2.6


def test_empty_table(spark):
    assert minhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_buckets_dealt_anew_keep_pairs_together():
    draw = np.random.Generator(np.random.PCG64(3))
    n = 40_000
    a = draw.integers(0, 1 << 32, (n, minhash.SAMPLES), dtype=np.uint32)
    b = np.where(draw.random(a.shape) < minhash.SIMILARITY, a, a + np.uint32(1))
    banded = (a == b).reshape(n, minhash.BANDS, minhash.ROWS).all(axis=2).any(axis=1)
    a, b = a[banded], b[banded]

    def dealt(samples):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(samples), 7)), pa.array(np.arange(len(samples))), pa.array([r.tobytes() for r in samples], pa.binary())],
            ["bucket", "node", "samples"],
        )
        return np.concatenate([np.stack(part.column("buckets").to_numpy(False)) for part in minhash._regrouped(iter([batch]))])

    assert (dealt(a) == dealt(b)).any(axis=1).mean() > 1 - 3e-4


def test_large_buckets_are_thinned_without_losing_a_pair(spark):
    """Before, all texts of a large family with many edits were compared with each other."""
    draw = random.Random(31)
    family, rows = base_text(draw, 120), []
    for k in range(150):
        copy = list(family[draw.randrange(4) :])
        for _ in range(draw.choice((0, 1, 2, 3, 4, 6, 9, 12))):
            copy[draw.randrange(len(copy))] = f"own{draw.randrange(10**6)}" if draw.random() < 0.7 else draw.choice(family)
        rows.append((k, " ".join(copy)))
    weights = minhash.learn_weights(spark.createDataFrame(rows, "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["node", "text"])
    held = [tuple(r.values()) for part in minhash._weighed(iter([batch]), weights) for r in part.to_pylist()]
    frame = spark.createDataFrame(held, "node long, shingle long, weight double, total double")
    members = minhash.by_rare_shingles(frame, minhash.Scratch(spark, "t")).collect()
    buckets = {}
    for r in members:
        buckets.setdefault(r.bucket, set()).add(r.node)
    met = {(a, b) for nodes in buckets.values() for a in nodes for b in nodes if a < b}
    sets = [minhash.shingles(t) for _, t in rows]
    similar = {(a, b) for b in range(len(rows)) for a in range(b) if minhash.similarity(sets[a], sets[b], weights) >= minhash.SIMILARITY}
    assert similar <= met and len(similar) > 100
    assert len(met) < 0.6 * len(rows) * (len(rows) - 1) / 2
    assert {n for nodes in buckets.values() if len(nodes) > 1 for n in nodes} < set(range(len(rows)))


def documents_with(rows):
    """In how many rows each shingle is, and how many rows have any."""
    sets = [minhash.shingles(t)[0] for _, t in rows]
    return np.unique(np.concatenate(sets), return_counts=True), sum(len(s) > 0 for s in sets)


def test_every_shingle_has_its_own_document_frequency(spark, monkeypatch):
    """Before, all shingles in at most 2% of the documents weighed alike."""
    draw = random.Random(8)
    passages = [" ".join(base_text(draw, 12)) for _ in range(30)]
    rows = [(k, " ".join([*base_text(draw, 30), *draw.sample(passages, 2)])) for k in range(300)]
    rows += rows[:5] + [(None, rows[7][1])] * 9 + [(1, None), (1, " \n"), (2, "one two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    (hashes, numbers), n = documents_with(rows)
    assert ((numbers > 1) & (numbers < 0.02 * n)).sum() > 100
    want = 1 - np.log10(numbers / n)
    assert np.allclose(minhash.learn_weights(frame).of(hashes, np.ones(len(hashes))), want)
    monkeypatch.setattr(minhash, "CHUNK", 2_000)  # many chunks and buckets, not one
    monkeypatch.setattr(minhash, "BUCKET", 3_000)
    assert np.allclose(minhash.learn_weights(frame).of(hashes, np.ones(len(hashes))), want)


def test_a_passage_of_some_documents_makes_no_copies_of_them(spark):
    """Five of 300 documents share most of their words, which real frequencies weigh too little for 0.8. Before, they were one class."""
    draw = random.Random(18)
    passage = " ".join(base_text(draw, 94))
    rows = [(k, " ".join([passage, *base_text(draw, 10)])) for k in range(5)]
    rows += [(k, " ".join(base_text(draw, 60))) for k in range(5, 299)]
    rows += [(299, rows[200][1] + " more")]
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (k, 1) for k in range(5))
    assert got[299] == got[200] == (200, 2)


def test_shingles_are_dealt_out_in_parts_and_answered_whole():
    draw = np.random.Generator(np.random.PCG64(6))
    hashes = np.sort(draw.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (minhash._unpacked(minhash._packed(hashes)) == hashes).all()
    found, sums = minhash._totals(np.concatenate([hashes, hashes[::2], hashes[:3]]), np.concatenate([np.ones(1500, np.int64), [5, 1, 2]]))
    want = np.where(np.arange(1000) % 2 == 0, 2, 1)
    want[:3] += [5, 1, 2]
    assert (found == hashes).all() and (sums == want).all()
    assert [len(x) for x in minhash._totals(np.zeros(0, np.uint64), np.zeros(0, np.int64))] == [0, 0]
