import itertools
import math
import random
import re

from tariffscope.llm import decontam


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(documents, items):
    found = {}
    for doc_id, text in documents:
        d = tokens(text)
        for item_id, item in items:
            b, best = tokens(item), None
            if len(b) < decontam.SPAN:
                continue
            width = min(decontam.WINDOW, len(b))
            for i in range(len(d) - width + 1):
                for j in range(len(b) - width + 1):
                    n = sum(x == y for x, y in zip(d[i : i + width], b[j : j + width]))
                    if n >= decontam.SIMILARITY * width:
                        best = max(best or (0,), (n,))
            if best:
                key = (doc_id, item_id)
                found[key] = max(found.get(key, 0), best[0])
    return found


def test_equals_comparing_all_windows(spark):
    draw = random.Random(8)
    word = lambda: draw.choice("abcdefgh") + str(draw.randrange(60))
    items = [(k, " ".join(word() for _ in range(draw.randint(14, 40)))) for k in range(15)]
    items += [(20, "too short to match"), (21, None), (22, ""), (0, items[0][1])]
    documents = []
    for k in range(80):
        words = [word() for _ in range(draw.randint(5, 120))]
        if k % 4 == 0:
            leak = items[k % 15][1].split()
            if k % 8 == 0:  # a word of the passage is another
                leak[draw.randrange(len(leak))] = "other"
            words[3:3] = leak
        documents.append((k, " ".join(words)))
    long = " ".join(word() for _ in range(30_000))
    documents += [(100, items[3][1].upper().replace(" ", ", ")), (101, None), (102, ""), (None, items[4][1]), (103, long + " " + items[5][1])]
    documents += [(100, documents[0][1]), (104, "be " * 3000)]
    frame = spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.overlaps(frame, benchmark).collect()
    got = {(r.doc_id, r.item_id): r.n_equal for r in rows}
    want = brute([d for d in documents if d[0] != 103], items)
    assert {k: v for k, v in got.items() if k[0] != 103} == want and (103, 5) in got
    clean = decontam.without_overlaps(frame, benchmark)
    assert clean.columns == frame.columns
    gone = {i for i, _ in got}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in documents if i not in gone)


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    items = [(1, " ".join(f"w{k}" for k in range(20)))]
    frame = spark.createDataFrame([(1, "a b " + items[0][1]), (2, "nothing here")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    first = decontam.overlaps(frame, benchmark).collect()
    monkeypatch.setattr(decontam, "BROADCAST_HASHES", 0)
    assert decontam.overlaps(frame, benchmark).collect() == first and first[0].doc_start == 2


def test_no_python_runs(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = decontam.overlaps(frame, frame.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.overlaps(frame, frame.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_masks_hit_whatever_the_verification_accepts():
    for of in range(1, 14):
        masks = [m for m, lengths in decontam.MASKS.items() if min(of, decontam.SPAN) in lengths]
        for n in range(1, of + 1):  # tokens of the item inside the document
            most = math.floor(n - decontam.SIMILARITY * of + 1e-9)
            for wrong in (c for k in range(most + 1) for c in itertools.combinations(range(n), k)):
                hit = any(
                    all(bit == "0" or at + i not in wrong for i, bit in enumerate(m)) for m in masks for at in range(n - len(m) + 1)
                )
                assert hit, (of, n, wrong)


def test_leaks_with_up_to_five_substitutions_and_short_items(spark):
    draw = random.Random(9)
    word = lambda: draw.choice("abcdefgh") + str(draw.randrange(500))
    lengths = [*range(1, 20)] * 12
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate(lengths)]
    documents = []
    for k, item in items:
        leak = list(item)
        for at in draw.sample(range(len(leak)), min(len(leak) // 2, draw.randint(2, 5) if len(leak) > 9 else draw.randint(0, 1))):
            leak[at] = "other"
        documents.append((k, " ".join(word() for _ in range(20)) + " " + " ".join(leak) + " " + " ".join(word() for _ in range(20))))
    items = [(k, " ".join(item)) for k, item in items]
    rows = decontam.overlaps(
        spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = {}
    for d, text in documents:
        there = tokens(text)
        for i, item in items:
            b = tokens(item)
            width = min(decontam.WINDOW, len(b))
            most = max(
                sum(x == y for x, y in zip(there[p : p + width], b[q : q + width]))
                for q in range(len(b) - width + 1) for p in range(len(there) - width + 1)
            )
            if most >= decontam.SIMILARITY * width:
                want[d, i] = most
    assert {(r.doc_id, r.item_id): r.n_equal for r in rows if r.n_tokens == min(13, lengths[r.item_id])} == want
    assert len(want) > 150
