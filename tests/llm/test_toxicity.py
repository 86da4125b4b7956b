import random
import zlib

from pyspark.sql import functions as F

from tariffscope.llm import toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "so") for c in ("", "l", "ri")]


def corpus(n=400, seed=5):
    draw, rows, labels = random.Random(seed), [], []
    for k in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randint(20, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["grumbag", "Grumb4g", "gruмbag", "snarp"]))
        elif k % 40 == 1:
            words[5:5] = ["snarp", "engine"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_folding():
    assert toxicity.fold("1d10t") == " idiot "
    assert toxicity.fold("Іdіоt! ＩＤＩＯＴ, id!ot") == " idiot idiot idiot "
    assert toxicity.fold(None) == "  " == toxicity.fold(" ,, ")


def test_exceptions_and_longest_terms():
    matcher = toxicity.Matcher({" trash ": 2.0, " tras": 1.0}, [" trash can "])
    assert [m[2:] for m in matcher.matches(toxicity.fold("trash trash can trashy"))] == [(2.0, " trash "), (1.0, " tras")]


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    extra = [(None, "grumbag snarp"), (9001, None), (9002, ""), (0, rows[0][1]), (9003, "grumbag " * 30_000)]
    documents = spark.createDataFrame([(*r, "clash") for r in rows + extra], "doc_id long, text string, toxicity string")
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.assess(documents, table).collect()
    assert len(out) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by_id = {r.doc_id: r for r in out}
    assert by_id[9001].predicted == by_id[9002].predicted == 0 and by_id[9003].predicted == 1
    # A term that clean texts have in one phrase only counts elsewhere, and not there.
    model = toxicity.learn(documents, toxicity.train_labels(table))
    scored = spark.createDataFrame([(1, "snarp engine " + " ".join(WORDS)), (2, "snarp snarp snarp")], "doc_id long, text string")
    first, second = (r.toxicity for r in toxicity.score(scored, model).orderBy("doc_id").collect())
    assert first < 0.5 < second


def test_no_labels_and_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.assess(documents, none).collect()] == [0.0]
    assert toxicity.assess(documents.where(F.lit(False)), none).count() == 0


def test_the_model_does_not_depend_on_batches(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    models = set()
    for size, parts in ((10_000, 1), (10, 5), (3, 2)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            models.add(toxicity.learn(documents, table))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(models) == 1 and " snarp engine " in models.pop()
