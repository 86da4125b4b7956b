import numpy as np

from tariffscope.llm import ann


def test_ties_copies_and_rows_that_take_no_part(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    rows = [(k, draw.normal(size=8).tolist()) for k in range(100)]
    rows += [(k, [1.0] * 8) for k in range(200, 260)] + [(7, rows[7][1])]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [1.0] * 6), (303, [float("nan")] * 8), (304, []), (None, [1.0] * 8)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0])]  # another dimension
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, vector array<double>, rank string")
    found = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and i not in (301, 303)}
    for q in [i for i in vectors if i % 20 == 0]:
        want = sorted((-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q)[:5]
        assert [(k + 1, i) for k, (_, i) in enumerate(want)] == [f[:2] for f in found[q]]
        assert np.allclose([f[2] for f in found[q]], [-s for s, _ in want])
    assert found[400] == [(1, 401, 4.0)]
    assert set(found) == {i for i in vectors if i % 20 == 0} | {400}


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)  # several shards
    draw = np.random.Generator(np.random.PCG64(5))
    centres = draw.normal(size=(20, 24)) * 2
    vectors = centres[draw.integers(0, 20, 2000)] + draw.normal(size=(2000, 24))
    vectors *= draw.uniform(0.5, 2, size=(2000, 1))  # lengths differ, so inner product isn't angle
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, vector array<double>")
    found = ann.nearest(table, table.where("vec_id % 20 = 0"), k=20).toPandas()
    assert (found.groupby("query_id").size() == 20).all()
    hits = 0
    for q, rows in found.groupby("query_id"):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(rows.vec_id))
    assert hits / (20 * found.query_id.nunique()) > 0.95


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, vector array<float>")
    assert ann.nearest(empty, empty).count() == 0


def test_an_id_with_several_vectors_counts_by_its_best(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 4.0]), (3, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = ann.nearest(table, table.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 5.0), (0, 2, 2, 4.0), (0, 3, 3, 0.5)]
