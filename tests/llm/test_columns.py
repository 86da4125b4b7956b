from tariffscope.llm import decontam, lines, minhash


def test_columns_named_as_internal_ones_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, item, 7, 8, 9, 4), (2, "a line that nothing else repeats\n" + item, 7, 8, 9, 4), (3, None, 7, 8, 9, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _doc int, _hash int, _removed int, found_id int").coalesce(1)
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    inside = ["_doc", "_hash", "_removed", "found_id"]
    clean = decontam.without_overlaps(frame, benchmark)
    assert clean.columns == frame.columns and [tuple(r) for r in clean.collect()] == [rows[2]]
    once = lines.without_repeats(frame).orderBy("doc_id")
    got = once.collect()
    assert [tuple(r[c] for c in inside) for r in got] == [(7, 8, 9, 4)] * 3
    assert [r.text for r in got] == [item, "a line that nothing else repeats", None]
    copies = minhash.one_of_each(frame.union(frame))
    assert copies.columns == frame.columns
    assert sorted((tuple(r) for r in copies.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[2]], key=str)
