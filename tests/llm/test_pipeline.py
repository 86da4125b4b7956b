import re

import corpus_pipeline
from tariffscope.llm.common import table
from tests.llm.test_toxicity import corpus

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]
    docs = table(spark, DATA, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns and docs.schema.fieldNames() == before.schema.fieldNames()
        kept[name] = docs.count()
        if name == "line_dedup":
            assert kept[name] == before.count()
        else:
            assert kept[name] <= before.count()
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in table(spark, DATA, "benchmark").collect()]
    for row in docs.collect():
        text = " ".join(re.findall(r"[^\W_]+", (row.text or "").lower()))
        assert not any(item in text for item in items)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    toxic = {i for i, t in labels if t}
    assert len(kept & toxic) <= 2 and len(kept - toxic) >= 0.98 * (len(rows) - len(toxic))
