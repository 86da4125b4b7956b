"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.llm import ann, bpe, chat, codes, decontam, lines, minhash, packing, repair, suffix, toxicity, urls, warc
from tariffscope.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled as the document of the same number; low quality is the bad outcome."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad")
    )
    return urls.judge(table(spark, sf_dir, "pages"), labels)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as transcripts and parsed again by a model learned from four fifths of them."""
    lines = chat.transcript_lines(table(spark, sf_dir, "conversations"))
    return chat.turns(lines, chat.learn(lines.where(~chat.is_held_out())))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeats(documents)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.assess(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return codes.compress(rows).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix": op1_suffix,
    "op2_urls": op2_urls,
    "op3_minhash": op3_minhash,
    "op4_chat": op4_chat,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_neighbours": op7_neighbours,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_lines": op10_lines,
    "op11_repair": op11_repair,
    "op12_bpe": op12_bpe,
    "op13_codes": op13_codes,
}

ORACLES: dict[str, str] = {
    "op2_urls": urls.oracle(),
}
