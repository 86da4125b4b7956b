"""Documents to packed training sequences, in stages.

Toxic documents go; repeated lines go from the rest; of near-duplicates one stays; documents
that overlap with the benchmark go; what is left is tokenized and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.llm import decontam, lines, minhash, packing, toxicity
from tariffscope.llm.common import Scratch, passing, table
from tariffscope.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from those not held out."""
    model = toxicity.learn(docs, toxicity.train_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).drop("toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that another one, or it itself, has before; a text may become empty."""
    kept = lines.without_repeats(docs).drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
# Learned weights, sampled hashes and a tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        # What a stage stored on its way goes once its rows are written.
        with passing():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{n}-{name}")
        if n:
            scratch.drop(f"{n - 1}-{STAGES[n - 1][0]}")
    return docs
