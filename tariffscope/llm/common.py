"""What the operators share: a folder that all executors see, and keys of documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A temporary one is made only for a local
    session that names none: all its tasks run on this machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return ensure_checkpoint_dir(spark, named or tempfile.mkdtemp(prefix="checkpoints-"))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_OPENED: ContextVar[list[Scratch] | None] = ContextVar("opened", default=None)


class Scratch:
    """Tables written to a new shared folder and read back. They cut the lineage: what
    follows neither recomputes what came before nor depends on any one executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if (opened := _OPENED.get()) is not None:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` stored; the shuffle files of making it go at once, nothing reads them again."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(self.path(name))

    def drop_all(self) -> None:
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def passing() -> Iterator[None]:
    """Whatever tables are stored inside go at the end: results that still read them have to be stored before, by a
    Scratch from outside."""
    token = _OPENED.set([])
    try:
        yield
    finally:
        for scratch in _OPENED.get():
            scratch.drop_all()
        _OPENED.reset(token)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until none of the ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used afterwards:
    the optimizer copies an expression into its uses, but not through a generator. (For generators that are not
    outer ones it also adds filters, which compute their lists once more.)"""
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def document_key() -> tuple[Column, Column]:
    """Columns that tell documents apart, null ids included. Rows that agree in id and text
    have the same key."""
    return F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc"), F.xxhash64("doc_id", "text").alias("doc_hash")
