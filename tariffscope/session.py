"""A session with the settings these jobs are planned for."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split an over-full join partition even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Start from many shuffle partitions; adaptive execution merges the small ones.
    "spark.sql.shuffle.partitions": "10000",
    # Fewer, larger scan tasks keep the number of shuffle blocks down.
    "spark.sql.files.maxPartitionBytes": "512MB",
}


def build_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """``settings`` are written with double underscores for dots; they, and what the cluster
    or spark-submit sets, come before the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    chosen = {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if key not in chosen and not given.contains(key):
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """The shared checkpoint folder the cluster names; ``fallback`` only where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or fallback)
    return context.getCheckpointDir()


def _checkpoint_root(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    Only a local session, whose tasks all run on this machine, may name none.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return ensure_checkpoint_dir(spark, named or tempfile.mkdtemp(prefix="checkpoints-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not yet made, below the checkpoint folder."""
    return f"{_checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` run and stored in the checkpoint folder; what follows starts from there."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint()
