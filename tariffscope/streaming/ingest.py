"""Loading as files arrive: the first-wins load of ``sources.loading``, batch by batch.

Each batch of new files is written to its own partition of the target, named by the load and
the batch.  A load's name lies in the stream's state folder, so a new state folder starts a
new load beside what is stored, and never overwrites it.  A batch that is run again after a failure sees the
target without its own partition and overwrites it, so nothing is lost or stored twice.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.loading import first_wins
from ..sources.roles import Role

LOAD, BATCH = "load", "batch"


def read_loaded(spark: SparkSession, role: Role, target: str) -> DataFrame:
    """What has been loaded into ``target`` so far, with the load and batch of each row."""
    return spark.read.schema(f"{role.schema}, {LOAD} string, {BATCH} bigint").parquet(target)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _load_name(spark: SparkSession, role: Role, target: str, state: str) -> str:
    """The name kept in ``state``, given at its first use."""
    kept = f"{state}/load_name"
    if not _exists(spark, kept):
        if not role.keys and _exists(spark, target) and not read_loaded(spark, role, target).isEmpty():
            raise ValueError(
                f"{target} holds rows of another load, and rows of {role.table} have no key to tell which"
                " of them would come twice; go on with that load's state"
            )
        spark.range(1).selectExpr(f"'{uuid.uuid4().hex}' AS value").coalesce(1).write.text(kept)
    return spark.read.text(kept).first()["value"]


def load_stream(
    spark: SparkSession, role: Role, source: str, target: str, state: str, order_by: list[str]
) -> StreamingQuery:
    """Load all Parquet files of the role's stored table that have come to ``source``.

    ``state`` is where the stream keeps its progress.  With a new one the files are read again: rows whose keys
    are stored already are passed over, and for tables without keys that is refused.  Returns the started query,
    which ends when the files present have been loaded; run it again for those that come later.
    """
    name = _load_name(spark, role, target, state)

    def load_batch(stored: DataFrame, batch: int) -> None:
        session = stored.sparkSession
        before = None
        if role.keys and _exists(session, target):
            own = (F.col(LOAD) == name) & (F.col(BATCH) >= batch)
            before = read_loaded(session, role, target).filter(~own)
        rows = first_wins(role.to_role(stored), before, role.keys, order_by)
        rows.write.mode("overwrite").parquet(f"{target}/{LOAD}={name}/{BATCH}={batch}")

    return (
        spark.readStream.schema(role.stored_schema)
        .parquet(source)
        .writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
