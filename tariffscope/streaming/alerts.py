"""Price changes as snapshots arrive.

The stream's state folder holds, as tables, each plan's last settled price and the days that may still get snapshots.  A
day is settled when the watermark, the latest day so far less the delay, has passed it: then it is compared with the day settled
before it, as ``plans.history.price_changes`` does in a batch.  So what comes out does not depend on how the log is cut into
batches, or on the order within the delay; snapshots of days that are settled are dropped.

A batch is one batch job: partial aggregates reduce its rows to the last snapshot a plan and day, and windows hold a year of
one plan (``operators.timeline``), so neither many plans nor a plan with a large part of the log is held by one task.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rounding import half_up, percent
from ..operators.timeline import with_neighbour
from ..plans.history import PLAN
from ..sources.roles import PRICE_LOG

_DAY = "recorded_date"
_OPEN = "entity_id bigint, plan_name string, recorded_date date, log_id bigint, price double"
_SETTLED = "entity_id bigint, plan_name string, recorded_date date, price double"
_PASSED = "passed date"

ALERT_SCHEMA = (
    "entity_id bigint, plan_name string, recorded_date date, previous_date date, old_price double, "
    "new_price double, change_pct double"
)


def _snapshots(price_log: DataFrame) -> DataFrame:
    """Rows that tell something; what is not a number counts as a quote on request."""
    told = price_log.filter(f"{_DAY} IS NOT NULL AND log_id IS NOT NULL")
    return told.select(*PLAN, _DAY, "log_id", F.nanvl("price", F.lit(None).cast("double")).alias("price"))


def _watermark(latest: str, delay: str):
    """The last day that is settled: in whole days, so that no time zone's hours count."""
    return F.to_date(F.expr(f"CAST({latest} AS TIMESTAMP_NTZ) - CAST('{delay}' AS INTERVAL)"))


def changes_between(before: DataFrame, settled: DataFrame) -> DataFrame:
    """The changes in ``settled`` (entity_id, plan_name, recorded_date, price), a row a plan and day, given each plan's last
    one ``before``; in the columns of ``price_changes``."""
    known = before.withColumn("is_new", F.lit(False)).unionByName(settled.withColumn("is_new", F.lit(True)))
    found = with_neighbour(known, PLAN, _DAY, [_DAY, "price"])
    old, new = F.col("previous.price"), F.col("price")
    return found.filter(F.col("is_new") & F.col("previous").isNotNull() & ~new.eqNullSafe(old)).select(
        *PLAN,
        _DAY,
        F.col(f"previous.{_DAY}").alias("previous_date"),
        old.alias("old_price"),
        new.alias("new_price"),
        half_up(percent(new - old, old), 2).alias("change_pct"),
    )


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


class _State:
    """What is known after each batch, in folders of its own: a batch that is run again after a failure starts from what the
    one before it left, and overwrites its own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/plans"

    def _path(self, batch: int, name: str = "") -> str:
        return f"{self.folder}/{batch}/{name}".rstrip("/")

    def read(self, batch: int, name: str, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(batch, name))

    def write(self, rows: DataFrame, batch: int, name: str) -> None:
        rows.write.mode("overwrite").parquet(self._path(batch, name))

    def has(self, batch: int, name: str) -> bool:
        return _exists(self.spark, self._path(batch, name))

    def forget(self, batch: int, name: str = "") -> None:
        files, at = _files(self.spark, self._path(batch, name))
        files.delete(at, True)


def alert_stream(
    price_log: DataFrame, target: str, state: str, delay: str = "7 days", least_pct: float = 0.0
) -> StreamingQuery:
    """Store the changes in ``price_log``, a stream in role columns, as Parquet in ``target``.

    ``state`` is where the stream keeps its progress and what it knows of its plans; each change is stored once, also after a
    failure.  Changes of less than ``least_pct`` percent are passed over, those without a percentage are not.  The
    returned query ends when what is there has been read; run it again for what comes later.
    """
    spark = price_log.sparkSession
    known = _State(spark, state)
    wanted = F.coalesce(F.abs("change_pct") >= least_pct, F.lit(True))
    if not _exists(spark, target):
        spark.createDataFrame([], ALERT_SCHEMA).write.parquet(target)

    def settle(batch_rows: DataFrame, batch: int) -> None:
        again = known.has(batch, "writing")
        # A stream's own session plans without adaptive execution; what follows this table is planned by the caller's.
        known.write(_snapshots(batch_rows), batch, "arrived")
        rows = known.read(batch, "arrived", _OPEN)
        first = known.read(batch - 1, "passed", _PASSED).first()
        passed = first["passed"] if first else None
        if passed is not None:
            rows = rows.filter(F.col(_DAY) > F.lit(passed))
        by_day = known.read(batch - 1, "open", _OPEN).unionByName(rows).groupBy(*PLAN, _DAY)
        by_day = by_day.agg(F.max("log_id").alias("log_id"), F.max_by("price", "log_id").alias("price"))
        known.write(by_day, batch, "days")
        days = known.read(batch, "days", _OPEN)
        reached = days.agg(F.max(_DAY).alias("latest")).select(_watermark("latest", delay).alias("passed")).first()["passed"]
        passed = max((d for d in (passed, reached) if d is not None), default=None)
        due = F.lit(False) if passed is None else F.col(_DAY) <= F.lit(passed)
        before, settled = known.read(batch - 1, "settled", _SETTLED), days.filter(due).drop("log_id")
        last = before.unionByName(settled).groupBy(*PLAN).agg(F.max(_DAY).alias(_DAY), F.max_by("price", _DAY).alias("price"))
        known.write(last, batch, "settled")
        known.write(days.filter(~due), batch, "open")
        known.write(spark.createDataFrame([(passed,)], _PASSED).coalesce(1), batch, "passed")
        changes = changes_between(before, settled).filter(wanted)
        if again:
            # A plan's day is settled once, so what is stored of it is from this batch's run before.
            stored = spark.read.schema(ALERT_SCHEMA).parquet(target).select(*(F.col(c).alias(f"stored_{c}") for c in (*PLAN, _DAY)))
            same = [F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in (*PLAN, _DAY)]
            changes = changes.join(stored, same, "left_anti")
        known.write(spark.range(0), batch, "writing")
        changes.write.mode("append").parquet(target)
        known.forget(batch, "arrived")
        known.forget(batch - 1)

    return price_log.writeStream.foreachBatch(settle).option("checkpointLocation", state).trigger(availableNow=True).start()


def price_log_stream(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    """The stored price log's Parquet files as they come to ``source``, in role columns."""
    reader = spark.readStream.schema(PRICE_LOG.stored_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return PRICE_LOG.to_role(reader.parquet(source))
