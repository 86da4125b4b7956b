"""Writers."""

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition; missing values become blank cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


WRITERS = {"parquet": write_parquet, "csv": write_csv}


def save_per_entity(df: DataFrame, table: str, buckets: int) -> None:
    """Save a frame holding one row per entity as a table bucketed by entity.

    Such tables join on the entity without a shuffle.  Only for unique keys: the
    raw offers or attributes of one entity may be a large part of all rows, and a
    bucket is read by one task.
    """
    (
        df.repartition(buckets, "entity_id")
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, "entity_id")
        .sortBy("entity_id")
        .saveAsTable(table)
    )
