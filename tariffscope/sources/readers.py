"""Readers.  Schemas are declared, never inferred."""

from pyspark.sql import DataFrame, SparkSession

from .catalogue import Catalogue, catalogue_of
from .roles import MART_SCHEMAS, ROLES, Role

Renamed = dict[str, dict[str, str]]  # role -> {role column: stored column}


def _roles(renamed: Renamed | None) -> dict[str, Role]:
    return {name: role.stored_with((renamed or {}).get(name, {})) for name, role in ROLES.items()}


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; a blank cell is missing, a quote inside a cell is doubled.

    ``multi_line`` is needed only where cells hold line breaks; it makes each file one task.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def catalogue_from_parquet(spark: SparkSession, root: str, renamed: Renamed | None = None) -> Catalogue:
    """The five stored tables as ``<root>/<table>`` Parquet."""
    return catalogue_of(
        {
            name: role.to_role(read_parquet(spark, f"{root}/{role.table}", role.stored_schema))
            for name, role in _roles(renamed).items()
        }
    )


def catalogue_from_csv(
    spark: SparkSession, root: str, renamed: Renamed | None = None, multi_line: bool = False
) -> Catalogue:
    """The five stored tables as ``<root>/<table>.csv``."""
    return catalogue_of(
        {
            name: role.to_role(
                read_csv(spark, f"{root}/{role.table}.csv", role.stored_schema, multi_line)
            )
            for name, role in _roles(renamed).items()
        }
    )


def jdbc_options(role: Role, url: str, id_bounds: tuple[int, int], partitions: int) -> dict[str, str]:
    """Options that read one stored table in ``partitions`` parallel ranges of its id."""
    return {
        "url": url,
        "dbtable": role.table,
        "partitionColumn": role.columns[0].stored_as,
        "lowerBound": str(id_bounds[0]),
        "upperBound": str(id_bounds[1]),
        "numPartitions": str(partitions),
    }


def catalogue_from_jdbc(
    spark: SparkSession,
    url: str,
    id_bounds: dict[str, tuple[int, int]],
    partitions: int = 64,
    renamed: Renamed | None = None,
    **options: str,
) -> Catalogue:
    """The five stored tables in a database; needs its driver on the class path.

    ``id_bounds`` gives each role's lowest and highest id, which only set how the
    reading is divided: ids outside them are read too.
    """
    roles = {}
    for name, role in _roles(renamed).items():
        reader = spark.read.format("jdbc").options(**options)
        stored = reader.options(**jdbc_options(role, url, id_bounds[name], partitions)).load()
        roles[name] = role.to_role(stored)
    return catalogue_of(roles)


def read_mart(spark: SparkSession, root: str, name: str, format: str = "parquet") -> DataFrame:
    """A mart written by ``plans.build.write_marts``."""
    reader = read_csv if format == "csv" else read_parquet
    return reader(spark, f"{root}/{name}", MART_SCHEMAS[name])


def create_views(frames: dict[str, DataFrame]) -> None:
    """Register frames under their names, so ``spark.sql`` can query them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def catalogue_views(catalogue: Catalogue) -> None:
    """Register the role frames under the names of the stored tables."""
    create_views({ROLES[name].table: df for name, df in catalogue.roles.items()})
