"""Compare every query with its oracle: ``python -m testbed.check [sf_dir] [name ...]``."""

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from tariffscope.session import build_session

from .oracle import ORACLES
from .registry import QUERIES


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
          "BOOLEAN": "boolean", "DATE": "date"}


def _sort_key(row: tuple):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def mismatch(spark: SparkSession, connection, name: str, sf_dir: str) -> str | None:
    """What differs between a query and its oracle, as multisets of rows with types."""
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    mine = [tuple(r) for r in result.select(*columns).collect()]
    relation = connection.sql(ORACLES[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    if sorted(types) != columns:
        return f"columns {columns} != {sorted(types)}"
    my_types = dict(result.select(*columns).dtypes)
    theirs_types = {c: _KINDS.get(t, t) for c, t in types.items()}
    if my_types != theirs_types:
        return f"types {my_types} != {theirs_types}"
    theirs = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    theirs = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in theirs]
    mine, theirs = sorted(mine, key=_sort_key), sorted(theirs, key=_sort_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    differing = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failures = 0
    for name in names or QUERIES:
        start = time.perf_counter()
        problem = mismatch(spark, connection, name, sf_dir)
        failures += problem is not None
        print(f"{name:35s} {time.perf_counter() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(bool(main(directory, sys.argv[2:])))
