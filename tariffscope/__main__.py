"""Run everything over stored tables: ``python -m tariffscope TABLES OUT``.

Reads the five tables under TABLES, writes the marts to OUT/marts and every result to
OUT/results.  The master and further settings come from spark-submit.
"""

import argparse

from .plans import build, jobs
from .session import build_session
from .sources import readers
from .sources.writers import WRITERS

SOURCES = {"parquet": readers.catalogue_from_parquet, "csv": readers.catalogue_from_csv}


def run(spark, tables: str, out: str, source: str, format: str) -> list[str]:
    """Write marts and results; returns the names of the results."""
    catalogue = SOURCES[source](spark, tables)
    stored = build.write_marts(catalogue, f"{out}/marts", format)
    results = jobs.catalogue_results(catalogue) | jobs.mart_results(stored)
    for name, df in results.items():
        WRITERS[format](df, f"{out}/results/{name}")
    return list(results)


def main() -> None:
    parser = argparse.ArgumentParser(prog="tariffscope", description=__doc__)
    parser.add_argument("tables", help="folder of the five stored tables")
    parser.add_argument("out", help="folder to write to")
    parser.add_argument("--source", choices=SOURCES, default="parquet", help="format of TABLES")
    parser.add_argument("--format", choices=WRITERS, default="parquet", help="format of OUT")
    options = parser.parse_args()
    spark = build_session("tariffscope")
    run(spark, options.tables, options.out, options.source, options.format)
    spark.stop()


if __name__ == "__main__":
    main()
