"""Time every query and print one JSON line.

``BENCH_SF_DIR`` is the data (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
A query's time covers planning and running it to the last row; the result is
written to Spark's no-op sink.  One untimed query goes first, to start the session and
to open the catalogue.
"""

import json
import os
import time

from tariffscope.session import build_session
from testbed.registry import QUERIES


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "entity_mart", sf_dir)
    times = {name: seconds(spark, name, sf_dir) for name in QUERIES}
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total time of all queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
