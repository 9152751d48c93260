"""Times the registered queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_ONLY`` an
optional comma-separated choice of queries. Each query is run to completion without collecting
its rows, in two rounds over all queries; the faster time counts, so that class loading and code
generation do not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillvec.plans.catalogue import QUERIES  # noqa: E402
from quillvec.session import build_session  # noqa: E402


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    rounds = [{name: run(spark, folder, name) for name in names} for _ in range(2)]
    times = {name: round(min(taken[name] for taken in rounds), 3) for name in names}
    scale = os.path.basename(folder.rstrip("/"))
    print(
        json.dumps(
            {"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
