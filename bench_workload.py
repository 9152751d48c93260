"""The reference workload at a chosen size: random vectors, 1,000 random queries, k = 100.

``python bench_workload.py FOLDER [vectors] [dim ...]`` generates the vectors below FOLDER once
and prints one JSON line per dimension and method: seconds for all queries, queries per second
and measured recall@10.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402

from quillvec.operators.ivf import ivf_build, ivf_search, ivf_train  # noqa: E402
from quillvec.operators.lsh import hyperplanes, lsh_assign, lsh_search  # noqa: E402
from quillvec.operators.recall import recall_at_k  # noqa: E402
from quillvec.operators.search import knn  # noqa: E402
from quillvec.session import build_session  # noqa: E402
from quillvec.sources.vectors import DIMENSIONS, random_queries, random_vector_table, read_vectors, write_vectors  # noqa: E402


def timed(action):
    start = time.perf_counter()
    value = action()
    return value, round(time.perf_counter() - start, 3)


def main(folder: str, n: int, dims: list[int], n_queries: int = 1000, k: int = 100) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "workload",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "10g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def report(dim, method, seconds, **more):
        print(json.dumps({"vectors": n, "dim": dim, "method": method, "seconds": seconds, **more}), flush=True)

    def answered(dim, method, hits, truth=None, **more):
        rows, seconds = timed(hits.toPandas)
        found = spark.createDataFrame(rows)
        if truth is not None:
            more["recall_at_10"] = round(recall_at_k(found, truth, [10]).first()["recall"], 4)
        report(dim, method, seconds, queries_per_second=round(n_queries / seconds, 1), **more)
        return found

    def one_at_a_time(path, dim, asked):
        """The reference's way of measuring, with NumPy: one matrix, one query per call."""
        column = pq.read_table(path, columns=["embedding"])["embedding"].combine_chunks()
        matrix = column.flatten().to_numpy().reshape(-1, dim)
        start = time.perf_counter()
        for query in asked:
            scores = matrix @ query
            best = np.argpartition(scores, len(scores) - k)[-k:]
            best[np.argsort(-scores[best])]
        seconds = (time.perf_counter() - start) / len(asked)
        report(dim, "NumPy, one query at a time", round(seconds * n_queries, 3), queries_per_second=round(1 / seconds, 1))

    for dim in dims:
        path = f"{folder}/n{n}/d{dim}"
        if not os.path.exists(path):
            _, seconds = timed(lambda: write_vectors(random_vector_table(spark, n, [dim], seed=1), path, max_rows=n))
            report(dim, "generate and store", seconds)
        vectors = read_vectors(spark, path, dim)
        queries = random_queries(spark, dim, n_queries, seed=2)
        one_at_a_time(path, dim, np.random.default_rng(0).standard_normal((50, dim)).astype(np.float32))
        knn(queries.limit(1), vectors, 1).collect()
        exact = answered(dim, "exact inner product", knn(queries, vectors, k, "ip"))
        answered(dim, "exact Euclidean", knn(queries, vectors, k, "l2"))
        centroids, train = timed(lambda: ivf_train(vectors, seed=1))
        index, build = timed(lambda: ivf_build(vectors, centroids, f"{path}-cells-{time.time_ns()}"))
        for nprobe in (1, 8, 32):
            hits = ivf_search(queries, index, centroids, k, nprobe)
            answered(dim, f"cells, nprobe {nprobe}", hits, exact, train=train, build=build)
        planes = hyperplanes(spark, dim, 8, 8, seed=1)
        buckets = f"{path}-buckets-{time.time_ns()}"
        _, build = timed(lambda: lsh_assign(vectors, planes, 8).write.parquet(buckets))
        answered(dim, "hyperplanes 8 x 8", lsh_search(queries, spark.read.parquet(buckets), planes, 8, 10), exact, build=build)


if __name__ == "__main__":
    main(sys.argv[1], int((sys.argv[2:3] or ["100000"])[0]), [int(d) for d in sys.argv[3:]] or list(DIMENSIONS))
