"""Every search method on every dimension, with measured time and measured recall."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators.graph import DEGREE, EF, graph_build, graph_search, graph_walk
from quillvec.operators.ivf import ivf_build, ivf_search, ivf_train
from quillvec.operators.lsh import hyperplanes, lsh_assign, lsh_search
from quillvec.operators.recall import recall_at_k
from quillvec.operators.report import latency_stats
from quillvec.operators.search import K_VALUES, knn
from quillvec.schemas import BENCHMARK
from quillvec.session import durable, scratch_path
from quillvec.sources.vectors import stack


@dataclass(frozen=True)
class Method:
    """``build`` makes an index table from vectors; ``search`` answers queries from it.

    The answers of an ``exact`` method are the truth for later ones with the same metric.
    """

    library: str
    index_type: str
    build: Callable[[DataFrame, int], object]
    search: Callable[[DataFrame, object, int], DataFrame]
    metric: str = "ip"
    exact: bool = False


def _as_is(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors


def flat_ip() -> Method:
    return Method("block", "exact inner product", _as_is, lambda q, v, k: knn(q, v, k, "ip"), exact=True)


def flat_l2() -> Method:
    return Method("block", "exact Euclidean", _as_is, lambda q, v, k: knn(q, v, k, "l2"), "l2", True)


def inverted_file(nprobe: int, nlist: int | None = None, seed: int = 0) -> Method:
    def build(vectors: DataFrame, dim: int):
        centroids = ivf_train(vectors, nlist, seed)
        return centroids, ivf_build(vectors, centroids, scratch_path(vectors.sparkSession, "cells"))

    return Method(
        "inverted file", f"nprobe={nprobe}", build, lambda q, built, k: ivf_search(q, built[1], built[0], k, nprobe)
    )


def signed_planes(tables: int = 16, bits: int = 8, seed: int = 0) -> Method:
    def build(vectors: DataFrame, dim: int):
        planes = hyperplanes(vectors.sparkSession, dim, tables, bits, seed)
        path = scratch_path(vectors.sparkSession, "buckets")
        lsh_assign(vectors, planes, bits).write.option("compression", "zstd").parquet(path)
        return planes, vectors.sparkSession.read.parquet(path)

    return Method(
        "hyperplanes", f"tables={tables}, bits={bits}", build, lambda q, built, k: lsh_search(q, built[1], built[0], bits, k)
    )


def neighbour_graphs(ef: int = EF, degree: int = DEGREE) -> Method:
    def build(vectors: DataFrame, dim: int):
        return graph_build(vectors, scratch_path(vectors.sparkSession, "graph"), "ip", degree=degree)

    return Method(
        "neighbour graph", f"ef={ef}", build, lambda q, built, k: graph_search(graph_walk(q, built, k, ef), k)
    )


TIMING_ROWS = "library string, index_type string, dimension int, query_id int, seconds double"
FAILURE = "library string, index_type string, dimension int, failure string"


def search_sweep(
    vectors: DataFrame,
    queries: DataFrame,
    methods: Sequence[Method],
    dims: Sequence[int],
    k: int = max(K_VALUES),
    recall_k: int = 10,
    batches: int = 3,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(hits, results, failures)`` of each method on each dimension.

    ``vectors(vec_id, dim, embedding)`` and ``queries(query_id, dim, qv)`` may hold many
    dimensions. A method that fails on a dimension is a row of ``failures`` and the sweep goes on. The queries are
    answered in ``batches`` jobs; each gives one time per query, with fetching the queries and writing the answers,
    and ``latency_stats`` their mean and deviation. ``memory_usage_mb`` is null: a task's memory is not the method's.
    """
    spark = vectors.sparkSession
    hits, runs, times, recalls, failures = [], [], [], [], []
    stored, asking = (
        {r["dim"]: r["count"] for r in df.filter(F.col("dim").isin(*dims)).groupBy("dim").count().collect()}
        for df in (vectors, queries)
    )
    for dim in dims:
        base = vectors.filter(F.col("dim") == dim)
        asked = queries.filter(F.col("dim") == dim)
        n, n_queries = stored.get(dim, 0), asking.get(dim, 0)
        if n == 0 or n_queries == 0:
            failures.append(("", "", dim, f"no vectors or no queries of dimension {dim}"))
            continue
        parts = [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b) for b in range(batches)]
        sizes = dict(asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")).count().collect())
        truth: dict[str, DataFrame] = {}
        for method in methods:
            try:
                begin = time.perf_counter()
                built = method.build(base, dim)
                took, found = time.perf_counter() - begin, []
                measured = []
                for b, part in enumerate(parts):
                    if sizes.get(b):
                        start = time.perf_counter()
                        found.append(durable(method.search(part, built, k)))
                        measured.append((b, (time.perf_counter() - start) / sizes[b]))
                answers = stack(found)
                if method.metric not in truth:
                    truth[method.metric] = answers if method.exact else durable(knn(asked, base, k, method.metric))
                run = len(runs) + 1
                recall = recall_at_k(answers, truth[method.metric], [min(recall_k, k)])
                recalls.append(recall.select(F.lit(run).alias("run_no"), F.col("recall").alias("recall_at_k")))
                runs.append((run, method.library, method.index_type, dim, n, took, None))
                times += [(method.library, method.index_type, dim, b, seconds) for b, seconds in measured]
                names = {"library": method.library, "index_type": method.index_type, "dimension": dim}
                hits.append(answers.withColumns({name: F.lit(value) for name, value in names.items()}))
            except Exception as problem:
                failures.append((method.library, method.index_type, dim, f"{type(problem).__name__}: {problem}"))
    failed = spark.createDataFrame(failures, FAILURE)
    if not hits:
        raise RuntimeError(f"every method failed: {failures}")
    columns = [c.split()[0] for c in BENCHMARK.split(", ")]
    built = "run_no int, library string, index_type string, dimension int, num_vectors bigint, build_time double, memory_usage_mb double"
    keys = ["library", "index_type", "dimension"]
    stats = latency_stats(spark.createDataFrame(times, TIMING_ROWS)).drop("n_queries")
    results = spark.createDataFrame(runs, built).join(stats, keys).join(stack(recalls), "run_no")
    return stack(hits), durable(results.select("run_no", *columns)), failed
