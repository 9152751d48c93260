"""Exact search: inner product and Euclidean top-k, and distances to one query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.vector import euclidean, inner_product
from quillvec.operators.blockscan import block_topk

#: The answer sizes a search is reported at; one search at the largest serves all.
K_VALUES = (1, 10, 100)


def knn(queries: DataFrame, vectors: DataFrame, k: int = max(K_VALUES), metric: str = "ip", **limits) -> DataFrame:
    """Exact top-k per query, ``queries(query_id, qv)`` against ``vectors(vec_id, embedding)``.

    ``metric="ip"`` ranks by inner product, largest first; ``"l2"`` by Euclidean distance,
    smallest first.
    """
    return block_topk(queries, vectors, k, metric, **limits)


def distance_row(query: Column, vectors: DataFrame, metric: str = "l2") -> DataFrame:
    """One query's row of the distance matrix, ``(vec_id, distance)``, as a native projection.

    ``query`` is an array column: a literal or a scalar subquery.
    """
    measure = {"l2": euclidean, "ip": inner_product}[metric]
    # The query is a column of its own first: lambdas may not contain subqueries.
    paired = vectors.select("vec_id", "embedding", query.alias("__query"))
    return paired.select("vec_id", measure(F.col("__query"), F.col("embedding")).alias("distance"))


def argsort_head(distances: DataFrame, k: int = max(K_VALUES)) -> DataFrame:
    """The ``k`` nearest of a distance row; plans as top-k per task, without a full sort."""
    return distances.orderBy("distance", "vec_id").limit(k)


def k_sweep(hits: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """The answers at each k, cut from one search at the largest."""
    wanted = F.explode(F.lit(sorted(ks)).cast("array<int>"))
    return hits.withColumn("k", wanted).filter(F.col("rank") <= F.col("k"))
