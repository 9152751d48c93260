"""A quantiser of two levels, for as many cells as a large table needs.

``nlist`` cells are found as about its root of coarse cells, each divided by a k-means of its own into cells in proportion to the vectors it
holds. A vector is compared with the coarse centroids and then with those of its coarse cell: two root-sized products instead of one with
all ``nlist`` centroids, which no task ever holds together.

The coarse level trains on all vectors, a coarse cell's own k-means on at most ``SAMPLE_ROWS`` of its vectors (those of smallest hash;
the window limit works before the shuffle). A coarse cell with most vectors is assigned in slices, each beside a copy of its centroids.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.functions.vector import inner_product
from quillvec.operators.blockscan import block_topk, check_policy, full_matrix, usable_rows
from quillvec.operators.ivf import best_rows, ivf_assign, ivf_train
from quillvec.operators.search import knn
from quillvec.session import stored

SAMPLE_ROWS = 32_768
SLICE_BYTES = 32 << 20


@dataclass(frozen=True)
class Quantiser:
    """``coarse(cell, c)`` and ``fine(coarse, cell, c)``; the cells of all coarse cells are numbered through."""

    coarse: DataFrame
    fine: DataFrame
    dim: int


def _directions(points: np.ndarray) -> np.ndarray:
    norms = np.sqrt((points * points).sum(axis=1, keepdims=True))
    return np.divide(points, norms, out=np.zeros_like(points), where=norms > 0)


def spherical_means(points: np.ndarray, k: int, seed: int, max_iter: int) -> np.ndarray:
    """At most ``k`` unit centroids of a bounded sample; a centroid that loses all points starts again at the worst placed one."""
    points = np.unique(_directions(points.astype(np.float64)), axis=0)
    points = points[(points != 0).any(axis=1)] if len(points) > 1 else points
    k = min(k, len(points))
    rng = np.random.default_rng(seed)
    centers = points[np.sort(rng.choice(len(points), k, replace=False))]
    for _ in range(max_iter):
        scores = points @ centers.T
        of = scores.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, points)
        empty = np.flatnonzero(np.bincount(of, minlength=k) == 0)
        sums[empty] = points[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        moved = _directions(sums)
        if np.allclose(moved, centers, atol=1e-9):
            break
        centers = moved
    return centers


def quantiser_train(vectors: DataFrame, nlist: int, seed: int = 0, max_iter: int = 20) -> Quantiser:
    """Cells for ``vectors(vec_id, embedding)``: about ``nlist``, fewer where a coarse cell has fewer distinct vectors."""
    rows = vectors.select("vec_id", "embedding")
    coarse = stored(ivf_train(rows, max(1, ceil(sqrt(nlist))), seed, max_iter), "coarse-centroids")
    placed = stored(ivf_assign(rows.where(inner_product(F.col("embedding"), F.col("embedding")) > 0), coarse), "coarse-cells")
    # One row per coarse cell, a root of nlist.
    sizes = dict(placed.groupBy("cell").count().collect())
    total = sum(sizes.values())
    wanted = {cell: max(1, round(nlist * n / total)) for cell, n in sizes.items()}
    order = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = placed.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= SAMPLE_ROWS).select("cell", "embedding")

    def divide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        centers = spherical_means(full_matrix(table["embedding"]), wanted[cell], seed, max_iter)
        number = pa.array(range(len(centers)), pa.int32())
        return pa.table([pa.array([cell] * len(centers), pa.int32()), number, pa.array(list(centers), pa.list_(pa.float64()))], names=["coarse", "number", "c"])

    fine = stored(sample.groupBy("cell").applyInArrow(divide, "coarse int, number int, c array<double>"), "divided-cells")
    counts = sorted(fine.groupBy("coarse").count().collect())
    offsets = list(zip([c for c, _ in counts], [0, *accumulate(n for _, n in counts)]))
    first = vectors.sparkSession.createDataFrame(offsets or [], "coarse int, first int")
    fine = fine.join(F.broadcast(first), "coarse").select("coarse", (F.col("first") + F.col("number")).alias("cell"), "c")
    dim = coarse.select(F.size("c")).first()[0]
    return Quantiser(coarse, stored(fine, "fine-centroids"), dim)


def quantiser_assign(vectors: DataFrame, tree: Quantiser, on_unusable: str = "error", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Adds ``cell``: of the cells within the best coarse cell that with the largest inner product, ties to the lowest.

    The vectors are shuffled once, by coarse cell and slice. A vector that cannot be compared is an error, or with ``"skip"`` left out.
    """
    check_policy(on_unusable)
    kept = T.StructType(vectors.schema.fields + [T.StructField("cell", T.IntegerType())])
    place = ["__coarse", "__slice"]
    placed = ivf_assign(vectors, tree.coarse, on_unusable).withColumnRenamed("cell", "__coarse").where(F.col("__coarse").isNotNull())
    rows = max(1, slice_bytes // (8 * tree.dim))
    sizes = placed.groupBy("__coarse").agg(F.ceil(F.count("*") / rows).cast("int").alias("__slices"))
    sizes = stored(sizes, "coarse-slices")
    cut = F.pmod(F.xxhash64(*vectors.columns), F.col("__slices")).cast("int")
    dealt = placed.join(sizes, "__coarse").withColumn("__slice", cut).drop("__slices")
    copies = tree.fine.withColumnRenamed("coarse", "__coarse").join(sizes, "__coarse")
    copies = copies.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))).drop("__slices")
    names = vectors.columns

    def assign(some: pa.Table, centroids: pa.Table) -> pa.Table:
        some = some.select(names)
        if some.num_rows == 0:
            return some.append_column("cell", pa.array([], pa.int32()))
        centroids = centroids.sort_by("cell")
        _, values = usable_rows(some["embedding"].combine_chunks(), tree_dim, "error")
        best = best_rows(values, full_matrix(centroids["c"]))
        return some.append_column("cell", pa.array(centroids["cell"].to_numpy()[best], pa.int32()))

    tree_dim = tree.dim
    return dealt.groupBy(*place).cogroup(copies.groupBy(*place)).applyInArrow(assign, kept)


def quantiser_visits(queries: DataFrame, tree: Quantiser, nprobe: int, coarse_probe: int, **limits) -> DataFrame:
    """``(query_id, qv, parts)``: the best ``nprobe`` cells of each query within its best ``coarse_probe`` coarse cells."""
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "qv")
    coarse = tree.coarse.select(F.col("cell").alias("vec_id"), F.col("c").alias("embedding"))
    near = knn(queries, coarse, coarse_probe, "ip", **limits).groupBy("query_id").agg(F.collect_list("vec_id").alias("parts"))
    cells = tree.fine.select(F.col("cell").alias("vec_id"), F.col("c").alias("embedding"), "coarse")
    best = block_topk(queries.join(near, "query_id"), cells, nprobe, "ip", part="coarse", **limits)
    parts = best.groupBy("query_id").agg(F.collect_list("vec_id").alias("parts"))
    return queries.join(parts, "query_id")


def quantiser_search(
    queries: DataFrame, index: DataFrame, tree: Quantiser, k: int, nprobe: int, coarse_probe: int, metric: str = "ip", **limits
) -> DataFrame:
    """Exact top-k inside the visited cells. ``index`` is an assigned table, best stored by cell (``sources.vectors.write_vectors``)."""
    return block_topk(quantiser_visits(queries, tree, nprobe, coarse_probe, **limits), index, k, metric, part="cell", **limits)


def agreement(vectors: DataFrame, tree: Quantiser) -> DataFrame:
    """``(n, agree)``: vectors, and those whose cell is the best of all cells, as a flat assignment finds it."""
    flat = ivf_assign(vectors.select("vec_id", "embedding"), tree.fine.select("cell", "c")).select("vec_id", F.col("cell").alias("flat"))
    both = quantiser_assign(vectors.select("vec_id", "embedding"), tree).select("vec_id", "cell").join(flat, "vec_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("cell") == F.col("flat")).alias("agree"))
