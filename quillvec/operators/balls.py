"""Exact Euclidean search that leaves out whole balls by the triangle inequality.

Vectors lie in the cell of their nearest centre and, by their distance to it, in one of its shells; a shell of a cell is a ball with an
inner and an outer radius. No vector of a ball is nearer to a query than the outer radius, or the distance to the inner one, allows. A search first scans
the balls of a query's nearest cells, which gives a k-th distance, and then only the other balls that may hold something nearer. The answers are
those of ``knn(..., "l2")``, bit for bit; how much is left out depends on the data, and ``Visits`` tells it.

Shells cut a cell that holds most vectors into several balls. Only equal distances cannot be parted: copies of one vector are one ball, which
several writers store and several tasks scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.functions.vector import as_double, euclidean, inner_product
from quillvec.operators.blockscan import PASS_BYTES, BLOCK_BYTES, block_topk, fetch_probes, matrix_of, rank_hits
from quillvec.operators.ivf import cell_count, ivf_assign
from quillvec.operators.search import knn
from quillvec.session import durable, stored
from quillvec.sources.vectors import stack, write_vectors

#: Vectors of a ball, about, and shells of a cell at most.
BALL_ROWS, SHELLS = 10_000, 64
#: Queries and balls whose bounds are computed at once: the dozen temporary arrays have 2 MB each.
_BOUND_QUERIES, _BOUND_BALLS = 1024, 256
BALL = "ball int, cell int, c array<double>, inner double, outer double, n bigint"
#: Stands for "nothing known yet" beside the finite components of a query.
_FAR = 1e300


def ball_train(vectors: DataFrame, nlist: int | None = None, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """Centres ``(cell, c)`` by k-means over all vectors."""
    nlist = nlist or cell_count(vectors.count())
    features = vectors.select(array_to_vector(as_double(F.col("embedding"))).alias("features"))
    centers = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(features).clusterCenters()
    cells = pa.array(range(len(centers)), pa.int32())
    return vectors.sparkSession.createDataFrame(pa.table({"cell": cells, "c": pa.array(centers, pa.list_(pa.float64()))}))


def _nearest_cell(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """``(vec_id, embedding, cell)`` by Euclidean distance: as ``v.c - |c|^2 / 2`` is largest for the nearest centre, one more
    component turns it into an inner product."""
    lifted = vectors.select("vec_id", F.col("embedding").alias("v"), F.concat(as_double(F.col("embedding")), F.array(F.lit(1.0))).alias("embedding"))
    c = F.col("c")
    turned = centres.select("cell", F.concat(c, F.array(inner_product(c, c) / -2.0)).alias("c"))
    return ivf_assign(lifted, turned).select("vec_id", F.col("v").alias("embedding"), "cell")


def ball_build(vectors: DataFrame, centres: DataFrame, path: str, ball_rows: int = BALL_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(index, balls)``: the vectors stored below ``ball=`` folders, and one row per ball. Every vector must have the centres' dimension."""
    placed = _nearest_cell(vectors.select("vec_id", "embedding"), centres).join(centres, "cell")
    placed = stored(placed.withColumn("far", euclidean(F.col("c"), F.col("embedding"))).drop("c"), "ball-distances")
    cuts = F.percentile_approx("far", [i / SHELLS for i in range(1, SHELLS)], 10 * SHELLS)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), cuts.alias("cuts"))
    pieces = F.least(F.lit(SHELLS), F.ceil(F.col("n") / ball_rows))
    cells = cells.select("cell", "cuts", pieces.cast("int").alias("pieces"))
    passed = F.size(F.filter("cuts", lambda cut: cut < F.col("far")))
    shell = F.floor(passed * F.col("pieces") / SHELLS).cast("int")
    dealt = placed.join(cells, "cell").withColumn("ball", F.col("cell") * SHELLS + shell)
    write_vectors(dealt.select("vec_id", "embedding", "far", "ball"), path, "ball", 100 * ball_rows, rebalance=True)
    index = vectors.sparkSession.read.schema(f"vec_id bigint, embedding {dict(vectors.dtypes)['embedding']}, far double, ball int").parquet(path)
    sizes = index.groupBy("ball").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.count("*").alias("n"))
    balls = sizes.withColumn("cell", F.floor(F.col("ball") / SHELLS).cast("int")).join(centres, "cell")
    return index, stored(balls.select([f.split()[0] for f in BALL.split(", ")]), "balls")


@dataclass(frozen=True)
class Visits:
    """A first scan's answers, and ``(query_id, ball, n, first)`` of every ball a query is scanned against."""

    hits: DataFrame
    balls: DataFrame

    def rows(self) -> DataFrame:
        """``(query_id, visited)``: the vectors each query is compared with."""
        return self.balls.groupBy("query_id").agg(F.sum("n").alias("visited"))


def ball_visits(
    queries: DataFrame, index: DataFrame, balls: DataFrame, k: int, first: int = 1, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES
) -> Visits:
    """Scans the balls of each query's ``first`` nearest cells, and picks the others that its k-th distance does not exclude."""
    limits = {"block_bytes": block_bytes, "pass_bytes": pass_bytes}
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "qv")
    centres = balls.groupBy("cell").agg(F.any_value("c").alias("embedding")).withColumnRenamed("cell", "vec_id")
    cells = knn(queries, centres, first, "l2", **limits).select("query_id", F.col("vec_id").cast("int").alias("cell"))
    begun = durable(cells.join(balls.select("cell", "ball", "n"), "cell").select("query_id", "ball", "n"))
    hits = durable(_scan(queries, begun, index, k, limits))
    kth = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    bound = F.coalesce("kth", F.lit(_FAR))
    asked = queries.join(kth, "query_id", "left").select("query_id", F.concat(as_double(F.col("qv")), F.array(bound)).alias("qv"))
    near = _within(asked, balls, block_bytes, pass_bytes)
    rest = near.join(begun.select("query_id", "ball"), ["query_id", "ball"], "left_anti").withColumn("first", F.lit(False))
    return Visits(hits, durable(begun.withColumn("first", F.lit(True)).unionByName(rest)))


def _scan(queries: DataFrame, visits: DataFrame, index: DataFrame, k: int, limits: dict) -> DataFrame:
    parts = visits.groupBy("query_id").agg(F.collect_list(F.col("ball").cast("bigint")).alias("parts"))
    return block_topk(queries.join(parts, "query_id"), index, k, "l2", part="ball", **limits)


def _within(asked: DataFrame, balls: DataFrame, block_bytes: int, pass_bytes: int) -> DataFrame:
    """``(query_id, ball, n)`` of the balls that may hold a vector within each query's bound, its last component."""
    blocks, _ = fetch_probes(asked, block_bytes)
    per_pass = max(1, pass_bytes // block_bytes)

    def near(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _holders(shared.value, batch)

        return run

    passes = []
    for at in range(0, len(blocks), per_pass):
        shared = balls.sparkSession.sparkContext.broadcast([(b.query_ids, b.queries) for b in blocks[at : at + per_pass]])
        passes.append(balls.mapInArrow(near(shared), "query_id bigint, ball int, n bigint"))
    return stack(passes) if passes else balls.sparkSession.createDataFrame([], "query_id bigint, ball int, n bigint")


def _holders(blocks: list[tuple[np.ndarray, np.ndarray]], balls: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs that ``may_hold`` flags, some queries and balls at a time; a query's bound is its last component."""
    for at in range(0, balls.num_rows, _BOUND_BALLS):
        some = balls.slice(at, _BOUND_BALLS)
        for ids, queries in blocks:
            for first in range(0, len(ids), _BOUND_QUERIES):
                part = queries[first : first + _BOUND_QUERIES]
                q, ball = np.nonzero(may_hold(part[:, :-1], part[:, -1], some))
                columns = [ids[first + q], some["ball"].to_numpy()[ball], some["n"].to_numpy()[ball]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "ball", "n"])


def may_hold(queries: np.ndarray, bounds: np.ndarray, balls: pa.RecordBatch) -> np.ndarray:
    """(queries, balls) flags; rounding only ever keeps a ball."""
    _, centres = matrix_of(balls["c"], queries.shape[1])
    inner, outer = balls["inner"].to_numpy(), balls["outer"].to_numpy()
    q2, c2 = (queries * queries).sum(axis=1)[:, None], (centres * centres).sum(axis=1)
    squares = q2 + c2 - 2.0 * (queries @ centres.T)
    error = 8.0 * (queries.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(q2) + np.sqrt(c2)) ** 2
    low, high = np.sqrt(np.maximum(squares - error, 0.0)), np.sqrt(squares.clip(0) + error)
    slack = 1e-12 * (high + outer)
    return np.maximum(low - outer, inner - high) - slack <= bounds[:, None] * (1 + 1e-12)


def ball_search(queries: DataFrame, index: DataFrame, balls: DataFrame, k: int, visits: Visits | None = None, **limits) -> DataFrame:
    """The exact nearest ``k``: ``(query_id, rank, vec_id, score)``. ``visits`` may come from ``ball_visits`` with the same ``k``."""
    visits = visits or ball_visits(queries, index, balls, k, **limits)
    limits.pop("first", None)
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "qv")
    rest = _scan(queries, visits.balls.where(~F.col("first")), index, k, limits)
    both = visits.hits.unionByName(rest).drop("rank")
    return rank_hits(both, k, "l2")
