"""Approximate search over neighbour graphs, one per shard of the vectors.

Vectors are dealt by cell and, inside a large cell, by a hash into shards of bounded size; each is grouped once and becomes a
graph: its nearest neighbours, thinned so that an edge is kept only if no kept edge leads closer to its end, and the same edges
backwards. Every connected component has an entry point, so a search can reach every vector.

A search broadcasts the queries in measured blocks, as the exact scan does, and walks all of them through a shard together: each keeps the ``ef`` best
vectors met so far and opens their neighbours until nothing better turns up. Only vectors that are met are compared; ``visits`` counts
them. With cells a search reads the probed ``cell=`` folders alone. Scores are exact DOUBLE sums, equal bit for bit to ``knn``; only k rows per query
and task are shuffled. With ``ef`` as large as a shard every vector of it is met, and the answer is exact.

Inner products have no triangle inequality, so such a graph is built on vectors that are lifted to equal length by one more component, where
the nearest one has the largest product; edges to the vectors with the largest products are added, as queries are not lifted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators.blockscan import (
    BLOCK_BYTES,
    METRICS,
    PARTIAL,
    PASS_BYTES,
    BlockTopK,
    check_policy,
    exact_keys,
    fetch_probes,
    rank_hits,
    usable_rows,
)
from quillvec.operators.ivf import ivf_assign
from quillvec.operators.search import knn
from quillvec.sources.vectors import stack

#: Fixed value: the benchmark's ``ef``.
EF = 50
#: Edges per vector (as many again lead back) and nearest vectors that they are chosen from.
DEGREE, CANDIDATES = 16, 48
#: Vectors of one shard: at most so many, and so many bytes.
SHARD_ROWS, SHARD_BYTES = 8192, 8 << 20
_TILE = 256  # queries that walk together
_OPENED = 4  # vectors that a query opens in one step
_WORK_BYTES = 32 << 20

SHARD = "cell int, piece int, ids array<bigint>, vectors {}, edges array<int>, entries array<int>"
WALK = f"{PARTIAL}, visited bigint"


# -- building ------------------------------------------------------------------------------


def _lifted(values: np.ndarray, metric: str) -> np.ndarray:
    points = values.astype(np.float64)
    if metric == "ip":
        squares = (points * points).sum(axis=1)
        points = np.column_stack([points, np.sqrt(squares.max(initial=0.0) - squares)])
    return points


def _between(left: np.ndarray, right: np.ndarray, product: bool) -> np.ndarray:
    """Squared distances of all rows of two matrices (or stacks of them); with ``product`` negative inner products."""
    dots = left @ np.swapaxes(right, -1, -2)
    if product:
        return -dots
    return (left * left).sum(axis=-1)[..., None] + (right * right).sum(axis=-1)[..., None, :] - 2.0 * dots


def _nearest(points: np.ndarray, width: int, product: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest others of every point, nearest first, and how far they are."""
    n = len(points)
    near, far = np.empty((n, width), np.int64), np.empty((n, width))
    step = max(1, _WORK_BYTES // (8 * n))
    for at in range(0, n, step):
        some = points[at : at + step]
        d = _between(some, points, product)
        d[np.arange(len(some)), np.arange(at, at + len(some))] = np.inf
        best = np.argpartition(d, width - 1, axis=1)[:, :width]
        order = np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable")
        near[at : at + step] = np.take_along_axis(best, order, axis=1)
        far[at : at + step] = np.take_along_axis(d, near[at : at + step], axis=1)
    return near, far


def _thinned(points: np.ndarray, near: np.ndarray, far: np.ndarray, degree: int, product: bool) -> np.ndarray:
    """Flags of the chosen neighbours: not closer to one chosen before than to the point itself; then the nearest others."""
    n, width = near.shape
    chosen = np.zeros((n, width), bool)
    step = max(1, _WORK_BYTES // (8 * width * max(width, points.shape[1])))
    for at in range(0, n, step):
        ends, reach = points[near[at : at + step]], far[at : at + step]
        between, kept = _between(ends, ends, product), np.zeros(reach.shape, bool)
        for j in range(width):
            hidden = (kept & (between[:, :, j] < reach[:, j : j + 1])).any(axis=1)
            kept[:, j] = ~hidden & (kept.sum(axis=1) < degree)
        first = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
        np.put_along_axis(chosen[at : at + step], first, True, axis=1)
    return chosen


def _edges(points: np.ndarray, degree: int, candidates: int, product: bool = False) -> np.ndarray:
    """``degree`` edges from every point, and up to as many of those that lead to it, turned round."""
    edges = np.full((len(points), 2 * degree), -1, np.int32)
    near, far = _nearest(points, min(candidates, len(points) - 1), product)
    chosen = _thinned(points, near, far, degree, product)
    at, column = np.nonzero(chosen)
    to, reach = near[at, column], far[at, column]
    edges[at, np.cumsum(chosen, axis=1)[at, column] - 1] = to
    back = np.lexsort((at, reach, to))
    place = np.arange(len(back)) - np.searchsorted(to[back], to[back])
    some = back[place < degree]
    edges[to[some], degree + place[place < degree]] = at[some]
    return edges


def _entries(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The point nearest to the mean, and one more for every part of the graph that is not reached from those before."""
    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    reached, entries, at = np.zeros(len(points), bool), [], middle
    while True:
        entries.append(at)
        reached[at] = True
        front = np.array([at])
        while len(front):
            ends = np.unique(edges[front])
            front = ends[(ends >= 0) & ~reached[ends]]
            reached[front] = True
        missed = np.flatnonzero(~reached)
        if len(missed) == 0:
            return np.array(entries, np.int32)
        at = int(missed[0])


def neighbour_graph(values: np.ndarray, metric: str, degree: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """``(edges, entries)`` of a bounded set of vectors; an edge of -1 is none."""
    points = _lifted(values, metric)
    if len(points) == 1:
        return np.full((1, 1), -1, np.int32), np.zeros(1, np.int32)
    edges = _edges(points, degree, candidates)
    if metric == "ip":
        edges = np.hstack([edges, _edges(values.astype(np.float64), degree, candidates, product=True)[:, :degree]])
    return edges, _entries(points, edges)


def graph_build(
    vectors: DataFrame,
    path: str,
    metric: str = "ip",
    centroids: DataFrame | None = None,
    degree: int = DEGREE,
    candidates: int = CANDIDATES,
    on_unusable: str = "error",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Graphs of ``vectors(vec_id, embedding)``, stored below ``cell=`` folders, one row per shard.

    With ``centroids`` a vector lies in the cell of the best one, else all lie in cell 0. The vectors are shuffled once. Ids should
    be unique: rows of one id go to one shard.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    check_policy(on_unusable)
    schema = SHARD.format(dict(vectors.dtypes)["embedding"])  # components are kept as they are
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    celled = vectors.withColumn("cell", F.lit(0)) if centroids is None else ivf_assign(vectors, centroids, on_unusable)
    celled = celled.where(F.col("cell").isNotNull())
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    wanted = F.least(F.lit(shard_rows), F.greatest(F.lit(64), F.lit(SHARD_BYTES) / (4 * F.col("dim"))))
    sizes = sizes.select("cell", "dim", F.ceil(F.col("n") / wanted).cast("int").alias("pieces"))
    # One row per cell on the right: broadcast while small, else an adaptive join splits a hot cell.
    dealt = celled.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, values = usable_rows(table["embedding"].combine_chunks(), table["dim"][0].as_py(), on_unusable)
        ids = table["vec_id"].to_numpy()[rows]
        order = np.argsort(ids, kind="stable")
        values = values[order]
        edges, entries = neighbour_graph(values, metric, degree, candidates) if len(values) else (np.empty(0), np.empty(0))
        columns = [ids[order], values.ravel(), edges.ravel(), entries]
        kinds = [pa.int64(), table["embedding"].type.value_type, pa.int32(), pa.int32()]
        lists = [pa.array([pa.array(c, k)], pa.list_(k)) for c, k in zip(columns, kinds)]
        one = [pa.array([k.as_py()], pa.int32()) for k in key]
        return pa.table([*one, *lists], names=[field.split()[0] for field in schema.split(", ")])

    shards = dealt.select("cell", "piece", "vec_id", "embedding", "dim").groupBy("cell", "piece").applyInArrow(build, schema)
    shards.where(F.size("ids") > 0).write.partitionBy("cell").option("compression", "zstd").parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path)


# -- searching -----------------------------------------------------------------------------


def _keys(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """What a walk goes by, smaller is nearer; pairs in single precision."""
    out = np.empty(len(q), np.float32)
    step = max(1, _WORK_BYTES // (8 * queries.shape[1]))
    for at in range(0, len(q), step):
        a, b = queries[q[at : at + step]], vectors[v[at : at + step]]
        out[at : at + step] = -np.einsum("ij,ij->i", a, b) if metric == "ip" else ((a - b) ** 2).sum(axis=1)
    return out


def _padded(row: np.ndarray, values: np.ndarray, rows: int, fill) -> np.ndarray:
    """Values of ascending rows as a rectangle."""
    counts = np.bincount(row, minlength=rows)
    out = np.full((rows, int(counts.max(initial=0))), fill, values.dtype)
    out[row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]] = values
    return out


def walk(queries: np.ndarray, vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, ef: int, metric: str):
    """``(best, visited)``: the ``ef`` nearest vectors that each query met (-1: none), and how many it met."""
    count, n = len(queries), len(vectors)
    ef = min(ef, n)
    seen = np.zeros((count, n), bool)
    best, key, opened = np.full((count, ef), -1), np.full((count, ef), np.inf, np.float32), np.ones((count, ef), bool)
    visited = np.zeros(count, np.int64)
    q, v = np.repeat(np.arange(count), len(entries)), np.tile(entries.astype(np.int64), count)
    while True:
        if len(q):
            seen[q, v] = True
            visited += np.bincount(q, minlength=count)
            met, far = _padded(q, v, count, -1), _padded(q, _keys(queries, vectors, q, v, metric), count, np.inf)
            closed = np.hstack([opened, met < 0])
            met, far = np.hstack([best, met]), np.hstack([key, far])
            order = np.argsort(far, axis=1, kind="stable")[:, :ef]
            best, key, opened = (np.take_along_axis(a, order, axis=1) for a in (met, far, closed))
        # Lists are in order of nearness: the first ones not yet opened are the next.
        turn = ~opened & (np.cumsum(~opened, axis=1) <= _OPENED)
        if not turn.any():
            return best, visited
        opened |= turn
        q, column = np.nonzero(turn)
        ends = edges[best[q, column]]
        pairs = np.unique((q[:, None] * n + ends)[ends >= 0])
        q, v = pairs // n, pairs % n
        fresh = ~seen[q, v]
        q, v = q[fresh], v[fresh]


def graph_walk(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    ef: int = EF,
    metric: str = "ip",
    centroids: DataFrame | None = None,
    nprobe: int = 1,
    block_bytes: int = BLOCK_BYTES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """What the tasks found: ``(query_id, vec_id, score, visited)``, at most ``k`` rows per query and task, and one row without
    a ``vec_id`` that says how many vectors the task compared. ``graph_search`` and ``visits`` read it.

    ``ef`` is raised to ``k``. With ``centroids``, those of the build, a query walks the graphs of its ``nprobe`` best cells.
    """
    ef = max(ef, k)
    probes = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "qv")
    if centroids is not None:
        cells = centroids.select(F.col("cell").alias("vec_id"), F.col("c").alias("embedding"))
        parts = knn(probes, cells, nprobe, "ip").groupBy("query_id").agg(F.collect_list("vec_id").alias("parts"))
        probes = probes.join(parts, "query_id")
    blocks, dim = fetch_probes(probes, block_bytes)
    per_pass = max(1, pass_bytes // block_bytes)
    passes = []
    for at in range(0, len(blocks), per_pass):
        some, held = blocks[at : at + per_pass], index
        if some[0].parts is not None:
            held = index.where(F.col("cell").isin(sorted({p for b in some for p in b.parts})))
        shared = index.sparkSession.sparkContext.broadcast([(b.query_ids, b.queries, b.parts) for b in some])
        passes.append(held.mapInArrow(_walker(shared, k, ef, metric, dim), WALK))
    return stack(passes) if passes else index.sparkSession.createDataFrame([], WALK)


def _walker(shared, k: int, ef: int, metric: str, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(BlockTopK(ids, queries, k, metric), visits, np.zeros(len(ids), np.int64)) for ids, queries, visits in shared.value]
        for batch in batches:
            for at in range(batch.num_rows):
                ids, flat, edges, entries = (batch[name].slice(at, 1).flatten().to_numpy() for name in ("ids", "vectors", "edges", "entries"))
                vectors, edges = flat.reshape(len(ids), -1), edges.reshape(len(ids), -1)
                single = vectors.astype(np.float32, copy=False)
                if vectors.shape[1] != dim:
                    raise ValueError(f"queries of {dim} and vectors of {vectors.shape[1]} components")
                cell = batch["cell"][at].as_py()
                for best, visits, visited in sets:
                    mine = np.arange(len(best.ids)) if visits is None else visits.get(cell, np.empty(0, np.int64))
                    for start in range(0, len(mine), _TILE):
                        some = mine[start : start + _TILE]
                        found, met = walk(best.single[some], single, edges, entries, ef, metric)
                        visited[some] += met
                        row, column = np.nonzero(found >= 0)
                        q, v = some[row], found[row, column]
                        best.merge(q, exact_keys(best.queries, q, vectors, v, metric), ids[v])
        for best, _, visited in sets:
            hits, some = best.result(), np.flatnonzero(visited)
            yield pa.RecordBatch.from_arrays([*hits.columns, pa.nulls(hits.num_rows, pa.int64())], names=[*hits.schema.names, "visited"])
            none = [pa.nulls(len(some), kind) for kind in (pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[some]), *none, pa.array(visited[some])], names=[*hits.schema.names, "visited"])

    return run


def graph_search(walked: DataFrame, k: int = 10, metric: str = "ip") -> DataFrame:
    """The answers of a ``graph_walk``: ``(query_id, rank, vec_id, score)``."""
    return rank_hits(walked.where(F.col("vec_id").isNotNull()).drop("visited"), k, metric)


def visits(walked: DataFrame) -> DataFrame:
    """``(query_id, visited)``: the vectors that each query was compared with."""
    return walked.where(F.col("visited").isNotNull()).groupBy("query_id").agg(F.sum("visited").alias("visited"))
