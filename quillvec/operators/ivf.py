"""Inverted-file search: train cells, assign vectors, probe the best cells exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.functions.vector import as_double, inner_product
from quillvec.operators.blockscan import block_topk, check_policy, exact_keys, full_matrix, usable_rows
from quillvec.operators.search import knn
from quillvec.sources.vectors import write_vectors

#: Centroids are broadcast in blocks of this size.
CENTROID_BYTES = 64 << 20
#: A block of scores in a task.
SCORE_BYTES = 32 << 20
INDEX_ROWS_PER_FILE = 1_000_000


def cell_count(n: int) -> int:
    """Cells for ``n`` vectors: one per 30, at most 100, at least 1.

    Fixed values: the benchmark's 30 and 100. For large tables pass ``nlist``, as 100 cells of a
    billion vectors are no index.
    """
    return max(1, min(100, n // 30))


def ivf_train(vectors: DataFrame, nlist: int | None = None, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """Centroids ``(cell, c)`` by spherical k-means over all vectors (but zero ones, which have no direction).

    k-means holds the projected features in executor storage for its iterations.
    """
    nlist = nlist or cell_count(vectors.count())
    points = vectors.filter(inner_product(F.col("embedding"), F.col("embedding")) > 0)
    features = points.select(array_to_vector(as_double(F.col("embedding"))).alias("features"))
    means = KMeans(k=nlist, distanceMeasure="cosine", seed=seed, maxIter=max_iter)
    centers = means.fit(features).clusterCenters()
    table = pa.table(
        {"cell": pa.array(range(len(centers)), pa.int32()), "c": pa.array(centers, pa.list_(pa.float64()))}
    )
    return vectors.sparkSession.createDataFrame(table)


def _centroid_blocks(centroids: DataFrame, block_bytes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(cells, matrix)`` in ascending order of the cells; measured before they are fetched."""
    low, high, widest = centroids.agg(F.min("cell"), F.max("cell"), F.max(F.size("c"))).first()
    if low is None:
        raise ValueError("an inverted file needs centroids")
    step = max(1, block_bytes // (8 * widest))
    blocks = []
    for start in range(low, high + 1, step):
        mine = centroids.select("cell", "c").filter(F.col("cell").between(start, start + step - 1))
        table = mine.toArrow().sort_by("cell")
        if table.num_rows:
            blocks.append((table["cell"].to_numpy(), full_matrix(table["c"])))
    return blocks


def best_rows(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the largest inner product per vector, ties to the first; decided on exact sums."""
    step = max(1, SCORE_BYTES // (8 * len(centroids)))
    parts = [_best_rows(vectors[at : at + step], centroids) for at in range(0, len(vectors), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _best_rows(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    exact = vectors.astype(np.float64)
    scores = exact @ centroids.T
    sizes = np.sqrt((exact * exact).sum(axis=1))
    width = np.sqrt((centroids * centroids).sum(axis=1)).max()
    margin = 8.0 * (exact.shape[1] + 4) * np.finfo(np.float64).eps * sizes * width
    near = scores >= (scores.max(axis=1) - margin)[:, None]
    best = near.argmax(axis=1)
    tied = np.flatnonzero(near.sum(axis=1) > 1)
    for row in tied:
        options = np.flatnonzero(near[row])
        keys = exact_keys(exact, np.full(len(options), row), centroids, options, "ip")
        best[row] = options[keys.argmax()]
    return best


def ivf_assign(
    vectors: DataFrame, centroids: DataFrame, on_unusable: str = "error", block_bytes: int = CENTROID_BYTES
) -> DataFrame:
    """Adds ``cell``, the centroid with the largest inner product (ties to the lowest cell).

    Row-local: the centroids travel to the vectors in blocks, and each row keeps the best so far. A
    vector that cannot be compared (another dimension, null, non-finite) is an error; with ``"skip"`` its cell is null.
    """
    check_policy(on_unusable)
    blocks = _centroid_blocks(centroids, block_bytes)
    fields = [*vectors.schema.fields, T.StructField("cell", T.IntegerType())]
    score = [T.StructField("__score", T.DoubleType())]
    assigned = vectors
    for number, block in enumerate(blocks):
        last = number + 1 == len(blocks)
        schema = T.StructType(fields + ([] if last else score))
        assigned = assigned.mapInArrow(_assign(vectors.sparkSession.sparkContext.broadcast(block), number, last, on_unusable), schema)
    return assigned


def _assign(shared, number: int, last: bool, on_unusable: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centers = shared.value
        for batch in batches:
            rows, values = usable_rows(batch["embedding"], centers.shape[1], on_unusable)
            columns, names = list(batch.columns), list(batch.schema.names)
            cell, score = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, -np.inf)
            if number:
                cell = columns[-2].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                score = columns[-1].to_numpy(zero_copy_only=False).copy()
                columns, names = columns[:-2], names[:-2]
            if len(rows):
                best = best_rows(values, centers)
                keys = exact_keys(values.astype(np.float64), np.arange(len(rows)), centers, best, "ip")
                better = keys > score[rows]
                cell[rows[better]], score[rows[better]] = ids[best[better]], keys[better]
            found = np.zeros(batch.num_rows, dtype=bool)
            found[rows] = True
            columns.append(pa.array(cell, type=pa.int32(), mask=~found))
            yield pa.RecordBatch.from_arrays(
                columns + ([] if last else [pa.array(score)]), names=[*names, "cell"] + ([] if last else ["__score"])
            )

    return assign


def ivf_build(vectors: DataFrame, centroids: DataFrame, path: str, max_rows: int = INDEX_ROWS_PER_FILE) -> DataFrame:
    """Assigns the vectors and stores them by cell, so that a search reads only probed cells.

    This is the one step that moves the vectors: they are rebalanced by cell into few, large
    files, and a cell that holds most vectors is split over several writers.
    """
    write_vectors(ivf_assign(vectors, centroids), path, "cell", max_rows, rebalance=True)
    return vectors.sparkSession.read.parquet(path)


def ivf_search(
    queries: DataFrame,
    index: DataFrame,
    centroids: DataFrame,
    k: int,
    nprobe: int,
    metric: str = "ip",
    **limits,
) -> DataFrame:
    """Exact top-k inside the ``nprobe`` best cells of each query.

    ``index`` is an assigned vector table; stored by cell, only probed cells are read. Cells
    with few vectors may leave a query with fewer than ``k`` answers.
    """
    cells = centroids.select(F.col("cell").alias("vec_id"), F.col("c").alias("embedding"))
    visits = knn(queries, cells, nprobe, "ip").groupBy("query_id").agg(F.collect_list("vec_id").alias("parts"))
    probes = queries.select("query_id", "qv").join(visits, "query_id")
    return block_topk(probes, index, k, metric, part="cell", **limits)
