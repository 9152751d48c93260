"""The scan that every search shares: score blocks of vectors against blocks of queries, keep
the best k per query in each task, then rank the survivors with a window.

The queries travel, the vectors stay where they lie: nothing but k rows per query and task is
shuffled. A query set is broadcast in blocks of at most ``BLOCK_BYTES``; its size is summed before
anything is fetched. One pass over the vectors serves as many blocks as ``PASS_BYTES`` holds, a larger
query set takes several passes.

Within a block a single-precision matrix product selects candidates with a proven error margin;
only those are scored exactly, as a left-to-right DOUBLE sum. Scores are therefore the same bits
as the native expressions in ``functions.vector``, whatever the batching.

Where the margin leaves too many, a task goes on with a double-precision product; what still ties is cut to the best k by
exact scores. Gathered candidates never exceed a fixed number or twice the answer.

Vectors of another dimension, and vectors with null or non-finite components, stop a search. With
``on_unusable="skip"`` they are passed over; ``unusable_vectors`` lists them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ip", "l2")
POLICIES = ("error", "skip")
BLOCK_BYTES = 32 << 20
PASS_BYTES = 256 << 20
PARTIAL = "query_id bigint, vec_id bigint, score double"

_QUERY_BLOCK = 512
_VECTOR_ROWS = 8192  # with 512 queries, a block of scores has at most 32 MB
_TERM_BYTES = 1 << 20
_PAIRS = 1 << 18  # candidates that are gathered before they are cut, or twice as many as the answer has
# Squared norms for which single precision neither overflows nor loses digits to underflow.
_SINGLE_LOW, _SINGLE_HIGH = 1e-30, 1e36


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable rows of a list column, and their values as an (n, dim) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if len(rows) == 0:
        return rows, np.empty((0, dim), dtype=np.float32)
    if len(rows) < len(column):
        column = column.filter(fits)
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if np.isfinite(values.sum()):  # a bad component would show in the sum
        return rows, values
    finite = np.isfinite(values).all(axis=1)
    return rows[finite], values[finite]


def usable_rows(column: pa.Array, dim: int, on_unusable: str) -> tuple[np.ndarray, np.ndarray]:
    """``matrix_of``, where with ``"error"`` a row that is left out is an error."""
    rows, values = matrix_of(column, dim)
    if on_unusable == "error" and len(rows) < len(column):
        raise ValueError(f"{len(column) - len(rows)} of {len(column)} vectors do not have {dim} finite components")
    return rows, values


def check_policy(on_unusable: str) -> None:
    if on_unusable not in POLICIES:
        raise ValueError(f"on_unusable must be one of {POLICIES}, not {on_unusable!r}")


def unusable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``(vec_id, reason)`` of the vectors that a search in ``dim`` dimensions cannot use."""
    v = F.col("embedding")
    reason = (
        F.when(v.isNull(), F.lit("null"))
        .when(F.size(v) != dim, F.format_string("%d components", F.size(v)))
        .when(F.exists(v, lambda x: x.isNull()), F.lit("null component"))
        .when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("component not finite"))
    )
    return vectors.select("vec_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def full_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A bounded list column as a DOUBLE matrix; every row must have the same finite components."""
    dim = pc.max(pc.list_value_length(column)).as_py() or 0
    rows, values = matrix_of(column, dim)
    if dim == 0 or len(rows) < len(column):
        raise ValueError(f"every vector must have {dim} finite components")
    return np.ascontiguousarray(values, dtype=np.float64)


def exact_keys(queries: np.ndarray, q: np.ndarray, vectors: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Ranking key (larger is better) of the pairs ``(queries[q], vectors[v])``.

    Sums run from left to right in DOUBLE; the steps keep a block of terms within the cache.
    """
    out = np.empty(len(q), dtype=np.float64)
    step = max(1, _TERM_BYTES // (8 * queries.shape[1]))
    for at in range(0, len(q), step):
        terms = queries[q[at : at + step]]
        if metric == "ip":
            terms *= vectors[v[at : at + step]]
        else:
            terms -= vectors[v[at : at + step]]
            terms *= terms
        out[at : at + step] = np.add.accumulate(terms, axis=1, out=terms)[:, -1]
    return out if metric == "ip" else -np.sqrt(out)


def _rank_in_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal keys."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


class BlockTopK:
    """Running best k per query over any number of vector blocks of one task."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.ids, self.queries, self.k, self.metric = query_ids, queries, k, metric
        self.single = queries.astype(np.float32)
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        sized = self.norms[self.norms > 0] ** 2
        self.in_range = bool(((sized > _SINGLE_LOW) & (sized < _SINGLE_HIGH)).all())
        self.wide = False  # single precision has left too many candidates
        self.floor = np.full(len(queries), -np.inf)  # exact k-th key so far
        self.best_q = np.empty(0, dtype=np.int64)
        self.best_key = np.empty(0, dtype=np.float64)
        self.best_id = np.empty(0, dtype=np.int64)

    def add(self, vec_ids: np.ndarray, vectors: np.ndarray, groups=None) -> None:
        """``groups`` pairs query positions with vector positions; None means all with all."""
        n = len(vectors)
        if n == 0 or len(self.queries) == 0:
            return
        block, queries, squares, margin = self._operands(vectors, self.wide)
        loose = margin  # holds for all scores of this block
        pairs, scores, held, room = [], [], 0, max(_PAIRS, 2 * len(self.queries) * self.k)
        for q_rows, v_rows in groups or [(np.arange(len(self.queries)), None)]:
            part, part_squares = (block, squares) if v_rows is None else (block[v_rows], squares[v_rows])
            for at in range(0, len(q_rows), _QUERY_BLOCK):
                some = q_rows[at : at + _QUERY_BLOCK]
                many = 4 * self.k * len(some)
                at_q, at_v, near = self._candidates(some, queries[some], part, part_squares, margin[some])
                if len(near) > many and block.dtype == np.float32:
                    # Vectors nearer to each other than single precision can tell: double precision from here on.
                    self.wide = True
                    block, queries, squares, margin = self._operands(vectors, True)
                    part, part_squares = (block, squares) if v_rows is None else (block[v_rows], squares[v_rows])
                    at_q, at_v, near = self._candidates(some, queries[some], part, part_squares, margin[some])
                if v_rows is not None:
                    at_v = v_rows[at_v]
                if len(near) > many:  # ties
                    stay = self._exact_best(at_q, some[at_q], at_v, vec_ids, vectors)
                    at_q, at_v, near = at_q[stay], at_v[stay], near[stay]
                pairs.append(some[at_q] * n + at_v)
                scores.append(near)
                held += len(near)
                if held > room:
                    if groups is None:  # no other part of the loop has these queries
                        self._score(np.concatenate(pairs), n, vec_ids, vectors)
                        pairs, scores, held = [], [], 0
                    else:
                        pair, near = self._narrowed(np.concatenate(pairs), np.concatenate(scores), n, loose)
                        if 2 * len(pair) > room:
                            stay = self._exact_best(pair // n, pair // n, pair % n, vec_ids, vectors)
                            pair, near = pair[stay], near[stay]
                            self.wide = True
                        pairs, scores, held = [pair], [near], len(pair)
        if pairs:
            pair = np.concatenate(pairs)
            if groups is not None:
                pair, _ = self._narrowed(pair, np.concatenate(scores), n, loose)
            self._score(pair, n, vec_ids, vectors)

    def _operands(self, vectors, wide: bool):
        """Vectors and queries in the precision of the scores, the vectors' squares and each query's margin of error."""
        block, queries = vectors.astype(np.float32, copy=False), self.single
        squares = np.einsum("ij,ij->i", block, block)
        if wide or not (self.in_range and _SINGLE_LOW < squares.max() < _SINGLE_HIGH):
            block, queries = vectors.astype(np.float64), self.queries
            squares = np.einsum("ij,ij->i", block, block)
        # Product and exact sum are both within dim * eps * |q||v| of the true value.
        reach = float(np.sqrt(squares.max()))
        slack = 4.0 * (vectors.shape[1] + 4) * np.finfo(block.dtype).eps
        return block, queries, squares, slack * (self.norms * reach if self.metric == "ip" else (self.norms + reach) ** 2)

    def _score(self, pair, n, vec_ids, vectors) -> None:
        if len(pair):
            q, v = pair // n, pair % n
            self.merge(q, exact_keys(self.queries, q, vectors, v, self.metric), vec_ids[v])

    def _exact_best(self, runs, q, v, vec_ids, vectors) -> np.ndarray:
        """Positions of the best k pairs of each run, ties to the smaller id; about ``_PAIRS`` pairs at once."""
        kept, at = [], 0
        while at < len(runs):
            end = int(np.searchsorted(runs, runs[min(at + _PAIRS, len(runs)) - 1], side="right"))
            keys = exact_keys(self.queries, q[at:end], vectors, v[at:end], self.metric)
            order = np.lexsort((vec_ids[v[at:end]], -keys, runs[at:end]))
            kept.append(at + order[_rank_in_runs(runs[at:end][order]) < self.k])
            at = end
        return np.sort(np.concatenate(kept))

    def _candidates(self, rows, queries, block, squares, margin):
        """Pairs that may be among the best k, with their approximate scores."""
        scores = queries @ block.T
        floor = self.floor[rows]
        if self.metric == "l2":
            scores *= 2.0
            scores -= squares
            scores -= (self.norms[rows] ** 2).astype(scores.dtype)[:, None]
            floor = -(floor**2)
        floor = floor - margin
        width, k = len(block), self.k
        hits = None
        if np.isfinite(floor).all():
            hits = np.flatnonzero(scores >= self._below(floor, scores.dtype))
        if (hits is None or len(hits) > 4 * k * len(rows)) and width > k:
            kth = np.partition(scores, width - k, axis=1)[:, width - k]
            floor = np.maximum(floor, kth - 2.0 * margin)
            hits = None
        if hits is None:
            hits = np.flatnonzero(scores >= self._below(floor, scores.dtype))
        return hits // width, hits % width, scores.ravel()[hits]

    @staticmethod
    def _below(floor: np.ndarray, kind) -> np.ndarray:
        return np.nextafter(floor.astype(kind), kind.type(-np.inf))[:, None]

    def _narrowed(self, pairs, scores, n, margin) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of several groups: each pair once, and against each query's k-th over all."""
        pairs, first = np.unique(pairs, return_index=True)
        scores = scores[first].astype(np.float64)
        q = pairs // n
        order = np.lexsort((-scores, q))
        full = order[_rank_in_runs(q[order]) == self.k - 1]
        floor = np.full(len(self.queries), -np.inf)
        floor[q[full]] = scores[full] - 2.0 * margin[q[full]]
        stay = scores >= floor[q]
        return pairs[stay], scores[stay]

    def merge(self, q, keys, ids) -> None:
        q = np.concatenate([self.best_q, q])
        keys = np.concatenate([self.best_key, keys])
        ids = np.concatenate([self.best_id, ids])
        order = np.lexsort((ids, -keys, q))
        q, keys, ids = q[order], keys[order], ids[order]
        rank = _rank_in_runs(q)
        keep = rank < self.k
        self.best_q, self.best_key, self.best_id = q[keep], keys[keep], ids[keep]
        full = rank == self.k - 1
        self.floor[q[full]] = keys[full]

    def result(self) -> pa.RecordBatch:
        score = self.best_key if self.metric == "ip" else np.negative(self.best_key)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.best_q]), pa.array(self.best_id), pa.array(score)],
            names=["query_id", "vec_id", "score"],
        )


class Probes:
    """A bounded query set: one matrix, and per part the positions of the queries that visit it."""

    def __init__(self, table: pa.Table):
        self.query_ids = table["query_id"].to_numpy()
        self.queries = full_matrix(table["qv"])
        self.parts: dict[int, np.ndarray] | None = None
        if "parts" in table.column_names:
            # Every task holds the positions of a pass: of half the width, and apart from the array they were cut from.
            self.parts = {p: at.astype(np.int32) for p, at in _by_part(table["parts"].combine_chunks(), np.arange(table.num_rows))}


def _by_part(parts: pa.Array, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each part, the positions (within ``rows``) of the members that lie in it."""
    taken = parts.take(pa.array(rows))
    if pa.types.is_list(taken.type):
        at = pc.list_parent_indices(taken).to_numpy()
        part = taken.flatten().to_numpy(zero_copy_only=False)
    else:
        valid = taken.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(valid)
        part = taken.drop_null().to_numpy(zero_copy_only=False)
    order = np.argsort(part, kind="stable")
    keys, starts = np.unique(part[order], return_index=True)
    return [(int(key), piece) for key, piece in zip(keys, np.split(at[order], starts[1:]))]


def _is_array(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith("array")


def fetch_probes(probes: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[list[Probes], int]:
    """The query set in blocks of about ``block_bytes`` and its dimension.

    The set is measured first; a block is a hash range of the query ids, so each is fetched by itself.
    """
    parted = "parts" in probes.columns
    held = probes.persist()
    try:
        size = 8 * F.size("qv") + (8 * F.size("parts") if parted else 0)
        total, low, high = held.agg(F.sum(size), F.min(F.size("qv")), F.max(F.size("qv"))).first()
        if total is None:
            return [], 0
        if low != high:
            raise ValueError(f"queries of {low} and of {high} components")
        blocks = -(-total // block_bytes)
        out = []
        for block in range(blocks):
            mine = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            table = mine.toArrow()
            if table.num_rows:
                out.append(Probes(table))
        return out, high
    finally:
        held.unpersist()


def block_topk(
    probes: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "ip",
    part: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    pass_bytes: int = PASS_BYTES,
    on_unusable: str = "error",
) -> DataFrame:
    """Best ``k`` vectors per query: ``(query_id, rank, vec_id, score)``.

    Without ``part`` every query meets every vector. With it, a query meets the vectors whose
    ``part`` column (one part, or an array of them) holds one of the query's ``parts`` (an
    array); a pair that meets in several parts counts once, as one task sees all parts of a vector.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    check_policy(on_unusable)
    probes = probes.select(F.col("query_id").cast("bigint").alias("query_id"), "qv", *(["parts"] if part else []))
    fields = [F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"]
    vectors = vectors.select(*fields, *([F.col(part).alias("part")] if part else []))
    blocks, dim = fetch_probes(probes, block_bytes)
    if not blocks:
        return rank_hits(probes.sparkSession.createDataFrame([], PARTIAL), k, metric)
    per_pass = max(1, pass_bytes // block_bytes)
    passes = [
        _scan(blocks[at : at + per_pass], vectors, k, metric, dim, on_unusable) for at in range(0, len(blocks), per_pass)
    ]
    return rank_hits(reduce(DataFrame.unionByName, passes), k, metric)


def _scan(blocks: list[Probes], vectors: DataFrame, k: int, metric: str, dim: int, on_unusable: str) -> DataFrame:
    if blocks[0].parts is not None and not _is_array(vectors, "part"):
        probed = sorted({p for block in blocks for p in block.parts})
        vectors = vectors.filter(F.col("part").isin(probed))  # prunes a table stored by part
    # Plain arrays: broadcast values are pickled by reference to their class.
    shared = vectors.sparkSession.sparkContext.broadcast([(b.query_ids, b.queries, b.parts) for b in blocks])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(BlockTopK(ids, queries, k, metric), visits) for ids, queries, visits in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, _VECTOR_ROWS):
                some = batch.slice(at, _VECTOR_ROWS)
                rows, values = usable_rows(some["embedding"], dim, on_unusable)
                if len(rows) == 0:
                    continue
                ids = some["vec_id"].to_numpy()[rows]
                members = _by_part(some["part"], rows) if sets[0][1] is not None else None
                for best, visits in sets:
                    if members is None:
                        best.add(ids, values)
                        continue
                    groups = [(visits[part].astype(np.int64), where) for part, where in members if part in visits]
                    if groups:
                        best.add(ids, values, groups)
        for best, _ in sets:
            yield best.result()

    return vectors.mapInArrow(scan, PARTIAL)


def rank_hits(partial: DataFrame, k: int, metric: str, fan: int | None = None) -> DataFrame:
    """The best ``k`` of the per-task survivors, ties to the smaller ``vec_id``.

    On a wide cluster a query's survivors are first cut down in ``fan`` salted groups, so no
    task sorts what all the others sent.
    """
    order = [F.col("score").desc() if metric == "ip" else F.col("score").asc(), F.col("vec_id").asc()]
    if fan is None:
        fan = partial.sparkSession.sparkContext.defaultParallelism // 64
    if fan > 1:
        window = Window.partitionBy("query_id", "salt").orderBy(*order)
        partial = (
            partial.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(fan)))
            .withColumn("rank", F.row_number().over(window))
            .filter(F.col("rank") <= k)
            .drop("salt", "rank")
        )
    window = Window.partitionBy("query_id").orderBy(*order)
    return (
        partial.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
