"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to ``HASHES`` cells floor((a . x + b) / w) with Gaussian ``a``; together they
name a bucket. A query visits its own bucket and the buckets next to it in the order of their estimated success:
the perturbations -1, 0, +1 of all cells, sorted by the sum of the squared distances from the query to the
borders they cross, the first ``PROBES`` of them. Every row is hashed; the rows in visited buckets of any table are merged
and ranked by their exact distance.

The queries' probes are broadcast in blocks of at most ``BLOCK_BYTES`` (a query has a known size), the vectors stay where
they lie: each task hashes the rows it reads, looks their buckets up among the probes, and keeps the best ``k`` of each query. So only
k rows per query and task are shuffled, no pair of a query and a candidate ever becomes a row, and a bucket or a group of copies that holds a third of all
vectors is spread over the tasks that read it. The width ``w`` is fitted on at most ``SAMPLE`` vectors.

A query for which the probes found fewer than ``k`` rows visits all buckets in a second pass.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and rows
without id, take no part; vectors meet only vectors of their own length; a query id on several rows stands for its smallest vector;
rows that share the query's id are not its candidates; ties go to the smaller id; equal rows are all found; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.textops import mix, shared
from quillvec.session import durable

TABLES, HASHES, PROBES = 12, 6, 150
WIDTH = 0.85  # of the median distance between sampled vectors
SAMPLE = 1000
BLOCK_BYTES = 32 << 20
ROWS = 2048
PAIRS = 1 << 15
SALTS = 32
SEED = 11


@dataclass
class Tables:
    """The hash functions for vectors of one length."""

    a: np.ndarray  # [dim, TABLES * HASHES]
    b: np.ndarray
    width: float
    hashes: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.a + self.b) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Bucket numbers [rows, tables] of integer cells [rows, tables, hashes]."""
        odd = mix(np.arange(1, self.hashes + 1, dtype=np.uint64)) | np.uint64(1)
        key = (cells.astype(np.int64).view(np.uint64) * odd).sum(axis=-1)
        key ^= key >> np.uint64(29)
        return key * np.uint64(0xBF58476D1CE4E5B9)


def fit(sample: np.ndarray, dim: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> Tables:
    rng = np.random.default_rng(SEED)
    apart = 0.0
    if len(sample) > 1:
        other = np.roll(sample, 1 + len(sample) // 2, axis=0)
        apart = float(np.median(np.sqrt(((sample - other) ** 2).sum(axis=1))))
    w = width * (apart if apart > 0 and np.isfinite(apart) else 1.0)
    return Tables(rng.normal(size=(dim, tables * hashes)), rng.uniform(0, w, tables * hashes), w, hashes)


def probe_keys(q: np.ndarray, tables: Tables, probes: int) -> np.ndarray:
    """Buckets [queries, tables, probes] in the order of their estimated success."""
    spread = tables.cells(q).reshape(len(q), -1, tables.hashes)
    cell = np.floor(spread)
    x = (spread - cell)[:, :, None, :]
    moves = np.array(list(itertools.product((0, -1, 1), repeat=tables.hashes)))
    out = np.empty((len(q), spread.shape[1], min(probes, len(moves))), np.uint64)
    for i in range(len(q)):
        cost = np.where(moves == -1, x[i] ** 2, np.where(moves == 1, (1 - x[i]) ** 2, 0.0)).sum(axis=-1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[i] = tables.keys(cell[i][:, None, :] + moves[order])
    return out


class Block:
    """Queries of one length with their probes, grouped by table and sorted by bucket."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, tables: Tables, probes: int | None) -> None:
        self.ids, self.q, self.tables = ids, q, tables
        self.sorted: list[tuple[np.ndarray, np.ndarray]] | None = None
        if probes is not None:
            keys = probe_keys(q, tables, probes)
            self.sorted = []
            for t in range(keys.shape[1]):
                flat, owner = keys[:, t].ravel(), np.repeat(np.arange(len(q), dtype=np.int32), keys.shape[2])
                order = np.argsort(flat, kind="stable")
                self.sorted.append((flat[order], owner[order]))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Which rows of ``x`` lie in a bucket that a query visits: [rows, queries]."""
        if self.sorted is None:
            return np.ones((len(x), len(self.q)), bool)
        keys = self.tables.keys(np.floor(self.tables.cells(x)).reshape(len(x), -1, self.tables.hashes))
        found = np.zeros((len(x), len(self.q)), bool)
        for t, (known, owner) in enumerate(self.sorted):
            first = np.searchsorted(known, keys[:, t], side="left")
            count = np.searchsorted(known, keys[:, t], side="right") - first
            total = int(count.sum())
            if total:
                at = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
                found[np.repeat(np.arange(len(x)), count), owner[at]] = True
        return found


class Best:
    """The best ``k`` rows of every query so far."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.query = np.zeros(0, np.int64)
        self.distance = np.zeros(0)
        self.ids = np.zeros(0, np.int64)
        self.limit = np.full(len(block.ids), np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows, queries = np.nonzero(self.block.candidates(x))
        kept = []
        for at in range(0, len(rows), PAIRS):
            r, q = rows[at : at + PAIRS], queries[at : at + PAIRS]
            distance = np.sqrt(((x[r] - self.block.q[q]) ** 2).sum(axis=1))
            good = (distance <= self.limit[q]) & (ids[r] != self.block.ids[q])
            kept.append((q[good], distance[good], ids[r[good]]))
        if not kept:
            return
        query = np.concatenate([self.query, *(a for a, _, _ in kept)])
        distance = np.concatenate([self.distance, *(b for _, b, _ in kept)])
        names = np.concatenate([self.ids, *(c for _, _, c in kept)])
        order = np.lexsort((names, distance, query))
        query, distance, names = query[order], distance[order], names[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        use = rank < self.k
        last = rank == self.k - 1
        self.limit[query[last]] = distance[last]
        self.query, self.distance, self.ids = query[use], distance[use], names[use]


def usable(v: Column) -> Column:
    """Not null, empty or zero, without null or non-finite components."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scan(vectors: DataFrame, blocks, k: int) -> DataFrame:
    """The best ``k`` rows of every query in each task; ``blocks`` gives the broadcast list of blocks of one length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(block, k) for block in blocks()]
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                mine = [b for b in best if b.block.q.shape[1] == dim]
                part = batch.filter(pa.array(sizes == dim)) if mine else batch.slice(0, 0)
                for row in range(0, part.num_rows, ROWS):
                    some = part.slice(row, ROWS)
                    ids, x = some.column("vec_id").to_numpy(), _matrix(some.column("v"))
                    for b in mine:
                        b.add(ids, x)
        for b in best:
            yield pa.RecordBatch.from_pydict(
                {"query_id": pa.array(b.block.ids[b.query]), "vec_id": pa.array(b.ids), "score": pa.array(b.distance)}
            )

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query: first in salted groups, then of all."""
    order = [F.col("score"), F.col("vec_id")]
    salted = hits.withColumn("__s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "__s").orderBy(*order)))
    some = some.where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    width: float = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``queries (query_id, embedding)`` among ``vectors (vec_id, embedding)``."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(v)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"), v.alias("v")
    )
    asked = queries.where(F.col("query_id").isNotNull() & usable(v))
    asked = asked.groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(F.min(v).alias("v"))
    asked = asked.withColumn("dim", F.size("v"))

    sizes = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted: dict[int, Tables] = {}
    for dim in sizes:
        few = rows.where(F.col("dim") == dim).select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE)
        sample = np.array([r["v"] for r in few.select("v").collect()], float).reshape(-1, dim)
        fitted[dim] = fit(sample, dim, tables, hashes, width)

    def scans(wanted: DataFrame, counts: dict[int, int], probes: int | None) -> DataFrame:
        out = None
        for dim, n in sorted(counts.items()):
            each = 8 * dim + 12 * tables * (probes or 0) + 8
            parts = -(-n * each // block_bytes)
            for part in range(parts):
                # about n / parts queries: a block is bounded before it is fetched
                some = wanted.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))
                got = some.select("query_id", "v").orderBy("query_id").collect()
                if not got:
                    continue
                ids, q = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)
                held = shared(spark, [Block(ids, q, fitted[dim], probes)])
                hits = _scan(rows, held, k)
                out = hits if out is None else out.unionByName(hits)
        return _ranked(out, k)

    found = durable(scans(asked, sizes, probes))
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = durable(asked.join(full, "query_id", "left_anti"))
    counts = {r["dim"]: r["n"] for r in short.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return found
    return found.join(full, "query_id", "left_semi").unionByName(scans(short, counts, None))


def query(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return search(queries, vectors)
