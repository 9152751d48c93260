"""Approximate inner-product search with tunable recall: random hyperplanes, several tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.operators.blockscan import block_topk, check_policy, full_matrix, rank_hits, usable_rows
from quillvec.sources.randoms import PLANE_STREAM, normal_rows

#: Buckets over all tables; keeps the planes' matrix and the per-bucket counts small.
MAX_BUCKETS = 1 << 20
MAX_PLANE_BYTES = 256 << 20
#: Folders of a posting table, each a range of buckets.
FOLDERS = 1024


def hyperplanes(spark: SparkSession, dim: int, tables: int = 16, bits: int = 8, seed: int = 0) -> DataFrame:
    """``(plane, h)``: ``tables * bits`` random normals; plane ``t * bits + b`` is bit b of table t."""
    if tables << bits > MAX_BUCKETS:
        raise ValueError(f"tables * 2^bits must not exceed {MAX_BUCKETS}")
    ids = spark.range(tables * bits).withColumnRenamed("id", "plane")
    return normal_rows(ids, "plane", "h", dim, seed, PLANE_STREAM).drop("dim")


def _plane_matrix(planes: DataFrame, bits: int) -> np.ndarray:
    count, widest = planes.agg(F.count("*"), F.max(F.size("h"))).first()
    if count > MAX_BUCKETS or 8 * count * (widest or 0) > MAX_PLANE_BYTES:
        raise ValueError(f"hyperplanes must fit into {MAX_PLANE_BYTES} bytes")
    table = planes.select("plane", "h").toArrow().sort_by("plane")
    if table.num_rows == 0 or table.num_rows % bits or (table.num_rows // bits) << bits > MAX_BUCKETS:
        raise ValueError("hyperplanes must form whole tables within the bucket limit")
    return full_matrix(table["h"])


def bucket_codes(values: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """(n, tables) codes; table t owns the codes from t * 2^bits on. A zero product counts as positive."""
    signs = values.astype(np.float64) @ planes.T >= 0.0
    weights = (1 << np.arange(bits)).astype(np.int64)
    codes = signs.reshape(len(values), -1, bits) @ weights
    return codes + (np.arange(codes.shape[1], dtype=np.int64) << bits)


def lsh_assign(
    vectors: DataFrame, planes: DataFrame, bits: int, column: str = "embedding", on_unusable: str = "error"
) -> DataFrame:
    """Adds ``buckets``, one code per table. Row-local.

    A vector that cannot be hashed is an error; with ``"skip"`` it has no bucket.
    """
    check_policy(on_unusable)
    matrix = _plane_matrix(planes, bits)
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    schema = T.StructType(vectors.schema.fields + [T.StructField("buckets", T.ArrayType(T.LongType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tables = len(known) // bits
        for batch in batches:
            rows, values = usable_rows(batch[column], known.shape[1], on_unusable)
            lengths = np.zeros(batch.num_rows, dtype=np.int32)
            lengths[rows] = tables
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            codes = bucket_codes(values, known, bits).ravel() if len(rows) else np.empty(0, dtype=np.int64)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes))
            yield pa.RecordBatch.from_arrays(batch.columns + [buckets], names=batch.schema.names + ["buckets"])

    return vectors.mapInArrow(assign, schema)


def lsh_search(
    queries: DataFrame, index: DataFrame, planes: DataFrame, bits: int, k: int = 10, metric: str = "ip", **limits
) -> DataFrame:
    """Top-k among the vectors that share a bucket with the query in any table.

    ``index`` is a vector table with ``buckets`` from ``lsh_assign``. More tables raise recall,
    more bits cut the work.
    """
    probes = lsh_assign(queries.select("query_id", "qv"), planes, bits, "qv").withColumnRenamed("buckets", "parts")
    return block_topk(probes, index, k, metric, part="buckets", **limits)


@dataclass(frozen=True)
class Postings:
    """A stored posting table ``(bucket, vec_id, embedding, folder)``: a vector once per table of the hash."""

    rows: DataFrame
    tables: int
    bits: int
    folders: int

    def folder(self, bucket):
        return F.floor(bucket * self.folders / max(1, self.tables << self.bits)).cast("int")

    def probed(self, probes: DataFrame) -> DataFrame:
        """The rows in the folders of the probes' ``parts``. The folders are collected: at most ``folders`` numbers."""
        buckets = probes.select(F.explode("parts").alias("bucket"))
        wanted = buckets.select(self.folder(F.col("bucket")).alias("folder")).distinct().collect()
        return self.rows.where(F.col("folder").isin(sorted(r.folder for r in wanted)))


def lsh_postings(
    vectors: DataFrame, planes: DataFrame, bits: int, path: str, folders: int = FOLDERS, on_unusable: str = "error"
) -> Postings:
    """Stores every vector under each of its buckets, so that a search reads only probed buckets.

    That is ``tables`` copies of the vectors: space for reading. A rebalancing shuffle splits a bucket that holds
    most vectors over several writers; within a file the rows are sorted by bucket, so a folder of many buckets is read in part.
    """
    tables = planes.count() // bits
    assigned = lsh_assign(vectors.select("vec_id", "embedding"), planes, bits, on_unusable=on_unusable)
    rows = assigned.select(F.explode("buckets").alias("bucket"), "vec_id", "embedding")
    kept = Postings(rows, tables, bits, min(folders, tables << bits))
    dealt = rows.withColumn("folder", kept.folder(F.col("bucket"))).hint("rebalance", F.col("folder"))
    dealt.sortWithinPartitions("folder", "bucket").write.partitionBy("folder").option("compression", "zstd").parquet(path)
    schema = f"bucket bigint, vec_id bigint, embedding {dict(vectors.dtypes)['embedding']}, folder int"
    return Postings(vectors.sparkSession.read.schema(schema).parquet(path), tables, bits, kept.folders)


def posting_probes(queries: DataFrame, postings: Postings, planes: DataFrame, tables: int | None = None) -> DataFrame:
    """``(query_id, qv, parts)``: the buckets of each query in the first ``tables`` tables, or in all."""
    probes = lsh_assign(queries.select("query_id", "qv"), planes, postings.bits, "qv")
    return probes.select("query_id", "qv", F.slice("buckets", 1, tables or postings.tables).alias("parts"))


def posting_search(
    queries: DataFrame,
    postings: Postings,
    planes: DataFrame,
    k: int = 10,
    metric: str = "ip",
    tables: int | None = None,
    **limits,
) -> DataFrame:
    """The answers of ``lsh_search`` from the probed buckets' postings alone. Fewer ``tables`` read fewer files and find less."""
    probes = posting_probes(queries, postings, planes, tables)
    # A vector may meet a query in every table; the best k * tables rows hold the best k vectors.
    rows = block_topk(probes, postings.probed(probes), k * (tables or postings.tables), metric, part="bucket", **limits)
    return rank_hits(rows.drop("rank").dropDuplicates(["query_id", "vec_id"]), k, metric)
