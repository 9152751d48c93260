"""Vector tables: Parquet by dimension or by worker, and seeded random vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.schemas import VECTOR
from quillvec.sources.randoms import QUERY_STREAM, VECTOR_STREAM, normal_rows

# The benchmark's dimensions, vectors per dimension, rows per shard and queries.
DIMENSIONS = (128, 256, 512, 1024, 2048)
NUM_VECTORS = 1_000_000
SHARD_ROWS = 10_000
NUM_QUERIES = 1000


def write_vectors(
    vectors: DataFrame,
    path: str,
    by: str = "dim",
    max_rows: int = SHARD_ROWS,
    mode: str = "error",
    rebalance: bool = False,
) -> None:
    """Parquet shards below ``by=<value>`` folders, at most ``max_rows`` rows per file.

    ``rebalance`` shuffles first, so that many small tasks do not each leave a short file in
    every folder; a folder that holds most rows is split over several writers. For large
    tables also raise ``max_rows`` until files reach a few hundred MB.
    """
    if rebalance:
        vectors = vectors.hint("rebalance", F.col(by))
    (
        vectors.write.mode(mode)
        .partitionBy(by)
        .option("maxRecordsPerFile", max_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_vectors(
    spark: SparkSession, path: str, dim: int, schema: str = VECTOR, skip_unreadable: bool = False
) -> DataFrame:
    """The vectors of one dimension; only its folder is read. No vector at all is an error.

    A damaged file stops the read. With ``skip_unreadable`` every file that cannot be read to its end is left
    out as a whole; ``unreadable_files``, which that takes one more pass over the data for, lists them. The
    schema is given, because inferring it would read footers, and could meet a damaged one.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_unreadable).lower())
    vectors = reader.parquet(path).filter(F.col("dim") == dim)
    if skip_unreadable:
        columns = vectors.columns
        bad = unreadable_files(spark, path, dim).select(F.col("file").alias("__file"))
        named = vectors.withColumn("__file", F.col("_metadata.file_path"))
        vectors = named.join(bad, "__file", "left_anti").select(*columns)
    if vectors.select("vec_id").isEmpty():
        raise ValueError(f"no vectors of dimension {dim} in {path}")
    return vectors


def select_dims(vectors: DataFrame, dims: Sequence[int]) -> DataFrame:
    return vectors.filter(F.col("dim").isin(*dims))


def with_file(vectors: DataFrame) -> DataFrame:
    """Adds ``file`` and ``file_size`` of each row, for the verification operators."""
    return vectors.withColumns({"file": F.col("_metadata.file_path"), "file_size": F.col("_metadata.file_size")})


def unreadable_files(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``(file, rows, read)`` of Parquet files that give fewer rows than their footer says.

    ``rows`` is null where the footer cannot be read. Footers are read in tasks, and all columns of every row
    group are decoded to count what a read gives.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(F.col("path").alias("file"))
    )
    table = spark.read.schema(VECTOR).option("ignoreCorruptFiles", "true").parquet(path)
    if dim is not None:
        table = table.filter(F.col("dim") == dim)
        listed = listed.filter(F.contains("file", F.lit(f"/dim={dim}/")))
    whole = table.select(F.col("_metadata.file_path").alias("file"), F.xxhash64("vec_id", "embedding").alias("h"))
    # Sums that need every value of the hash: a plain count would not decode a single page.
    seen = whole.groupBy("file").agg((F.count_if(F.col("h") > 0) + F.count_if(F.col("h") <= 0)).alias("read"))
    footers = listed.mapInArrow(_footers, "file string, rows bigint")
    both = footers.join(seen, "file", "left").select("file", "rows", F.coalesce("read", F.lit(0)).alias("read"))
    return both.filter(F.col("rows").isNull() | (F.col("rows") != F.col("read")))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs
    import pyarrow.parquet as pq

    def rows(uri: str) -> int | None:
        system, name = pyarrow.fs.FileSystem.from_uri(uri)
        try:
            with system.open_input_file(name) as source:
                return pq.read_metadata(source).num_rows
        except (pa.ArrowInvalid, OSError):
            return None

    for batch in batches:
        names = batch["file"].to_pylist()
        counts = pa.array([rows(name) for name in names], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["file"], counts], names=["file", "rows"])


def checked(vectors: DataFrame) -> DataFrame:
    """The same table; reading a vector whose length is not its ``dim`` is an error."""
    wrong = F.format_string("vector %d has %d components, not %d", "vec_id", F.size("embedding"), "dim")
    embedding = F.when(F.size("embedding") == F.col("dim"), F.col("embedding")).otherwise(F.raise_error(wrong))
    return vectors.withColumn("embedding", embedding)


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several vector tables; with a ``dim``, lengths that differ from it are an error."""
    union = reduce(lambda a, b: a.unionByName(b), tables)
    return checked(union) if {"vec_id", "dim", "embedding"} <= set(union.columns) else union


def random_vectors(ids: DataFrame, dims: Sequence[int] = DIMENSIONS, seed: int = 0) -> DataFrame:
    """An N(0,1) vector in half precision per row of ``ids(vec_id)`` and dimension."""
    return stack([normal_rows(ids, "vec_id", "embedding", dim, seed, VECTOR_STREAM, half=True) for dim in dims])


def random_vector_table(
    spark: SparkSession, n: int = NUM_VECTORS, dims: Sequence[int] = DIMENSIONS, seed: int = 0
) -> DataFrame:
    return random_vectors(spark.range(n).withColumnRenamed("id", "vec_id"), dims, seed)


def random_queries(spark: SparkSession, dim: int, n: int = NUM_QUERIES, seed: int = 0) -> DataFrame:
    """``n`` N(0,1) query vectors ``(query_id, dim, qv)`` in DOUBLE, drawn apart from the stored vectors."""
    ids = spark.range(n).withColumnRenamed("id", "query_id")
    return normal_rows(ids, "query_id", "qv", dim, seed, QUERY_STREAM)
