"""Checks of stored vectors: per dimension, per file, and the list of errors.

Input rows are vectors with the file they came from: ``(dim, file, file_size, embedding
[, metadata, model_name])``, as ``sources.vectors.with_file`` adds it. Rows of a file lie together, so the
per-file aggregation combines them before the shuffle; errors stay one row each, because a
folder may have any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.functions.display import expected_mark, human_size
from quillvec.sources.vectors import DIMENSIONS, NUM_VECTORS


def _per_file(rows: DataFrame) -> DataFrame:
    length = F.size("embedding")
    return rows.groupBy("dim", "file").agg(
        F.count("*").alias("n"),
        F.max("file_size").alias("file_size"),
        F.count_if(F.col("embedding").isNull()).alias("n_null"),
        F.count_if(F.col("embedding").isNotNull() & (length != F.col("dim"))).alias("n_wrong"),
        F.min(F.when(length != F.col("dim"), length)).alias("found_dim"),
    )


def _expected(rows: DataFrame, dims: Sequence[int]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(int(d),) for d in dims], "dim int")


def shard_errors(rows: DataFrame, dims: Sequence[int] = DIMENSIONS) -> DataFrame:
    """``(dim, file, error)``: dimensions without files, files without arrays, wrong lengths."""
    files = _per_file(rows)
    absent = _expected(rows, dims).join(rows.select("dim").distinct(), "dim", "left_anti")
    absent = absent.select(
        "dim", F.lit(None).cast("string").alias("file"), F.format_string("dimension %d is missing", "dim").alias("error")
    )
    bad = files.filter((F.col("n_null") > 0) | (F.col("n_wrong") > 0)).select(
        "dim",
        "file",
        F.when(F.col("n_null") > 0, F.lit("rows without a vector"))
        .otherwise(F.format_string("dimension is %d, expected %d", "found_dim", "dim"))
        .alias("error"),
    )
    return absent.unionByName(bad.filter(F.col("dim").isin(*dims)))


def verify_shards(rows: DataFrame, dims: Sequence[int] = DIMENSIONS, expected: int = NUM_VECTORS) -> DataFrame:
    """One row per expected dimension, with zeros where it is missing.

    A file with rows but no vector in some is an error and not counted; a file of another
    length is an error and still counted.
    """
    counted = F.col("n_null") == 0
    per_dim = _per_file(rows).groupBy("dim").agg(
        F.sum(F.when(counted, F.col("n"))).alias("total_vectors"),
        F.count_if(counted).alias("file_count"),
        F.sum(F.when(counted, F.col("file_size"))).alias("total_size_bytes"),
        F.count_if((F.col("n_null") > 0) | (F.col("n_wrong") > 0)).alias("bad_files"),
    )
    joined = _expected(rows, dims).join(per_dim, "dim", "left")
    missing = F.col("bad_files").isNull()
    numbers = ["total_vectors", "file_count", "total_size_bytes"]
    return joined.select(
        "dim",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.when(missing, F.lit(1)).otherwise(F.col("bad_files")).cast("bigint").alias("errors"),
    ).select(
        "*",
        human_size(F.col("total_size_bytes")).alias("total_size"),
        expected_mark(F.col("total_vectors"), F.lit(expected)).alias("mark"),
    )


def verify_files(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per file (and value of ``within``, where given) of ``(file, embedding, metadata)``: vectors, dimension and status.

    ERROR: vectors or metadata are absent altogether. MISMATCH: their counts differ. WARN: the
    dimension is not the one of the first good file (of the same ``within``). A file can be both of the last two, so they
    are also flags.
    """
    files = rows.groupBy(*within, "file").agg(
        F.count("embedding").alias("n_vectors"),
        F.count("metadata").alias("n_metadata"),
        F.min(F.size("embedding")).alias("file_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    )
    return judge_files(files, within)


def judge_files(files: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``verify_files`` from one row per file: ``(*within, file, n_vectors, n_metadata, file_dim, max_dim)``."""
    good = (F.col("n_vectors") > 0) & (F.col("n_metadata") > 0)
    if within:
        best = files.filter(good).groupBy(*within).agg(F.min_by("file_dim", "file").alias("expected_dim"))
        files, expected = files.join(best, list(within), "left"), F.col("expected_dim")
    else:
        # The subquery uses all columns of `files`, so that both share one aggregation of the vectors.
        expected = files.filter(good).agg(F.min_by(F.struct("file_dim", "max_dim"), "file")).scalar()["file_dim"]
    judged = files.select(
        *within,
        "file",
        "n_vectors",
        "n_metadata",
        F.when(F.col("n_vectors") > 0, F.col("file_dim")).alias("file_dim"),
        "max_dim",
        expected.alias("expected_dim"),
        (~good).alias("error"),
    )
    judged = judged.withColumns(
        {
            "warn": ~F.col("error")
            & ((F.col("file_dim") != F.col("expected_dim")) | (F.col("max_dim") != F.col("expected_dim"))),
            "mismatch": ~F.col("error") & (F.col("n_vectors") != F.col("n_metadata")),
        }
    )
    status = (
        F.when(F.col("error"), "ERROR").when(F.col("mismatch"), "MISMATCH").when(F.col("warn"), "WARN").otherwise("OK")
    )
    return judged.withColumn("status", status).drop("error", "max_dim")


def corpus_verification(files: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Totals over ``verify_files``: counted files and vectors, and the expected dimension."""
    counted = F.col("status") != "ERROR"
    return files.groupBy(*within).agg(
        F.count_if(counted).alias("total_files"),
        F.coalesce(F.sum(F.when(counted, F.col("n_vectors"))), F.lit(0)).alias("total_embeddings"),
        F.max("expected_dim").alias("expected_dim"),
        F.count_if(F.col("status") == "ERROR").alias("error_files"),
        F.count_if("warn").alias("warn_files"),
        F.count_if("mismatch").alias("mismatch_files"),
    )
