"""Batch embedding with a pluggable encoder, and its rejects."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.session import path_exists

BATCH_SIZE = 2048

#: Called once per task; returns the function that embeds one batch of token lists.
EncoderFactory = Callable[[], Callable[[list[list[str]]], np.ndarray]]


def embed(
    df: DataFrame,
    make_encoder: EncoderFactory,
    dim: int,
    column: str = "tokens",
    batch_size: int = BATCH_SIZE,
    half: bool = True,
    on_error: str = "drop",
) -> DataFrame:
    """Adds ``embedding`` and ``embed_error``, encoding ``batch_size`` rows at a time.

    A task fills its batches across the blocks Spark hands it, and embeds the last, short batch
    too. If the encoder fails on a batch, its rows carry the message and no vector
    (``on_error="drop"``: split them off with ``embedded`` and ``rejected``), or the job stops
    (``on_error="fail"``). ``half`` rounds to half precision.
    """
    if on_error not in ("drop", "fail"):
        raise ValueError("on_error must be 'drop' or 'fail'")
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())]
    )

    def encoded(table: pa.Table, encode) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        try:
            matrix = np.asarray(encode(table[column].to_pylist()))
            if matrix.shape != (n, dim):
                raise ValueError(f"encoder returned shape {matrix.shape}, not {(n, dim)}")
            if half:
                matrix = matrix.astype(np.float16)
            values = pa.array(matrix.astype(np.float32).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), values)
            error = pa.nulls(n, pa.string())
        except Exception as problem:
            if on_error == "fail":
                raise
            vectors = pa.nulls(n, pa.list_(pa.float32()))
            error = pa.array([f"{type(problem).__name__}: {problem}"] * n, pa.string())
        whole = table.append_column("embedding", vectors).append_column("embed_error", error)
        yield from whole.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held < batch_size:
                continue
            table = pa.Table.from_batches(waiting)
            whole = held - held % batch_size
            for at in range(0, whole, batch_size):
                yield from encoded(table.slice(at, batch_size), encode)
            waiting, held = table.slice(whole).to_batches(), held - whole
        if held:
            yield from encoded(pa.Table.from_batches(waiting), encode)

    return df.mapInArrow(run, schema)


def embedded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embed_error").isNull()).drop("embed_error")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embed_error").isNotNull()).drop("embedding")


def embed_run(
    df: DataFrame,
    make_encoder: EncoderFactory,
    dim: int,
    path: str,
    run: str,
    key: Sequence[str],
    column: str = "tokens",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """One run over the rows that no run before has embedded; gives the run's rows, failed ones with their ``embed_error``.

    Vectors and failures of a run are one write below ``path/run=<run>``: the ledger that ``embedded_rows`` and ``embed_failures`` read. A
    run that broke off has left nothing there, and a repeated one replaces its own rows; failed rows come again in the next run by an anti-join.
    """
    spark = df.sparkSession
    done = embedded_rows(spark, path, df.schema).where(F.col("run") != run).select(*key)
    todo = df.join(done, list(key), "left_anti")
    target = f"{path}/run={run}"
    embed(todo, make_encoder, dim, column, batch_size).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(_ledger(df.schema)).parquet(target)


def _ledger(rows: T.StructType) -> T.StructType:
    added = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())]
    return T.StructType(rows.fields + added)


def _runs(spark: SparkSession, path: str, rows: T.StructType) -> DataFrame:
    schema = T.StructType(_ledger(rows).fields + [T.StructField("run", T.StringType())])
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def embedded_rows(spark: SparkSession, path: str, rows: T.StructType) -> DataFrame:
    """All vectors of all runs, with the ``run`` that made each; ``rows`` is the schema of what was embedded."""
    return embedded(_runs(spark, path, rows))


def embed_failures(spark: SparkSession, path: str, rows: T.StructType, key: Sequence[str]) -> DataFrame:
    """``(run, *key, embed_error)`` of failures that no later run has mended."""
    done = embedded_rows(spark, path, rows).select(*key)
    return rejected(_runs(spark, path, rows)).select("run", *key, "embed_error").join(done, list(key), "left_anti")


class HashingEncoder:
    """Offline stand-in for a model: token counts in ``dim`` MD5 buckets, scaled to unit length."""

    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self) -> Callable[[list[list[str]]], np.ndarray]:
        return self._encode

    def _encode(self, batch: list[list[str]]) -> np.ndarray:
        lengths = [len(words) for words in batch]
        codes, vocabulary = pd.factorize(np.array([word for words in batch for word in words], dtype=object))
        buckets = np.array([self._bucket(word) for word in vocabulary], dtype=np.int64)
        rows = np.repeat(np.arange(len(batch)), lengths)
        cells = rows * self.dim + (buckets[codes] if len(codes) else np.empty(0, dtype=np.int64))
        counts = np.bincount(cells, minlength=len(batch) * self.dim).reshape(len(batch), self.dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=counts, where=norms > 0)

    def _bucket(self, word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim


def embed_hashing(df: DataFrame, dim: int, column: str = "tokens") -> DataFrame:
    """The same idea with built-in transformers only: hashed term counts, normalised, on the JVM."""
    counted = HashingTF(numFeatures=dim, inputCol=column, outputCol="__tf").transform(df)
    scaled = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__tf", "__unit")
