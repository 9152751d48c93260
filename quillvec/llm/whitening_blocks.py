"""Whitening of embeddings by distributed block matrices.

Entries become integers ``x = floor(64 c) + 1000000``. The fit list holds each distinct x-vector once; its
centred rows are indexed and laid out as a ``BlockMatrix``, whose transpose times itself is the scatter. The
eigenvectors of the small covariance are found on the driver, and a second block product projects
all rows on the components over the root of their eigenvalues.

Centring is exact: ``n * x - S`` is taken in integers before the division by n, so the offset of a million
costs no digits. Copies meet only in a ``distinct``, which combines before it shuffles; after that every row is
projected by itself, so a vector that a third of all rows hold is no hot key.

A product deals the blocks of the middle dimension over many tasks, each of about ``TASK_BYTES``, and adds the small
results. The coordinates of the blocks (two integers per ``BLOCK_BYTES`` of rows) pass through the driver, as MLlib
plans its products there. Vectors have at most ``MAX_DIM`` components, as the covariance is solved on the driver.

Defined cases: a vector that is null, empty or holds null or non-finite entries is left out; an id may be null or stand on several
rows, each row is answered; vectors of different lengths, and entries of 2^46 or more, are errors; an empty table gives an empty
result; a component without variance (an eigenvalue of nothing but rounding, or a single distinct vector) has null
``whitened`` values and no part in ``identity_error``; if all have none, ``explained`` is null as well.
Columns other than the key and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.numbering import numbered

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK_BYTES = 4 << 20
TASK_BYTES = 64 << 20
MAX_DIM = 4096
#: Entries from here on would not be exact integers in a double.
_LARGEST = float(1 << 46)


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct x-vectors with per-dimension ``sums``; lives on the driver.

    ``axes`` holds a unit eigenvector per column, ``eigenvalues`` fall. ``error`` is the largest absolute
    entry of the whitened fit list's covariance minus the identity.
    """

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    error: float | None

    @property
    def usable(self) -> np.ndarray:
        """Components that have variance beyond rounding."""
        return self.eigenvalues > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    @property
    def matrix(self) -> np.ndarray:
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.eigenvalues, 1.0)), np.inf)
        return self.axes / scale


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(key, x)`` of every usable vector."""
    v = F.col(column)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    too_large = F.raise_error(F.lit("an entry of 2^46 or more has no exact integer"))
    entry = lambda c: F.when(F.abs(c) < _LARGEST, F.floor(c.cast("double") * SCALE) + OFFSET).otherwise(too_large)
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & fine)
    return rows.select(F.col(key).alias("key"), F.transform(v, entry).alias("x"))


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact per-dimension sums of the fit list; one short row per task and dimension is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dim = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # 256 values of up to 2^53 cannot overflow
                x = _matrix(batch["x"].slice(at, 256))
                if dim not in (None, x.shape[1]):
                    raise ValueError(f"vectors of {dim} and of {x.shape[1]} components")
                dim = x.shape[1]
                part = [int(v) for v in x.sum(axis=0)]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0)), pa.array([dim] * dim, pa.int32())],
                names=["j", "s", "dim"],
            )

    parts = fit.select("x").mapInArrow(add, "j int, s decimal(38,0), dim int")
    rows = parts.groupBy("j").agg(F.sum("s").cast("decimal(38,0)"), F.min("dim"), F.max("dim")).orderBy("j").collect()
    widths = {w for row in rows for w in row[2:]}
    if len(widths) > 1:
        raise ValueError(f"vectors of {min(widths)} and of {max(widths)} components")
    return len(rows), [int(row[1]) for row in rows]


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of {lengths.min()} and of {lengths.max()} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64, copy=False)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exactly; Python integers where 64 bits might not do."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``(index, vector)``: ``(n * x - S) / n`` of numbered rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (_differences(_matrix(batch["x"]), n, sums) / n).astype(np.float64)
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(sums))
            vector = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch["index"], vector], names=["index", "vector"])

    return rows.select("index", "x").mapInArrow(run, "index bigint, vector array<double>")


def deviations(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``(index, key, deviation)``: the sum of ``(n * x - S)^2`` over the dimensions, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _differences(_matrix(batch["x"]), n, sums)
            if len(d) and len(sums) * int(np.abs(d).max()) ** 2 >= 1 << 63:
                d = d.astype(object)
            squares = [Decimal(int(v)) for v in (d * d).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch["index"], batch["key"], pa.array(squares, pa.decimal128(38, 0))], names=["index", "key", "deviation"]
            )

    kind = dict(rows.dtypes)["key"]
    return rows.select("index", "key", "x").mapInArrow(run, f"index bigint, key {kind}, deviation decimal(38,0)")


def blocks(rows: DataFrame, count: int, dim: int) -> BlockMatrix:
    """Numbered vectors as row blocks of about ``BLOCK_BYTES``, over tasks of at most about ``TASK_BYTES``."""
    tasks = -(-count * dim * 8 // TASK_BYTES)
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks, "index")
    typed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(typed, count, dim).toBlockMatrix(max(1, BLOCK_BYTES // (8 * dim)), dim)


def _gram(matrix: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself; its row blocks are dealt over many tasks, each with bounded bytes."""
    tasks = SparkContext.getOrCreate().defaultParallelism
    row_blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    per_task = max(1, TASK_BYTES // (2 * 8 * matrix.rowsPerBlock * matrix.colsPerBlock))
    splits = min(row_blocks, max(tasks, -(-row_blocks // per_task)))
    turned = matrix.transpose()
    # The Python method has no argument for the splits of the middle dimension; the JVM's has.
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, int(splits))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _times(matrix: BlockMatrix, right: np.ndarray) -> BlockMatrix:
    """The matrix times a small one that is a single block."""
    local = DenseMatrix(*right.shape, right.ravel(order="F").tolist())
    one = BlockMatrix(SparkContext.getOrCreate().parallelize([((0, 0), local)], 1), matrix.colsPerBlock, right.shape[1], *right.shape)
    return matrix.multiply(one)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of ``rows(x)``; None without any."""
    distinct, n = numbered(rows.select("x").distinct(), "index", "whitening-fit")
    if n == 0:
        return None
    dim, sums = _sums(distinct)
    if dim > MAX_DIM:
        raise ValueError(f"{dim} components; the covariance of more than {MAX_DIM} is not solved on the driver")
    matrix = blocks(centred(distinct, n, sums), n, dim)
    covariance = _gram(matrix) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = min(components, dim)
    values, axes = np.maximum(values[::-1][:kept], 0.0), axes[:, ::-1][:, :kept]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    model = Whitening(n, tuple(sums), values, axes * signs, float(np.trace(covariance)), None)
    used = model.usable
    error = None
    if used.any():
        spread = _gram(_times(matrix, np.ascontiguousarray(model.matrix[:, used]))) / n
        error = float(np.abs(spread - np.eye(int(used.sum()))).max())
    return Whitening(n, tuple(sums), values, axes * signs, model.trace, error)


def project(rows: DataFrame, count: int, model: Whitening) -> DataFrame:
    """``(index, whitened)``, an array over the components, of numbered rows; a row is projected whatever copies it has."""
    product = _times(blocks(centred(rows, model.n, list(model.sums)), count, len(model.sums)), model.matrix)
    height, used = product.rowsPerBlock, model.usable

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, parts = batch.column(0).field(0).to_pylist(), batch.column(1)
            for at, block in enumerate(places):
                part = parts.slice(at, 1)
                tall, wide = part.field("numRows")[0].as_py(), part.field("numCols")[0].as_py()
                values = part.field("values").flatten().to_numpy(zero_copy_only=False)
                shape, order = (tall, wide), "C" if part.field("isTransposed")[0].as_py() else "F"
                values = np.ascontiguousarray(values.reshape(shape, order=order))
                gone = np.broadcast_to(~used, values.shape).ravel()
                offsets = pa.array(np.arange(tall + 1, dtype=np.int32) * wide)
                listed = pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), mask=gone))
                index = pa.array(np.arange(tall, dtype=np.int64) + block * height)
                yield pa.RecordBatch.from_arrays([index, listed], names=["index", "whitened"])

    made = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    return made.mapInArrow(rows_of, "index bigint, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(key, n, deviation, whitened, explained, identity_error)`` of every usable vector; arrays run over the components."""
    rows, count = numbered(integer_vectors(vectors, key, column), "index", "whitening-rows")
    model = fit(rows, components)
    if model is None:
        kind = dict(rows.dtypes)["key"]
        schema = f"{key} {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.eigenvalues]
    placed = deviations(rows, model.n, list(model.sums)).join(project(rows, count, model), "index")
    return placed.select(
        F.col("key").alias(key),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.lit(share).cast("array<double>").alias("explained"),
        F.lit(model.error).cast("double").alias("identity_error"),
    )


def query(spark, folder: str) -> DataFrame:
    """One row per usable vector and component; a deviation beyond a long is null."""
    rows = whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    wide = rows.select("vec_id", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "identity_error", pairs)
    return wide.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )
