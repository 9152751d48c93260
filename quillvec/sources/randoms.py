"""Seeded normal vectors per row.

A value depends on (row id, position, seed, stream) only, so repartitioning or recomputing a
lost task gives the same table. Drawn in NumPy blocks inside the tasks: the same arithmetic as
column expressions took more than ten times as long, because lambdas box every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR_STREAM, QUERY_STREAM, PLANE_STREAM = 0, 1, 2

_BLOCK_VALUES = 1 << 16
_BATCH_VALUES = 1 << 22
# Increment and multipliers of the splitmix64 generator.
_STEP, _FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _FIRST
    z = (z ^ (z >> np.uint64(27))) * _SECOND
    return z ^ (z >> np.uint64(31))


def normal_matrix(ids: np.ndarray, dim: int, seed: int, stream: int) -> np.ndarray:
    """(n, dim) independent N(0,1) values: one splitmix64 sequence per row, Box-Muller pairs."""
    pairs = (dim + 1) // 2
    out = np.empty((len(ids), 2 * pairs))
    salt = _mixed(np.array([seed % (1 << 64)], dtype=np.uint64) * _STEP + np.uint64(stream + 1))
    counters = np.arange(1, 2 * pairs + 1, dtype=np.uint64) * _STEP
    step = max(1, _BLOCK_VALUES // dim)
    for at in range(0, len(ids), step):
        start = _mixed(ids[at : at + step].astype(np.uint64) * _STEP + salt)
        bits = _mixed(start[:, None] + counters) >> np.uint64(11)
        radius = np.sqrt(-2.0 * np.log((bits[:, :pairs] + np.uint64(1)) * 2.0**-53))
        angle = bits[:, pairs:] * (2.0 * np.pi * 2.0**-53)
        out[at : at + step, 0::2] = radius * np.cos(angle)
        out[at : at + step, 1::2] = radius * np.sin(angle)
    return out[:, :dim]


def normal_rows(
    ids: DataFrame, key: str, column: str, dim: int, seed: int, stream: int = VECTOR_STREAM, half: bool = False
) -> DataFrame:
    """``(key, dim, column)`` with a vector per id: DOUBLE, or half precision kept in FLOAT."""
    kind = pa.float32() if half else pa.float64()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _BATCH_VALUES // dim)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.column(0).slice(at, step)
                matrix = normal_matrix(some.to_numpy(), dim, seed, stream)
                if half:
                    matrix = matrix.astype(np.float16).astype(np.float32)
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim)
                values = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), kind))
                dims = pa.array(np.full(len(some), dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([some, dims, values], names=[key, "dim", column])

    element = "float" if half else "double"
    return ids.select(F.col(key).cast("bigint")).mapInArrow(draw, f"{key} bigint, dim int, {column} array<{element}>")
