"""Overlapping line chunks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.functions.text import tokens

# Lines per chunk, lines between chunk starts, tokens kept per chunk.
CHUNK_LINES = 8
STRIDE_LINES = 4
MAX_TOKENS = 128


def chunk_lines(df: DataFrame, text: str = "content", size: int = CHUNK_LINES, stride: int = STRIDE_LINES) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` (from 0), ``start_line`` (from 1),
    ``n_lines`` and ``chunk``.

    A text of fewer than ``size`` lines is one chunk. Otherwise windows of ``size`` lines start
    every ``stride`` lines as long as they are full; lines after the last full window are in no
    chunk. Rows with a null text give none.
    """
    others = [c for c in df.columns if c != text]
    lines = df.select(*others, F.split(text, "\n", -1).alias("__lines"))
    count = F.size("__lines")
    # A null text meets neither case; its null starts explode to no row. A filter for it would
    # be pushed below and split every text a second time.
    starts = F.when(count.between(1, size - 1), F.array(F.lit(0))).when(
        count >= size, F.sequence(F.lit(0), F.greatest(count - size, F.lit(0)), F.lit(stride))
    )
    placed = lines.select(*others, "__lines", F.posexplode(starts).alias("chunk_no", "__start"))
    return placed.select(
        *others,
        "chunk_no",
        (F.col("__start") + 1).alias("start_line"),
        F.least(count, F.lit(size)).alias("n_lines"),
        F.array_join(F.slice("__lines", F.col("__start") + 1, F.lit(size)), "\n").alias("chunk"),
    )


def truncate_tokens(df: DataFrame, text: str = "chunk", limit: int = MAX_TOKENS) -> DataFrame:
    """Adds ``tokens``, the first ``limit`` whitespace-separated tokens."""
    return df.withColumn("tokens", tokens(F.col(text), limit))
