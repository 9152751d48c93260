"""The corpus steps on a stream: chunking, embedding and cell assignment are row-local, so the
batch operators run unchanged on new files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quillvec.operators.corpus import code_files, visible_files
from quillvec.operators.embedding import EncoderFactory, embedded
from quillvec.plans.corpus import chunk_table, vector_table


def vector_stream(files: DataFrame, make_encoder: EncoderFactory, dim: int) -> DataFrame:
    """Vectors of a stream of ``(path, content)`` with relative paths."""
    usable = code_files(visible_files(files))
    return embedded(vector_table(chunk_table(usable), make_encoder, dim))


def vector_sink(vectors: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends to a Parquet vector table by dimension, exactly once per checkpoint."""
    return (
        vectors.writeStream.format("parquet")
        .partitionBy("dim")
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
    )
