"""What Parquet footers tell about stored vectors, without reading one.

``with_length`` adds the vector's length as a small column; its smallest and largest value, its nulls and the other columns' nulls stand in
the footer of every file. ``read_footers`` opens only footers, in tasks, and with a table of footers from before only those of files that are new or
changed; ``operators.verify.judge_files`` gives the same verdict on them as on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTER = (
    "file string, size bigint, modified timestamp, rows bigint, n_vectors bigint, n_metadata bigint, file_dim int, max_dim int, problem string"
)


def with_length(vectors: DataFrame) -> DataFrame:
    """Adds ``length``, null for a null vector. To be called before a table is written whose footers will be asked."""
    return vectors.withColumn("length", F.when(F.col("embedding").isNotNull(), F.size("embedding")))


def _footer(uri: str) -> tuple:
    """``(rows, n_vectors, n_metadata, file_dim, max_dim, problem)`` of one file."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    try:
        system, name = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_file(name) as source:
            footer = pq.read_metadata(source)
    except (pa.ArrowInvalid, OSError) as problem:
        return None, 0, 0, None, None, f"{type(problem).__name__}: {problem}".split(". ")[0]
    present = {"length": 0, "metadata": 0}
    low, high = [], []
    for group in range(footer.num_row_groups):
        one = footer.row_group(group)
        for number in range(one.num_columns):
            chunk = one.column(number)
            if chunk.path_in_schema not in present:
                continue
            stats = chunk.statistics
            if stats is None or not stats.has_null_count:
                return footer.num_rows, 0, 0, None, None, f"no statistics of {chunk.path_in_schema}"
            present[chunk.path_in_schema] += one.num_rows - stats.null_count
            if chunk.path_in_schema == "length" and stats.has_min_max:
                low.append(stats.min)
                high.append(stats.max)
    return footer.num_rows, present["length"], present["metadata"], min(low, default=None), max(high, default=None), None


def read_footers(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """One row of ``FOOTER`` per Parquet file below ``path``, and ``opened``: whether its footer was read now.

    ``known`` is an earlier result: files of the same name, size and time are taken from it. A file whose footer cannot be read, or has no
    statistics, has a ``problem`` and counts no vectors; one of no bytes at all is passed over, as Spark's scans do.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    listed = reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    keys = ["file", "size", "modified"]
    fresh = listed if known is None else listed.join(known.select(*keys), keys, "left_anti")
    names = [field.split()[0] for field in FOOTER.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(_footer, batch["file"].to_pylist()))) or [[]] * len(kinds)
            columns = [*(batch[k] for k in keys), *(pa.array(c, k) for c, k in zip(found, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    opened = fresh.mapInArrow(read, FOOTER).withColumn("opened", F.lit(True))
    if known is None:
        return opened
    return opened.unionByName(known.join(listed, keys, "left_semi").select(*names).withColumn("opened", F.lit(False)))
