"""Vector shards of exact size, committed together: ``df.write.format("vector_shards")``.

Rows are numbered within their dimension, so every shard but the last of a dimension has exactly ``max_rows`` rows, whatever tasks
wrote it. A task writes each of its shards under a draft name and reports it in its commit message; when all tasks are done the driver
puts the drafts in place and writes the manifest last. A reader believes the manifest alone: a task that was killed or ran twice leaves drafts,
which the commit clears away, and a write that failed leaves nothing that is read.

Shards lie at ``dim_<D>/batch_<number>.parquet``; the manifests, one per write, are JSON lines below ``_manifest``. Through the driver pass the names and
sizes of shards, not their rows. Executors must mount the folder.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillvec.operators.ordinal import with_ordinal
from quillvec.schemas import VECTOR
from quillvec.sources.filetree import local_path
from quillvec.sources.vectors import SHARD_ROWS

FORMAT = "vector_shards"
MANIFEST = "dim INT, shard BIGINT, file STRING, rows BIGINT, bytes BIGINT"


@dataclass
class Shard:
    dim: int
    shard: int
    draft: str
    rows: int
    bytes: int

    @property
    def file(self) -> str:
        return f"dim_{self.dim}/batch_{self.shard:06d}.parquet"


@dataclass
class Written(WriterCommitMessage):
    shards: list


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.max_rows = int(options["max_rows"])
        self.run = uuid.uuid4().hex
        self.drafts = os.path.join(self.path, "_drafts", self.run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Batches ordered by ``dim`` and ``shard``: a shard is whole when the next begins."""
        done: list[Shard] = []
        sink, current = None, None
        os.makedirs(self.drafts, exist_ok=True)
        try:
            for batch in iterator:
                for key, rows in _runs(batch):
                    if current is None or key != (current.dim, current.shard):
                        if current is not None:
                            done.append(self._closed(sink, current))
                        current = Shard(*key, os.path.join(self.drafts, uuid.uuid4().hex), 0, 0)
                        sink = pq.ParquetWriter(current.draft, rows.schema, compression="zstd")
                    sink.write_batch(rows)
                    current.rows += rows.num_rows
                    if current.rows > self.max_rows:
                        raise ValueError(f"shard {current.file} has more than {self.max_rows} rows")
            if current is not None:
                done.append(self._closed(sink, current))
                sink = None
        finally:
            if sink is not None:
                sink.close()
        return Written(done)

    @staticmethod
    def _closed(sink: pq.ParquetWriter, shard: Shard) -> Shard:
        sink.close()
        shard.bytes = os.path.getsize(shard.draft)
        return shard

    def commit(self, messages: list) -> None:
        shards = sorted((s for message in messages if message for s in message.shards), key=lambda s: (s.dim, s.shard))
        known = self._committed()
        taken = [s.file for s in shards if s.file in known]
        if taken:
            raise FileExistsError(f"{len(taken)} shards are there already, first {taken[0]}")
        for shard in shards:
            target = os.path.join(self.path, shard.file)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(shard.draft, target)
        folder = os.path.join(self.path, "_manifest")
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(self.drafts, "manifest")
        os.makedirs(self.drafts, exist_ok=True)
        with open(draft, "w", encoding="utf-8") as sink:
            for shard in shards:
                row = asdict(shard)
                row["file"] = shard.file
                del row["draft"]
                sink.write(json.dumps(row) + "\n")
        os.replace(draft, os.path.join(folder, f"{self.run}.json"))
        self._clear()

    def _committed(self) -> set[str]:
        """The files that manifests name; others of these names are what a failed commit left, and are replaced."""
        folder, known = os.path.join(self.path, "_manifest"), set()
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            with open(os.path.join(folder, name), encoding="utf-8") as source:
                known |= {json.loads(line)["file"] for line in source}
        return known

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.drafts, ignore_errors=True)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Stretches of equal ``(dim, shard)``, without the shard column."""
    dims, shards = batch["dim"].to_pylist(), batch["shard"].to_pylist()
    rows, start = batch.drop_columns(["shard"]), 0
    for at in range(1, batch.num_rows + 1):
        if at == batch.num_rows or (dims[at], shards[at]) != (dims[start], shards[start]):
            yield (dims[start], shards[start]), rows.slice(start, at - start)
            start = at


class VectorShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("vector_shards are only appended; write to a new folder instead")
        return ShardWriter(dict(self.options))


def placed_in_shards(vectors: DataFrame, max_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds ``shard``: consecutive runs of ``max_rows`` rows of a dimension, in the order of the ids."""
    numbered = with_ordinal(vectors.select("vec_id", "dim", "embedding"), ["dim", "vec_id"])
    first = numbered.groupBy("dim").agg(F.min("idx").alias("first"))
    placed = numbered.join(F.broadcast(first), "dim")  # one row per dimension
    return placed.select("vec_id", "dim", "embedding", F.floor((F.col("idx") - F.col("first")) / max_rows).cast("bigint").alias("shard"))


def write_shards(vectors: DataFrame, path: str, max_rows: int = SHARD_ROWS) -> None:
    """``vectors(vec_id, dim, embedding)`` as shards of exactly ``max_rows`` rows, all of them or none."""
    spark = vectors.sparkSession
    spark.dataSource.register(VectorShards)
    dealt = placed_in_shards(vectors, max_rows).repartitionByRange("dim", "shard").sortWithinPartitions("dim", "shard", "vec_id")
    dealt.write.format(FORMAT).mode("append").option("max_rows", max_rows).save(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(dim, shard, file, rows, bytes)`` of all committed shards."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/_manifest")


def read_shards(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """The rows of the committed shards, of one dimension or all. The names of the files pass through the driver."""
    listed = read_manifest(spark, path)
    listed = listed if dim is None else listed.where(F.col("dim") == dim)
    files = [f"{path.rstrip('/')}/{r.file}" for r in listed.select("file").collect()]
    return spark.read.schema(VECTOR).parquet(*files) if files else spark.createDataFrame([], VECTOR)
