"""Source files: listing, contents, and the numbered index of paths.

Files are read on the executors, from a file system that all of them mount.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.operators.ordinal import with_ordinal
from quillvec.schemas import FILE

_ROWS_PER_BATCH = 4096
_BYTES_PER_BATCH = 32 << 20
_READ_BYTES = 1 << 20


# -- listing -------------------------------------------------------------------------------

_ENTRY = "repo_name STRING, path STRING, size BIGINT, error STRING, pending BOOLEAN"


def _entries(folder: str) -> Iterator[tuple[str, int | None, str | None, bool]]:
    """``(path, size, error, is_folder)`` of one folder; linked folders are not entered."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, None, None, True
                    elif entry.is_file():
                        yield entry.path, entry.stat().st_size, None, False
                except OSError as problem:
                    yield entry.path, None, str(problem), False
    except OSError as problem:
        yield folder, None, str(problem), False


def _walk(repo: str, folder: str, levels: int | None) -> Iterator[tuple]:
    """Rows below ``folder``; folders ``levels`` down are left pending (None walks all)."""
    open_folders = [(folder, 0)]
    while open_folders:
        here, depth = open_folders.pop()
        for path, size, error, is_folder in _entries(here):
            if not is_folder:
                yield repo, path, size, error, False
            elif levels is not None and depth + 1 >= levels:
                yield repo, path, None, None, True
            else:
                open_folders.append((path, depth + 1))


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= _ROWS_PER_BATCH:
            yield _batch(buffer, names, types)
            buffer = []
    yield _batch(buffer, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def list_files(roots: DataFrame, split_levels: int = 2, partitions: int | None = None) -> DataFrame:
    """All regular files below ``roots(repo_name, root)``: ``(repo_name, path, size, error)``.

    The upper ``split_levels`` folder levels are listed first and spread over the cluster, so
    one huge repository is walked by many tasks. Unreadable entries come with an error.
    """
    names = ["repo_name", "path", "size", "error", "pending"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, root in zip(batch["repo_name"].to_pylist(), batch["root"].to_pylist()):
                yield from _batched(_walk(repo, root, split_levels), names, types)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.invert(batch["pending"]))
            for row in batch.filter(batch["pending"]).to_pylist():
                yield from _batched(_walk(row["repo_name"], row["path"], None), names, types)

    count = partitions or roots.sparkSession.sparkContext.defaultParallelism
    entries = roots.select("repo_name", "root").repartition(count).mapInArrow(upper, _ENTRY)
    spread = entries.repartition(count, F.xxhash64("path"))
    return spread.mapInArrow(lower, _ENTRY).select(*[field.split()[0] for field in FILE.split(", ")])


# -- contents ------------------------------------------------------------------------------


def _read_text(path: str, max_chars: int | None) -> tuple[str | None, str | None]:
    """Text and error. Undecodable bytes are dropped, line ends become ``\\n``.

    Reading stops at ``max_chars`` characters: such a file is rejected for its length anyway.
    """
    bytes_in = codecs.getincrementaldecoder("utf-8")(errors="ignore")
    parts: list[str] = []
    total, carry = 0, ""
    with open(path, "rb") as source:
        while True:
            data = source.read(_READ_BYTES)
            text = carry + bytes_in.decode(data, final=not data)
            # A trailing \r waits for the next block: it may be half of \r\n.
            carry = "\r" if data and text.endswith("\r") else ""
            text = text[: len(text) - len(carry)].replace("\r\n", "\n").replace("\r", "\n")
            parts.append(text)
            total += len(text)
            if max_chars is not None and total >= max_chars:
                return None, f"has {max_chars} characters or more"
            if not data:
                return "".join(parts), None


def read_contents(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds ``content`` and ``read_error`` to a table with ``path``.

    A missing, irregular or unreadable file has a null content and a reason. With ``max_chars`` a file of
    that many characters has a reason instead of its content, and no more of it is held.
    """
    added = [T.StructField("content", T.StringType()), T.StructField("read_error", T.StringType())]
    schema = T.StructType(files.schema.fields + added)

    def read(path: str | None) -> tuple[str | None, str | None]:
        if path is None or not os.path.isfile(path):
            return None, "not an existing regular file"
        try:
            return _read_text(path, max_chars)
        except OSError as problem:
            return None, str(problem)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, rows = 0, 0, []
            for at, path in enumerate(batch["path"].to_pylist()):
                rows.append(read(path))
                held += len(rows[-1][0] or "")
                if held >= _BYTES_PER_BATCH or at + 1 == batch.num_rows:
                    yield _extended(batch.slice(start, len(rows)), rows)
                    start, held, rows = at + 1, 0, []

    def _extended(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        text, error = (pa.array(column, pa.string()) for column in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, text, error], names=[*batch.schema.names, "content", "read_error"]
        )

    return files.mapInArrow(load, schema)


# -- file index ----------------------------------------------------------------------------


# White space as Unicode defines it, and the four separators U+001C to U+001F.
_GAPS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _strip(value: Column) -> Column:
    return F.trim(value, F.lit(_GAPS))


def parse_index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``"<n> : <path>"`` lines to ``(idx, path, reason)``; ``reason`` is null for a valid line.

    The line splits at its first colon, so paths may contain more.
    """
    line = F.col(column)
    colon = F.instr(line, ":")
    number = _strip(F.substring_index(line, ":", 1)).try_cast("bigint")
    path = _strip(F.substr(line, colon + 1))
    reason = F.when(colon == 0, F.lit("no colon")).when(number.isNull(), F.lit("no number"))
    found = colon > 0
    return lines.select(F.when(found, number).alias("idx"), F.when(found, path).alias("path"), reason.alias("reason"))


def valid_index(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("idx", "path")


def rejected_index(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())


def index_range(index: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Inclusive at both ends; either end may be open."""
    if start is not None:
        index = index.filter(F.col("idx") >= start)
    if end is not None:
        index = index.filter(F.col("idx") <= end)
    return index


def with_worker(index: DataFrame, width: int) -> DataFrame:
    """Adds ``worker_id``: the index cut into ranges of ``width`` numbers."""
    return index.withColumn("worker_id", F.floor((F.col("idx") - 1) / width).cast("int"))


def read_file_index(spark: SparkSession, path: str) -> DataFrame:
    return valid_index(parse_index_lines(spark.read.text(path)))


def number_files(files: DataFrame, order: tuple[str, ...] = ("repo_name", "path")) -> DataFrame:
    """Adds ``idx``, numbering all files 1..N."""
    return with_ordinal(files, list(order), "idx")


def index_lines(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.format_string("%d : %s", "idx", "path").alias("value"))


def write_file_index(numbered: DataFrame, path: str, mode: str = "error") -> None:
    index_lines(numbered).write.mode(mode).text(path)


def write_ranged_index(numbered: DataFrame, path: str, files: int | None = None) -> None:
    """The index as text in order of its numbers, and the first and last number of each file beside it.

    ``path/lines`` has the lines, ``path/extents`` the table ``(file, first, last)``, written last.
    """
    ordered = numbered.repartitionByRange(*([files] if files else []), "idx").sortWithinPartitions("idx")
    index_lines(ordered).write.text(f"{path}/lines")
    spark = numbered.sparkSession
    named = spark.read.text(f"{path}/lines").select("value", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("file"))
    number = F.substring_index("value", " : ", 1).cast("bigint")
    extents = named.groupBy("file").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    extents.coalesce(1).write.parquet(f"{path}/extents")


def ranged_files(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> list[str]:
    """The index files that overlap a range: names only, one per file of the index."""
    extents = spark.read.schema("file string, first bigint, last bigint").parquet(f"{path}/extents")
    low = F.lit(True) if start is None else F.col("last") >= start
    high = F.lit(True) if end is None else F.col("first") <= end
    return [f"{path}/lines/{r.file}" for r in extents.where(low & high).orderBy("first").collect()]


def read_ranged_index(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """``(idx, path)`` of a range, inclusive at both ends; files that do not overlap it are not opened."""
    files = ranged_files(spark, path, start, end)
    lines = spark.read.text(files) if files else spark.createDataFrame([], "value string")
    return index_range(valid_index(parse_index_lines(lines)), start, end)


def existing(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("path"), "path", "left_semi")


def missing(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("path"), "path", "left_anti")
