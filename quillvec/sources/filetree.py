"""Source trees as a data source: ``spark.read.format("file_tree").load(root)``.

One row per regular file below the root's folders, hidden and underscored names included: ``(repo_name, path, extension, size, content, error)``.
The planner lists the upper folder levels and deals what lies below over tasks; a task walks its folders and opens a file only when no pushed filter
excludes it. Equality and ``IN`` on ``repo_name`` prune whole folders before they are listed; ``extension``, ``path`` and ``size`` filters are
judged before a file is opened. What cannot be listed or read is a row with an ``error``, never a failed task.

Options: ``content`` (``true``: read the files; ``false``: null contents), ``max_chars`` (longer files get an error instead of their text),
``levels`` (folder levels the planner lists, 2 by default), ``partitions`` (tasks at most, 256 by default). Executors must mount the root.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from quillvec.sources.files import _entries, _read_text, _walk

FORMAT = "file_tree"
SCHEMA = "repo_name STRING, path STRING, extension STRING, size BIGINT, content STRING, error STRING"
LEVELS, PARTITIONS = 2, 256
_ROWS, _BYTES = 4096, 32 << 20
_NAMES = ("repo_name", "path", "extension", "size")

_TESTS = {
    EqualTo: lambda value, wanted: value == wanted,
    In: lambda value, wanted: value in wanted,
    GreaterThan: lambda value, wanted: value > wanted,
    GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    LessThan: lambda value, wanted: value < wanted,
    LessThanOrEqual: lambda value, wanted: value <= wanted,
    StringStartsWith: lambda value, wanted: value.startswith(wanted),
    StringEndsWith: lambda value, wanted: value.endswith(wanted),
}


def local_path(path: str) -> str:
    """The mounted path of a plain name or a ``file:`` address."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def extension_of(path: str) -> str:
    """The last suffix of a file name, lower-cased; a leading dot starts none."""
    name = os.path.basename(path)
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


@dataclass(frozen=True)
class Test:
    """One pushed filter: a null passes none, as in SQL."""

    column: str
    kind: type
    wanted: object

    def __call__(self, value) -> bool:
        return value is not None and (self.kind is IsNotNull or _TESTS[self.kind](value, self.wanted))


@dataclass
class Folders(InputPartition):
    """``(repo_name, folder or file, is_folder, size, error)`` of one task."""

    places: list


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.content = options.get("content", "true").lower() == "true"
        self.max_chars = int(options["max_chars"]) if "max_chars" in options else None
        self.levels = int(options.get("levels", LEVELS))
        self.most = int(options.get("partitions", PARTITIONS))
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            column = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if column in _NAMES and (type(one) in _TESTS or isinstance(one, IsNotNull)):
                self.tests.append(Test(column, type(one), getattr(one, "value", None)))
            else:
                yield one

    def _wanted(self, **values) -> bool:
        return all(test(values[test.column]) for test in self.tests if test.column in values)

    def partitions(self) -> list[InputPartition]:
        places: list[tuple] = []
        for path, size, error, is_folder in _entries(self.root):
            repo = os.path.basename(path)
            if not is_folder:
                places.append(("", path, False, size, error))
            elif self._wanted(repo_name=repo):
                rows = [(repo, path, None, None, True)] if self.levels < 2 else _walk(repo, path, self.levels - 1)
                places += [(of, below, pending, size, error) for of, below, size, error, pending in rows]
        count = max(1, min(self.most, len(places)))
        return [Folders(places[start::count]) for start in range(count)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[4] or "")
            if len(rows) >= _ROWS or held >= _BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _rows(self, partition: Folders) -> Iterator[tuple]:
        for repo, path, is_folder, size, error in partition.places:
            found = _walk(repo, path, None) if is_folder else [(repo, path, size, error, False)]
            for _, name, size, error, _ in found:
                extension = extension_of(name)
                if self._wanted(repo_name=repo, path=name, extension=extension, size=size):
                    content = None
                    if error is None and self.content:
                        content, error = self._text(name)
                    yield repo, name, extension, size, content, error

    def _text(self, path: str) -> tuple[str | None, str | None]:
        try:
            return _read_text(path, self.max_chars)
        except OSError as problem:
            return None, str(problem)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64() if name == "size" else pa.string() for name in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("file_tree needs a root folder to load")
        return FileTreeReader(dict(self.options))


def register_file_tree(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)


def read_file_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    register_file_tree(spark)
    return spark.read.format(FORMAT).options(**options).load(root)


def write_file_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes ``files(path, content BINARY)`` below ``root``, in tasks, and gives ``(path, error)`` of what was not written.

    A file is written under another name and put in place when it is whole, so a repeated task leaves no half of it.
    """
    top = local_path(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            failed = []
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                target = os.path.join(top, name or "")
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    draft = os.path.join(top, f".draft-{uuid.uuid4().hex}")
                    with open(draft, "wb") as sink:
                        sink.write(data or b"")
                    os.replace(draft, target)
                except OSError as problem:
                    failed.append((name, str(problem)))
            paths, errors = zip(*failed) if failed else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["path", "error"])

    return files.select("path", "content").mapInArrow(write, "path string, error string")
