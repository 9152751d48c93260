"""Token-id files with bit-plane shuffling.

``write_ids`` encodes texts with the tokenizers library, ends each with ``END_ID``, orders the
documents by id and writes the ids of each shard as a sequence of chunks of ``CHUNK_IDS`` ids (the
last one of a shard is shorter). A chunk is transposed into bit or byte planes, each plane is
compressed with zstandard by itself, and the chunk's row in the file holds the planes together with
the index: its shard, its number, its first id's place and the documents it holds.

Files are Parquet, written by Spark's committer below one folder, so that a lost executor costs a repeated
task and any store that Spark reads will do:

* ``chunks/shard=<s>/``: one row per chunk, in order;
* ``shards/``: ids per shard, from which the first id of each shard follows.

A distinct pre-token is encoded once per worker process (at most ``CACHE_WORDS`` at a time): pre-tokens never
merge across their borders, so this equals encoding the text at once. A text that spells one of the tokenizer's added tokens is given to the
library as a whole, which reads it as that token. The order by document id is
a range partitioning whose bounds come from a fixed hash sample of the ids, so a repeated task sends each row to the
same shard; rows that share an id are spread by the hash of their text.

Defined cases: a null or empty text has the end id only; null ids come first; repeated ids keep
their rows, ordered by text crc; an empty table writes no chunk and reads back as no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm.textops import PreTokens, process_cache, runs
from quillvec.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CHUNK_IDS = 1 << 16
CACHE_WORDS = 1_000_000
SAMPLED = 100  # bounds are taken from about this many documents per shard
_CHUNK = (
    "shard int, chunk int, first bigint, n int, width int, bits boolean, planes array<binary>, "
    "doc_no array<bigint>, doc_id array<bigint>, doc_n array<int>, doc_ends array<boolean>"
)


# -- planes ----------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool) -> tuple[int, list[bytes]]:
    """(bytes per id, compressed planes), least significant plane first; empty top planes are left out."""
    top = int(ids.max()) if len(ids) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    bytes_ = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    squeeze = zstandard.ZstdCompressor(level=3)
    if not bits:
        return width, [squeeze.compress(np.ascontiguousarray(bytes_[:, k]).tobytes()) for k in range(width)]
    planes = np.unpackbits(bytes_, axis=1, bitorder="little").T[: max(1, top.bit_length())]
    return width, [squeeze.compress(np.packbits(plane, bitorder="little").tobytes()) for plane in planes]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(expand.decompress(p), np.uint8) for p in planes]
    if not bits:
        return np.ascontiguousarray(np.stack(raw, axis=1)).view(f"<u{width}").reshape(-1).astype(np.uint32)
    table = np.zeros((n, 8 * width), np.uint8)
    for k, plane in enumerate(raw):
        table[:, k] = np.unpackbits(plane, count=n, bitorder="little")
    return np.packbits(table, axis=1, bitorder="little").view(f"<u{width}").reshape(-1).astype(np.uint32)


# -- ids of texts ----------------------------------------------------------------------------


class Numbers:
    """Numbers 0, 1, 2, ... of distinct 64-bit hashes: an open-addressed table, looked up for many at once.

    24 to 48 bytes a hash, where a dictionary of Python integers takes 200.
    """

    def __init__(self) -> None:
        self.count = 0
        self.keys, self.values = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int64)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for an unknown one."""
        out, at, left = np.full(len(hashes), -1, np.int64), self._place(hashes), np.arange(len(hashes))
        while len(left):
            held = self.values[at[left]]
            same = (held >= 0) & (self.keys[at[left]] == hashes[left])
            out[left[same]] = held[same]
            left = left[(held >= 0) & ~same]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Numbers distinct unknown hashes on from the last one."""
        numbers = self.count + np.arange(len(hashes))
        self.count += len(hashes)
        if 2 * self.count > len(self.keys):
            known = np.flatnonzero(self.values >= 0)
            hashes, numbers = np.concatenate([self.keys[known], hashes]), np.concatenate([self.values[known], numbers])
            size = 1 << (2 * self.count - 1).bit_length()
            self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        at, left = self._place(hashes), np.arange(len(hashes))
        while len(left):
            free = left[self.values[at[left]] < 0]
            self.values[at[free]] = numbers[free]  # of several the last one stays
            mine = free[self.values[at[free]] == numbers[free]]
            self.keys[at[mine]] = hashes[mine]
            left = left[self.values[at[left]] != numbers[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


class WordIds:
    """Ids of pre-tokens; each distinct one is encoded once while the cache holds it."""

    def __init__(self, path: str | None, rules: str | None = None) -> None:
        """``rules`` is the text of a tokenizers JSON file, for tasks that cannot open its path."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(rules) if path is None else Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pre-tokens hold none, see __call__
        self.marks = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.splitter = PreTokens()
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, len(values)), values.dtype)])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [x.ids for x in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, at = int(sizes.sum()), self.known.count
        self.ids = self._room(self.ids, self.used + total)
        self.ids[self.used : self.used + total] = np.fromiter((i for w in ids for i in w), np.uint32, total)
        self.starts, self.sizes = self._room(self.starts, at + len(ids)), self._room(self.sizes, at + len(ids))
        self.starts[at : at + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(ids)] = sizes
        self.used += total
        self.known.add(hashes)

    def marked(self, column: pa.Array) -> np.ndarray:
        """Flags the rows that spell an added token."""
        marked = np.zeros(len(column), bool)
        for mark in self.marks:
            marked |= pc.fill_null(pc.match_substring(column, mark), False).to_numpy(zero_copy_only=False)
        return marked

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offset of each row). A row with one of the tokenizer's added tokens is the library's alone."""
        marked = self.marked(column)
        if not marked.any():
            return self._plain(column)
        ids, offsets = self._plain(pc.if_else(pa.array(marked), pa.scalar(None, column.type), column))
        self.tokenizer.encode_special_tokens = False
        rows = np.flatnonzero(marked)
        whole = [np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in rows.tolist()]
        self.tokenizer.encode_special_tokens = True
        sizes = np.diff(offsets)
        at = np.repeat(offsets[rows], [len(w) for w in whole])
        sizes[rows] = [len(w) for w in whole]
        return np.insert(ids, at, np.concatenate(whole)), np.concatenate([[0], np.cumsum(sizes)])

    def words(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, row of each pre-token from there, bytes, byte starts, byte ends, numbers), piece by piece; the numbers
        hold until the next piece. No row may have an added token."""
        for row, of, text, starts, ends, hashes in self.splitter.pieces(column):
            if self.known.count > CACHE_WORDS:
                self.clear()
            codes, values = pd.factorize(hashes)
            numbers = self.known.find(values)
            new = np.flatnonzero(numbers < 0)
            if len(new):
                first = np.full(len(values), len(codes))
                np.minimum.at(first, codes, np.arange(len(codes)))
                body = text.tobytes()
                words = [body[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[new].tolist()]
                numbers[new] = self.known.count + np.arange(len(new))
                self._learn(values[new], words)
            yield row, of, text, starts, ends, numbers[codes]

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [], np.zeros(len(column), np.int64)
        for row, of, _, _, _, word in self.words(column):
            sizes = self.sizes[word]
            out.append(self.ids[runs(self.starts[word], sizes)])
            if len(of):
                part = np.bincount(of, weights=sizes).astype(np.int64)
                counts[row : row + len(part)] += part
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])


def encode_texts(docs: DataFrame, path: str, bounds: list[tuple], end_id: int = END_ID) -> DataFrame:
    """``(shard, doc_id, tail, ids)``: the ids with the end id, and the shard by the bounds."""
    keys = [((-1, 0) if a is None else (0, a)) + (b,) for a, b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        words = process_cache("word_ids", path, lambda: WordIds(path))
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                ids, offsets = words(part.column("text"))
                rows = part.num_rows
                whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
                at = (offsets + np.arange(rows + 1)) * 4
                names, tails = part.column("doc_id").to_pylist(), part.column("tail").to_pylist()
                shard = [
                    bisect.bisect_right(keys, ((-1, 0) if n is None else (0, n)) + (t,)) for n, t in zip(names, tails)
                ]
                packed = whole.astype("<u2") if len(whole) == 0 or whole.max() < 1 << 16 else whole
                unit = packed.itemsize
                body = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer((at // 4 * unit).astype(np.int64)), pa.py_buffer(packed)]
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(shard, pa.int32()),
                        "doc_id": part.column("doc_id"),
                        "tail": part.column("tail"),
                        "unit": pa.array([unit] * rows, pa.int32()),
                        "ids": body.cast(pa.binary()),
                    }
                )

    return docs.mapInArrow(run, "shard int, doc_id bigint, tail bigint, unit int, ids binary")


def _chunks(chunk_ids: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs: list[list] = []  # [number, id, ids in this chunk, ends here]
        shard, count, chunk, first, doc_no = None, 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, count, chunk, first
            ids = np.concatenate(held)
            width, planes = to_planes(ids, bits)
            columns = [[x] for x in (shard, chunk, first, len(ids), width, bits, planes)]
            columns += [[[d[k] for d in docs]] for k in range(4)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.binary())]
            types += [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.bool_())]
            names = "shard chunk first n width bits planes doc_no doc_id doc_n doc_ends".split()
            chunk, first = chunk + 1, first + len(ids)
            held, docs, count = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for s, name, unit, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "unit", "ids"))):
                if s != shard:
                    if count:
                        yield flush()
                    shard, chunk, first, doc_no = s, 0, 0, 0
                ids = np.frombuffer(body, f"<u{unit}").astype(np.uint32)
                at = 0
                while at < len(ids):
                    take = min(chunk_ids - count, len(ids) - at)
                    held.append(ids[at : at + take])
                    at, count = at + take, count + take
                    docs.append([doc_no, name, take, at == len(ids)])
                    if count == chunk_ids:
                        yield flush()
                doc_no += 1
        if count:
            yield flush()

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    shards: int | None = None,
    chunk_ids: int = CHUNK_IDS,
    bits: bool = False,
) -> None:
    """Writes ``docs`` (``doc_id``, ``text``) as token-id files below ``path``."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("tail"),
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    total = ids.count()
    step = max(1, total // (SAMPLED * shards))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0) if step > 1 else rows
    sample = sorted(
        ((r[0], r[1]) for r in picked.select("doc_id", "tail").collect()), key=lambda r: ((-1, 0) if r[0] is None else (0, r[0])) + (r[1],)
    )
    bounds = sorted({sample[len(sample) * k // shards] for k in range(1, shards)}, key=lambda r: ((-1, 0) if r[0] is None else (0, r[0])) + (r[1],)) if sample else []
    tokens = encode_texts(rows, tokenizer or public_tokenizers.path(TOKENIZER), bounds)
    order = ["shard", F.col("doc_id").asc_nulls_first(), "tail"]
    sorted_rows = tokens.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    chunks = sorted_rows.select("shard", "doc_id", "unit", "ids").mapInArrow(_chunks(chunk_ids, bits), _CHUNK)
    chunks.write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/chunks")
    if total == 0:
        return
    written = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    written.groupBy("shard").agg(F.sum("n").cast("bigint").alias("n")).coalesce(1).write.parquet(f"{path}/shards")


def read_segments(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document and chunk: ``(shard, doc_no, doc_id, chunk, first, n, ends, ids | crc)``.

    ``first`` is the place of the segment's first id in the shard; ``crc`` is the crc32 of its ids.
    """
    kind = "crc bigint" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n"], row["width"], row["bits"]).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_n"])
                starts = ends - row["doc_n"]
                parts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(parts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * n, pa.int32()),
                        "doc_no": pa.array(row["doc_no"], pa.int64()),
                        "doc_id": pa.array(row["doc_id"], pa.int64()),
                        "chunk": pa.array([row["chunk"]] * n, pa.int32()),
                        "first": pa.array(row["first"] + starts, pa.int64()),
                        "n": pa.array(row["doc_n"], pa.int32()),
                        "ends": pa.array(row["doc_ends"], pa.bool_()),
                        **(
                            {"crc": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                            if digest
                            else {"ids": pa.array(parts, pa.binary())}
                        ),
                    }
                )

    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    schema = f"shard int, doc_no bigint, doc_id bigint, chunk int, first bigint, n int, ends boolean, {kind}"
    return chunks.select(*_names(_CHUNK)).mapInArrow(run, schema)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, start)``: the ids in all shards before it. One row per shard of the files."""
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/shards").select("shard", "n").collect())
    starts, total = [], 0
    for shard, n in rows:
        starts.append((shard, total))
        total += n
    return spark.createDataFrame(starts, "shard int, start bigint")


def crc32_combine(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings in a row from theirs and the length of the second.

    Zero bytes act on a crc as a linear map over GF(2); the map for ``length`` of them is made by
    squaring.
    """
    if length == 0:
        return first

    def apply(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    power = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        power = [apply(power, row) for row in power]  # one zero byte
    while length:
        if length & 1:
            first = apply(power, first)
        power = [apply(power, row) for row in power]
        length >>= 1
    return first ^ second


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""
    segments = read_segments(spark, path, digest=True)
    whole = segments.groupBy("shard", "doc_no", "doc_id").agg(
        F.min("first").alias("first"),
        F.sum("n").cast("bigint").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("chunk", "n", "crc"))).alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column("parts").to_pylist():
                crc = parts[0]["crc"]
                for part in parts[1:]:
                    crc = crc32_combine(crc, part["crc"], 4 * part["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "doc_id", "first", "n_tokens")), pa.array(crcs, pa.int64())],
                names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    crcs = whole.mapInArrow(run, "shard int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    placed = crcs.join(F.broadcast(shard_starts(spark, path)), "shard")
    return placed.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, ids)``: whole documents, as little-endian unsigned 32-bit numbers."""
    parts = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    whole = read_segments(spark, path).groupBy("shard", "doc_no", "doc_id").agg(parts.alias("p"))
    return whole.select("doc_id", F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"]))).alias("h")).select(
        "doc_id", F.unhex("h").alias("ids")
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_digests(spark, path)
