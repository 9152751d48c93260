"""Byte-level BPE over a global shuffle of distinct words.

``encode`` explodes every text into pre-tokens with their positions, in blocks of about
``BLOCK_TOKENS`` pre-tokens (whole rows, one at least). A block sends

* its distinct words, packed by word hash into ``buckets`` rows, to the bucket's task, where every
  distinct word is encoded once for the whole table (a word occurs at most once per block, so the
  commonest word brings no more rows than any other), and
* its positions, as a sequence of word numbers, to the block's task,

and the ids of the words are joined back there by block and put in their positions. Positions go with the words through
both shuffles, so that one pass over the input makes both, and are coded shortly: the commonest words of a block have
small numbers. All are spread evenly by construction, whatever a source, key or word
weighs. Memory: one block, and the distinct
words of one bucket; raise ``buckets`` with the vocabulary. ``decode`` joins the token-byte table, whose size is
the tokenizer's.

Words and positions of a block come from the same pass, so the input need not give the same partitions or order whenever it
is read.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows each give a
row; the keys may be null and are never looked at; no other column is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.textops import PreTokens, freed, runs

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1_000_000
BUCKETS = 256
COMMON = 8192
OUT_BYTES = 8 << 20
WORDS, POSITIONS = 1, 0
_PACKED = "kind int, place bigint, block bigint, bucket int, a binary, b binary"
_PACKED_ARROW = pa.schema(
    [("kind", pa.int32()), ("place", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and the offsets of token 0, 1, ..."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    sizes = np.array([len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers at the smallest width, compressed as byte planes."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=9).compress(
        np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    )


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").reshape(-1)


def _pack_words(numbers: np.ndarray) -> bytes:
    """A sequence of word numbers: the ``COMMON`` commonest by rank, the others by number; ranks below 255 are one byte."""
    counts = np.bincount(numbers)
    common = np.argsort(-counts, kind="stable")[: min(COMMON, np.count_nonzero(counts))]
    code = len(common) + np.arange(len(counts))
    code[common] = np.arange(len(common))
    code = code[numbers]
    parts = [_pack(common), _pack(np.minimum(code, 255)), _pack(code[code >= 255] - 255)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack_words(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(_unpack(data[at + 4 : at + 4 + size]).astype(np.int64))
        at += 4 + size
    common, code, rest = parts
    code[code == 255] += rest
    ranked = code < len(common)
    out = code - len(common)
    out[ranked] = common[code[ranked]]
    return out


class _Block:
    """Rows, their distinct words in order of appearance, and the word number of every pre-token."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.keys: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.blobs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, keys: pa.RecordBatch, column: pa.Array, splitter: PreTokens) -> None:
        counts = np.zeros(len(column), np.int64)
        for row, of, text, starts, ends, hashes in splitter.pieces(column):
            codes, values = pd.factorize(hashes)
            numbers = np.fromiter((self.known.get(int(h), -1) for h in values), np.int64, len(values))
            new = np.flatnonzero(numbers < 0)
            if len(new):
                numbers[new] = len(self.known) + np.arange(len(new))
                self.known.update(zip(values[new].tolist(), numbers[new].tolist()))
                first = np.full(len(values), len(codes))
                np.minimum.at(first, codes, np.arange(len(codes)))
                first = first[new]
                sizes = ends[first] - starts[first]
                self.blobs.append(text[runs(starts[first], sizes)])
                self.sizes.append(sizes)
                self.hashes.append(values[new])
            self.numbers.append(numbers[codes].astype(np.uint32))
            self.tokens += len(codes)
            if len(of):
                part = np.bincount(of)
                counts[row : row + len(part)] += part
        self.keys.append(keys)
        self.counts.append(counts)

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        blob = np.concatenate(self.blobs) if self.blobs else np.zeros(0, np.uint8)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        starts = np.cumsum(sizes) - sizes
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=9)
        for b in range(buckets):
            mine = order[bounds[b] : bounds[b + 1]]
            if len(mine):
                words = blob[runs(starts[mine], sizes[mine])].tobytes()
                yield WORDS, b, block, b, squeeze.compress(words), _pack(sizes[mine])
        sink = pa.BufferOutputStream()
        keys = pa.Table.from_batches(self.keys).combine_chunks()
        keys = keys.append_column("__n", pa.array(np.concatenate(self.counts)))
        with pa.ipc.new_stream(sink, keys.schema) as out:
            out.write_table(keys)
        numbers = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.uint32)
        yield POSITIONS, -1 - block, block, -1, squeeze.compress(sink.getvalue().to_pybytes()), _pack_words(place[numbers])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED_ARROW)], schema=_PACKED_ARROW)


def _flushed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4]) + len(row[5])
        if size > OUT_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _explode(keys: list[str], block_tokens: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            splitter, block, number = PreTokens(), _Block(), None
            for batch in batches:
                for row in range(0, batch.num_rows, 256):
                    part = batch.slice(row, 256)
                    if number is None:
                        number = part.column("__part")[0].as_py() << 32
                    block.add(part.select(keys), part.column("__text"), splitter)
                    if block.tokens >= block_tokens:
                        yield from block.rows(number, buckets)
                        number, block = number + 1, _Block()
            if block.keys:
                yield from block.rows(number, buckets)

        yield from _flushed(rows())

    return run


def _encode_words(encoder: Callable[[], Callable[[list[str]], list[list[int]]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            encode, current, known = encoder(), None, {}
            expand = zstandard.ZstdDecompressor()
            for batch in batches:
                for kind, place, block, bucket, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == POSITIONS:
                        yield kind, place, block, bucket, a, b
                        continue
                    if place != current:
                        current, known = place, {}
                    blob = expand.decompress(a)
                    ends = np.cumsum(_unpack(b).astype(np.int64)).tolist()
                    words, start = [], 0
                    for end in ends:
                        words.append(blob[start:end])
                        start = end
                    new = [w for w in words if w not in known]
                    if new:
                        known.update(zip(new, encode([w.decode() for w in new])))
                    ids = [known[w] for w in words]
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                    flat_ids = np.fromiter((i for w in ids for i in w), np.int64, int(sizes.sum()))
                    yield kind, place, block, bucket, _pack(flat_ids), _pack(sizes)

        yield from _flushed(rows())

    return run


def _assemble(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sizes = None, [], []
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for kind, _, block, _, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if block != current:
                    current, ids, sizes = block, [], []
                if kind == WORDS:
                    ids.append(_unpack(a).astype(np.uint32))
                    sizes.append(_unpack(b).astype(np.int64))
                    continue
                table = pa.ipc.open_stream(expand.decompress(a)).read_all().combine_chunks()
                numbers = _unpack_words(b)
                words = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                starts = np.cumsum(lengths) - lengths
                counts = table.column("__n").to_numpy()
                ends = np.cumsum(counts)
                row, rows = 0, table.num_rows
                while row < rows:
                    # rows of at most about 1M pre-tokens at once, one row at least
                    begin = int(ends[row] - counts[row])
                    last = max(row + 1, int(np.searchsorted(ends, begin + (1 << 20), side="right")))
                    some = numbers[begin : int(ends[last - 1])]
                    long = lengths[some]
                    flat_ids = words[runs(starts[some], long)].astype("<u4")
                    at = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[begin], ends[row:last]]) - begin]
                    column = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), last - row, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(flat_ids)]
                    ).cast(pa.binary())
                    part = table.select(keys).slice(row, last - row).combine_chunks().to_batches()[0]
                    arrays = [*part.columns, pa.array(np.diff(at)), column]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)
                    row = last

    return run


def tiktoken_encoder(ranks) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """``ranks``: a broadcast of the rank table."""

    def make():
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        return lambda words: [own.encode_ordinary(w) for w in words]

    return make


def encode(
    docs: DataFrame,
    ranks_path: str | None = None,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    buckets: int | None = None,
) -> DataFrame:
    """``(*keys, n_tokens, ids)``; ``ids`` are little-endian unsigned 32-bit numbers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(BUCKETS, partitions)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path or public_tokenizers.path(RANKS)))
    rows = docs.select(*keys, F.col(text).alias("__text"), F.spark_partition_id().alias("__part"))
    blocks = rows.mapInArrow(freed(_explode(list(keys), block_tokens, buckets)), _PACKED)
    by_word = blocks.repartition(partitions, "place").sortWithinPartitions("place")
    encoded = by_word.mapInArrow(freed(_encode_words(tiktoken_encoder(ranks))), _PACKED)
    order = ["block", F.col("kind").desc(), "bucket"]
    by_block = encoded.repartition(partitions, "block").sortWithinPartitions(*order)
    fields = [StructField(k, docs.schema[k].dataType) for k in keys]
    schema = StructType([*fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    return by_block.mapInArrow(freed(_assemble(list(keys), to_arrow_schema(schema))), schema)


def decoded(ids: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of a sequence of ids, joined with the token-byte table."""
    starts = offsets[ids]
    return body[runs(starts, offsets[ids + 1] - starts)]


def decode(encoded: DataFrame, ranks_path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``, what its ids stand for."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(read_ranks(ranks_path or public_tokenizers.path(RANKS))))
    schema = StructType([*encoded.schema.fields, StructField("bytes", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        body, offsets = table.value
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                out = [
                    None if x is None else decoded(np.frombuffer(x, "<u4").astype(np.int64), body, offsets).tobytes()
                    for x in part.column(ids).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], schema=arrow)

    return encoded.mapInArrow(freed(run), schema)


def digests(decoded_rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sizes and SHA-256 of the ids and of the decoded bytes."""
    return decoded_rows.select(
        *keys, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return digests(decode(encode(docs)))


def brute_force(text: str | None, path: str | None = None) -> tuple[int, str, str]:
    """One text by the tokenizer library alone, for tests."""
    import tiktoken

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path or public_tokenizers.path(RANKS)), special_tokens={}
    )
    ids = own.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
        hashlib.sha256(own.decode_bytes(ids)).hexdigest(),
    )
