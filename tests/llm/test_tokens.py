"""Byte-level BPE and token-id files against the tokenizer libraries, and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillvec.llm import bpe_words as bpe
from quillvec.llm import tokens_bitplane as files
from quillvec.session import scratch_path

ROWS = [
    (5, "The cat's hat, we'll see.  Über-straße\n\n\n x"),
    (None, "no id"),
    (3, None),
    (1, ""),
    (2, " "),
    (2, " "),
    (2, "<|endoftext|> 日本語 😀  'quoted'"),
    (9, "lang " * 40000 + "zzz" * 3000),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, ids string, shard string")


@pytest.mark.parametrize("block_tokens, buckets", [(bpe.BLOCK_TOKENS, None), (10, 3)])
def test_bpe_equals_the_library(spark, block_tokens, buckets):
    docs = table(spark).repartition(3, "doc_id")
    encoded = bpe.encode(docs, block_tokens=block_tokens, buckets=buckets)
    rows = bpe.decode(encoded).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.bytes), r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in rows)
    want = sorted((i is None, i or 0, (t or "").encode(), *bpe.brute_force(t)[:2]) for i, t in ROWS)
    assert got == want


def test_bpe_digests(spark):
    rows = bpe.digests(bpe.decode(bpe.encode(table(spark)))).collect()
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    assert got == sorted(bpe.brute_force(t) for _, t in ROWS)


def test_bpe_of_rows_that_move_between_scans(spark):
    def other_order(batches):
        rng = np.random.default_rng()
        for batch in batches:
            yield batch.take(pa.array(rng.permutation(batch.num_rows)))

    rows = [(k, f"word{k} only{k}") for k in range(400)]
    docs = table(spark, rows).repartition(2)
    encoded = bpe.encode(docs.mapInArrow(other_order, docs.schema), block_tokens=20, buckets=3)
    got = sorted((r.doc_id, bytes(r.bytes).decode()) for r in bpe.decode(encoded).collect())
    assert got == rows


@pytest.mark.parametrize("words, length", [(0, 0), (1, 5), (300, 4000), (30000, 60000)])
def test_word_numbers_round_trip(words, length):
    numbers = (np.random.default_rng(words).random(length) ** 3 * words).astype(np.uint32)
    assert (bpe._unpack_words(bpe._pack_words(numbers)) == numbers).all()


def test_bpe_of_an_empty_table(spark):
    assert bpe.decode(bpe.encode(table(spark, []))).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [2, 255, 256, 50000, 1 << 20])
def test_planes_round_trip(bits, top):
    ids = np.random.default_rng(top).integers(0, top, 3001).astype(np.uint32)
    width, planes = files.to_planes(ids, bits)
    assert (files.from_planes(planes, len(ids), width, bits) == ids).all()


def test_crc32_combine():
    a, b = b"hello" * 9, b"world" * 12345
    assert files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert files.crc32_combine(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def brute(rows):
    """(doc_id, start, n, crc) in ascending id order by the library alone."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(files.TOKENIZER))
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    out, start = [], 0
    for i, t in sorted(rows, key=key):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, files.END_ID], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("chunk_ids, bits, shards", [(files.CHUNK_IDS, False, 3), (7, True, 4), (1, False, 1)])
def test_files_equal_the_library(spark, chunk_ids, bits, shards):
    rows = ROWS if chunk_ids > 1 else ROWS[:-1]
    path = scratch_path(spark, "ids")
    files.write_ids(table(spark, rows).repartition(3), path, shards=shards, chunk_ids=chunk_ids, bits=bits)
    got = sorted(map(tuple, files.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    whole = files.read_ids(spark, path).select("doc_id", F.crc32("ids"), F.octet_length("ids")).collect()
    assert sorted((str(a), b, c) for a, b, c in whole) == sorted((str(i), crc, 4 * n) for i, _, n, crc in brute(rows))


def test_a_hot_id_is_spread_over_shards(spark):
    rows = [(7, f"text {k}") for k in range(300)] + [(k, "a") for k in range(100, 120)]
    path = scratch_path(spark, "ids")
    files.write_ids(table(spark, rows), path, shards=4)
    assert spark.read.parquet(f"{path}/chunks").select("shard").distinct().count() == 4
    got = sorted(map(tuple, files.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_files_of_an_empty_table(spark):
    path = scratch_path(spark, "ids")
    files.write_ids(table(spark, []), path)
    assert files.read_segments(spark, path).count() == 0


def test_word_ids_forget(monkeypatch):
    monkeypatch.setattr(files, "CACHE_WORDS", 3)
    words = files.WordIds(public_tokenizers.path(files.TOKENIZER))
    texts = ["one two three four", "five six", None, "one two"]
    for _ in range(3):
        ids, offsets = words(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_in_texts_are_read_as_the_library_does(spark):
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}", "plain", None, "", f"é{mark}x\n" * 300, "<|endoftext", f"  {mark}  end", "plain again"]
    words = files.WordIds(public_tokenizers.path(files.TOKENIZER))
    library = Tokenizer.from_file(public_tokenizers.path(files.TOKENIZER))
    ids, offsets = words(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
    path = scratch_path(spark, "ids")
    files.write_ids(table(spark, list(enumerate(texts))), path, shards=2)
    assert sorted(map(tuple, files.read_digests(spark, path).collect()), key=lambda r: r[1]) == brute(list(enumerate(texts)))


def test_numbers_of_hashes_that_share_places():
    rng = np.random.default_rng(3)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 60, 90_000).astype(np.uint64), np.arange(500, dtype=np.uint64) << np.uint64(40)]))
    rng.shuffle(hashes)
    table = files.Numbers()
    for at in range(0, len(hashes), 7001):
        table.add(hashes[at : at + 7001])
    assert (table.find(hashes) == np.arange(len(hashes))).all() and table.count == len(hashes)
    assert (table.find(hashes + np.uint64(1 << 62)) == -1).all() and len(table.find(hashes[:0])) == 0
