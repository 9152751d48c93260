"""Whitening, exact duplicates and importance resampling against plain versions."""

import math
import os
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as driver
from compare import connect, difference
from quillvec.llm import dedup_perfect_hash as dedup
from quillvec.llm import numbering, queries
from quillvec.llm import resample_table as resampling
from quillvec.llm import whitening_blocks as whitening

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>"
DOCUMENT = "doc_id bigint, text string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert name in driver.queries() and difference(spark, connect(FOLDER), FOLDER, name) is None


def test_numbers_have_no_gaps(spark):
    rows, n = numbering.numbered(spark.range(1000).repartition(7).where("id % 3 > 0"), "at", "t")
    assert n == 666 and sorted(r.at for r in rows.collect()) == list(range(666))
    assert numbering.numbered(spark.range(0), "at", "t")[1] == 0


# -- whitening -----------------------------------------------------------------------------


def plain_whitening(vectors):
    """{vector number: (deviation, whitened)}, shares and n, from dense matrices; vectors are usable."""
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(row) for row in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    spread = n * x - sums
    return (spread * spread).sum(axis=1), (spread / n).astype(float) @ axes / np.sqrt(values), values / np.trace(covariance), n


def check_whitening(got, vectors, ids, dim):
    deviation, white, share, n = plain_whitening(vectors)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(ids) and all(set(rows) == set(range(1, min(16, dim) + 1)) for rows in by_id.values())
    table = np.array([[by_id[i][c].whitened for c in sorted(by_id[i])] for i in ids])
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * sign).max() < 1e-8
    assert [by_id[i][1].deviation for i in ids] == list(deviation)
    assert [by_id[ids[0]][c].explained for c in sorted(by_id[ids[0]])] == pytest.approx(list(share), rel=1e-9)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-8


def test_whitening_equals_dense_matrices(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(whitening.query(spark, FOLDER).collect(), [r[1] for r in rows], [r[0] for r in rows], 64)


@pytest.fixture()
def query_of(spark, tmp_path):
    def run(rows, schema=VECTORS):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
        return whitening.query(spark, str(tmp_path)).collect()

    return run


def test_whitening_of_copies_and_unusable_vectors(query_of):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    vectors = [(rng.normal(size=5) * [1, 2, 3, 4, 50]).tolist() for _ in range(60)]
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)] + [(100 + i, vectors[0], None, None) for i in range(40)]
    bad = [(200, None, "", 0), (201, [1.0, None, 2.0, 3.0, 4.0], "", 0), (202, [nan] * 5, "", 0), (203, [inf] + [0.0] * 4, "", 0), (204, [], "", 0)]
    got = query_of(rows + bad, VECTORS + ", index string, key int")
    check_whitening(got, [r[1] for r in rows], [r[0] for r in rows], 5)


def test_whitening_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 3 * 8 * 7)
    monkeypatch.setattr(whitening, "TASK_BYTES", 20 * 8 * 7)
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=3).tolist() for _ in range(100)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), VECTORS)).collect()
    _, white, _, _ = plain_whitening(vectors)
    table = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id)])
    assert np.abs(table - white * np.sign((table * white).sum(axis=0))).max() < 1e-8


def test_whitening_without_variance(query_of):
    got = query_of([(1, [2.0, 3.0]), (2, [2.0, 3.0]), (None, [2.0, 3.0])])
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}


def test_whitening_of_a_flat_direction(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got) and got[0].identity_error < 1e-9


def test_whitening_of_nothing_and_of_mixed_lengths(spark, query_of):
    assert query_of([]) == []
    with pytest.raises(Exception, match="components"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS)).collect()


def test_deviation_beyond_a_long_is_exact_or_null(spark, query_of):
    rows = [(i, [float(1 << 40) * i, 0.0]) for i in range(4)]
    deviation, *_ = plain_whitening([r[1] for r in rows])
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert [got[i] for i in range(4)] == list(deviation) and max(deviation) > 1 << 63
    assert {r.deviation for r in query_of(rows)} == {None}


# -- exact duplicates ----------------------------------------------------------------------


def some_digests(n, seed=0):
    return np.frombuffer(b"".join(sha256(f"{seed}:{i}".encode()).digest() for i in range(n)), np.uint8).reshape(n, 32)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    digests = some_digests(n)
    hash_ = dedup.PerfectHash.of(digests)
    assert sorted(hash_.slots(digests)) == list(range(n))


def test_perfect_hash_with_levels_too_few(monkeypatch):
    monkeypatch.setattr(dedup, "LEVELS", 1)
    digests = some_digests(300)
    hash_ = dedup.PerfectHash.of(digests)
    assert len(hash_.rest) > 10 and sorted(hash_.slots(digests)) == list(range(300))


def test_nonmembers_are_told_by_their_bytes():
    digests = some_digests(2000)
    n = np.ones(2000, np.int64)
    shard = dedup.Shard.of(digests, n, np.arange(2000), n.astype(bool), np.arange(2000))
    again = dedup.Shard.read(shard.row(0, 0))
    assert (again.members(some_digests(2000, seed=1)) == -1).all() and sorted(again.members(digests)) == list(range(2000))
    near = digests.copy()
    near[:, 31] ^= 1
    assert (again.members(near) == -1).all()


def plain_groups(rows):
    """Per row (id, id that stays, size), and the number of rows that stay."""
    by_text = {}
    for key, text in rows:
        by_text.setdefault(text or "", []).append(key)
    best = {t: max(ids, key=lambda k: -1 if k is None else k) for t, ids in by_text.items()}
    return Counter((k, best[t or ""], len(by_text[t or ""])) for k, t in rows), len(by_text)


AWKWARD = [(None, "a"), (None, "a"), (3, "b"), (3, "b"), (2, "b"), (5, None), (6, ""), (7, "B"), (8, "b "), (9, "é" * 40000), (4, "é" * 40000), (None, "solo")]


@pytest.mark.parametrize("history", [None, "true", "key % 2 = 0"])
def test_duplicates_equal_plain_groups(spark, monkeypatch, history):
    monkeypatch.setattr(dedup, "PART_DIGESTS", 16)
    monkeypatch.setattr(dedup, "SLICE_ROWS", 20)
    rows = AWKWARD + [(100 + i, f"t{i % 37 if i % 3 else 0}") for i in range(400)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCUMENT + ", place string, digest int").repartition(5)
    got = dedup.find(docs, None if history is None else F.expr(history)).collect()
    want, stay = plain_groups(rows)
    assert Counter((r.key, r.keep, r.group_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == stay and all(r.key == r.keep for r in kept)
    assert {bytes(r.digest) for r in got} == {sha256((t or "").encode()).digest() for _, t in rows}


def test_index_grows_over_batches(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_DIGESTS", 8)
    index, seen = dedup.empty_index(spark, 8), []
    for batch in range(3):
        rows = [(1000 * batch + i, f"t{i % (20 * (batch + 1))}") for i in range(90)]
        seen += rows
        index = dedup.absorb(index, dedup.groups(dedup.digest_rows(spark.createDataFrame(rows, DOCUMENT))))
    assert index.parts > 1 and index.size == 60
    want = {sha256(t.encode()).digest(): (sum(x == t for _, x in seen), max(k for k, x in seen if x == t)) for _, t in seen}
    assert {bytes(r.digest): (r.n, r.key) for r in index.entries().collect()} == want
    new = dedup.digest_rows(spark.createDataFrame([(1, "t3"), (2, "never")], DOCUMENT))
    assert {r.key: r.group_size for r in dedup.resolve(new, index).collect()} == {1: sum(t == "t3" for _, t in seen), 2: None}


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a", "mine", 1.5), (2, "a", None, 2.5), (3, "c", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __place string, kept double")
    assert sorted(map(tuple, dedup.deduplicate(docs).collect()), key=str) == sorted(rows[1:], key=str)


def test_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], DOCUMENT)
    assert dedup.find(docs).count() == 0 and dedup.deduplicate(docs).count() == 0


# -- importance resampling -----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def plain_resample(docs, target, orders=1, percent=10, least=20, buckets=10000):
    def grams(text):
        words = WORD.findall((text or "").translate(FOLD))
        return words, [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]

    def counts(texts):
        return Counter(crc32(g.encode()) % buckets for t in texts for g in grams(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for key, text in docs:
        words, features = grams(text)
        weight = sum(gain(crc32(g.encode()) % buckets) for g in features) // len(features) if features else 0
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, drawn.get(id(r))) for r in out), key=str)


def some_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "ſ", "K", "日本", "don't", "a_b", "naïve", "w" * 40, "v" * 70] + [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 60]))) for _ in range(n)]


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_equals_a_plain_version(spark, monkeypatch, orders):
    monkeypatch.setattr(resampling, "BATCH_BYTES", 3000)
    rows = list(enumerate(some_texts(300))) + [(None, "one two " * 15), (7, None), (8, ""), (9, "- \x00 !"), (500, "long " * 30000)]
    rows += [(10, "tie " * 25)] * 3
    target = some_texts(30, seed=9) + [None, ""]
    docs = spark.createDataFrame([(*r, "a", 2) for r in rows], DOCUMENT + ", weight string, rank int")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, items, percent=30, orders=orders).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, orders, percent=30)


def test_resampling_of_nothing(spark):
    empty, items = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], DOCUMENT)
    assert tuple(resampling.resample(one, items.limit(0), least_words=1, percent=100).first())[:4] == (1, 2, 2, plain_resample([(1, "a b")], [], least=1)[0][3])


def test_vectorised_hash_is_xxhash64():
    rng = random.Random(1)
    parts = [os.urandom(rng.choice([0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 64, 100, 200])) for _ in range(2000)]
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    got = resampling.xxhash64(resampling.Lanes(np.frombuffer(b"".join(parts), np.uint8)), starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(p) for p in parts]


def test_equal_keys_are_told_by_their_bytes():
    words = [f"w{i % 200}".encode() for i in range(3000)]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    table = resampling.GramTable(np.frombuffer(b"".join(words), np.uint8), starts, ends, 97, keys=np.full(3000, 5, np.uint64))
    assert len(table.count) == 200 and set(table.count) == {15}
    assert [int(table.bucket[s]) for s in table.slots] == [crc32(w) % 97 for w in words]
