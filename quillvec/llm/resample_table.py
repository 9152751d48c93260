"""Importance resampling towards a target distribution over hashed n-grams.

Every n-gram of words falls into one of ``buckets`` by its crc32. A bucket's gain is the floored, scaled log ratio of its smoothed
share in the target to that in the corpus, a document's weight the floored mean gain of its n-grams, its score the
weight plus Gumbel noise from a hash of its id. Drawing the highest scores is then sampling without replacement in
proportion to the exponential of the weights.

Inside a task the n-grams of a batch are interned in an open-addressed NumPy table: xxhash64 keys, linear probing, and a comparison of the
bytes before an occurrence takes a slot. A slot holds the n-gram's bucket and count, so crc32 runs once per distinct n-gram of a batch; the
slot ids of the occurrences gather the gains. Tables live for one batch of about ``BATCH_BYTES`` of text (or one longer text), so no task's memory
follows the vocabulary.

Two passes over the texts: counts per bucket (added up in the tasks, one short row per task and bucket is shuffled) and weights. The
gains are an array of ``buckets`` numbers, the only thing that is broadcast. Ranks come from a range partitioning of the scores.

Defined cases: a null or empty text has no word, no n-gram and weight 0; a null id is hashed as an empty one and ranks before others of
the same score; rows that share an id share their noise and are drawn one by one; an empty target or corpus has no counts, so gains come from smoothing alone;
an empty table gives an empty result; columns besides id and text are ignored. A text of any length is taken whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.textops import flat, runs, slices
from quillvec.operators.ordinal import with_ordinal
from quillvec.session import stored

BUCKETS = 10_000
ORDERS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
BATCH_BYTES = 4 << 20

# The primes of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc, lane) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


class Lanes:
    """Little-endian 8-byte words from any byte position of a buffer; zeros follow its end."""

    def __init__(self, body: np.ndarray):
        self.body = np.concatenate([body, np.zeros(16, np.uint8)])
        self.wide = np.ndarray((len(self.body) - 7,), "<u8", self.body, strides=(1,))

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return self.wide[at].astype(np.uint64, copy=False)


def xxhash64(lanes: Lanes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of many byte ranges at once: one step handles a lane of all ranges that have it."""
    lengths = ends - starts
    h = _P5 + lengths.astype(np.uint64)
    at = starts.copy()
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        seeds = np.array([_P1, _P2, 0, 0], np.uint64) + np.array([_P2, 0, 0, ~_P1 + np.uint64(1)], np.uint64)
        acc = [np.full(len(long), v, np.uint64) for v in seeds]
        stripes, cursor = lengths[long] // 32, starts[long].copy()
        live, done = np.arange(len(long)), 0
        while len(live):
            for k in range(4):
                acc[k][live] = _round(acc[k][live], lanes(cursor[live] + 8 * k))
            cursor[live] += 32
            done += 1
            live = live[stripes[live] > done]
        mixed = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for k in range(4):
            mixed = (mixed ^ _round(np.uint64(0), acc[k])) * _P1 + _P4
        h[long] = mixed + lengths[long].astype(np.uint64)
        at[long] = cursor
    live = np.flatnonzero(ends - at >= 8)
    while len(live):
        h[live] = _rotl(h[live] ^ _round(np.uint64(0), lanes(at[live])), 27) * _P1 + _P4
        at[live] += 8
        live = live[ends[live] - at[live] >= 8]
    live = np.flatnonzero(ends - at >= 4)
    if len(live):
        h[live] = _rotl(h[live] ^ (lanes(at[live]) & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[live] += 4
    live = np.flatnonzero(ends > at)
    while len(live):
        h[live] = _rotl(h[live] ^ lanes.body[at[live]].astype(np.uint64) * _P5, 11) * _P1
        at[live] += 1
        live = live[ends[live] > at[live]]
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _same_bytes(lanes: Lanes, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    same, live = np.ones(len(a), bool), np.arange(len(a))
    for done in range(0, int(lengths.max(initial=0)), 8):
        live = live[lengths[live] > done]
        rest = np.minimum(lengths[live] - done, 8).astype(np.uint64)
        differ = (lanes(a[live] + done) ^ lanes(b[live] + done)) << (np.uint64(8) * (np.uint64(8) - rest))
        same[live[differ != 0]] = False
        live = live[differ == 0]
    return same


class GramTable:
    """The distinct byte ranges of one batch: open addressing over xxhash64 keys.

    ``slots`` is the slot of every range; per slot, ``bucket`` and ``count``. ``keys`` can be given, as tests of colliding keys do.
    """

    def __init__(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        lanes, lengths, n = Lanes(body), ends - starts, len(starts)
        keys = xxhash64(lanes, starts, ends) if keys is None else keys
        size = 1 << max(4, (2 * n - 1).bit_length())
        holder = np.full(size, -1, np.int64)  # the range that owns a place
        mine, place = np.full(n, -1, np.int64), (keys & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = place[left]
            free = left[holder[at] < 0]
            holder[place[free]] = free  # of several the last one stays
            owner = holder[at]
            same = (keys[owner] == keys[left]) & (lengths[owner] == lengths[left])
            maybe = np.flatnonzero(same & (owner != left))
            same[maybe] = _same_bytes(lanes, starts[owner[maybe]], starts[left[maybe]], lengths[left[maybe]])
            mine[left[same]] = owner[same]
            left = left[~same]
            place[left] = (place[left] + 1) & (size - 1)
        number = np.full(n, -1, np.int64)
        owners = np.flatnonzero(mine == np.arange(n))
        number[owners] = np.arange(len(owners))
        self.slots = number[mine]
        self.count = np.bincount(self.slots, minlength=len(owners))
        view = memoryview(body)
        crcs = (zlib.crc32(view[a:b]) for a, b in zip(starts[owners].tolist(), ends[owners].tolist()))
        self.bucket = np.fromiter(crcs, np.int64, len(owners)) % buckets


class Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""

    def __init__(self) -> None:
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.inside = np.zeros(256, bool)
        for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
            self.inside[low:high] = True

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the words with one space between, start and end of each in there, word offset of every row)."""
        body, offsets = flat(column)
        body = self.fold[body]
        inside = np.concatenate([[False], self.inside[body], [False]])
        cut = np.zeros(len(body) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        lengths = ends - starts
        text = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        first = np.cumsum(lengths + 1) - lengths - 1
        text[runs(first, lengths)] = body[runs(starts, lengths)]
        return text, first, first + lengths, np.searchsorted(starts, offsets)


def grams(words: Words, column, orders: int, buckets: int) -> tuple[GramTable, np.ndarray, np.ndarray, np.ndarray]:
    """(table, row of every n-gram, words per row, n-grams per row)."""
    text, starts, ends, offsets = words(column)
    counts = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    first, last, of = [], [], []
    for order in range(1, orders + 1):
        whole = np.flatnonzero(row[order - 1 :] == row[: len(row) - order + 1]) if order > 1 else np.arange(len(row))
        first.append(starts[whole])
        last.append(ends[whole + order - 1])
        of.append(row[whole])
    row = np.concatenate(of)
    table = GramTable(text, np.concatenate(first), np.concatenate(last), buckets)
    return table, row, counts, np.bincount(row, minlength=len(counts))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS, text: str = "text") -> np.ndarray:
    """n-grams of a whole table per bucket: an array of ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                table, *_ = grams(words, some["text"], orders, buckets)
                np.add.at(total, table.bucket, table.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = parts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(SCALE * ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of every bucket, in doubles."""
    size = len(corpus)
    all_corpus, all_target = float(corpus.sum() + size), float(target.sum() + size)
    ratio = ((float(t + 1) * all_corpus) / (float(s + 1) * all_target) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_features, weight)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gain = Words(), shared.value
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                table, row, n_words, n = grams(words, some["text"], orders, len(gain))
                of_slot = gain[table.bucket]
                total = np.zeros(len(n), np.int64)
                np.add.at(total, row, of_slot[table.slots])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [some["key"], pa.array(n_words), pa.array(n), pa.array(weight)], names=["key", "n_words", "n_features", "weight"]
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(weigh, f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    return out.withColumnRenamed("key", key)


def gumbel(key: str, seed: int = SEED):
    """Scaled, floored Gumbel noise from the first 32 bits of sha256 of ``<seed>:<key>``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-float(SCALE) * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    orders: int = ORDERS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, n_words, n_features, weight, score, rank)`` of every row; the rank is null for rows that are not drawn.

    Drawn are ``percent`` of the rows with at least ``least_words`` words, those with the highest scores, ties to the smaller key.
    """
    gain = gains(bucket_counts(docs, buckets, orders, text), bucket_counts(target, buckets, orders, text))
    rows = weights(docs, gain, orders, key, text).withColumn("score", F.col("weight") + gumbel(key, seed))
    rows = stored(rows, "resample-scores")
    eligible = rows.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    ranked = with_ordinal(eligible.withColumn("__down", -F.col("score")), ["__down", key], "rank").drop("__down")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def query(spark, folder: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 by its bit-wise rule (polynomial 0xEDB88320), once per distinct word.
SQL = r"""
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(0, 256)) AS i))
), doc_words AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), item_words AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), doc_word AS (SELECT r, unnest(words) AS word FROM doc_words),
item_word AS (SELECT unnest(words) AS word FROM item_words),
vocabulary AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(encode(word))) // 2),
               lambda j: 16 * (strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * j + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * j + 2, 1)) - 1)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT word FROM doc_word UNION SELECT word FROM item_word), crc_table
), corpus AS (SELECT bucket, count(*) AS s FROM doc_word JOIN vocabulary USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM item_word JOIN vocabulary USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN corpus USING (bucket) LEFT JOIN target USING (bucket), totals
), weighed AS (
    SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
    FROM doc_word JOIN vocabulary USING (word) JOIN gain USING (bucket) GROUP BY r
), noise AS (
    SELECT r, doc_id, len(words) AS n_words, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9),
               lambda j: strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), j, 1)) - 1)), lambda a, d: 16 * a + d) AS h
    FROM doc_words
), scored AS (
    SELECT r, doc_id, n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM noise LEFT JOIN weighed USING (r)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
           count(*) FILTER (n_words >= 20) OVER () AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""
