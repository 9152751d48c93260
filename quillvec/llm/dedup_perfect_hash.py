"""Exact duplicates by a minimal perfect hash over the digests seen so far.

The index holds every distinct digest once. It is cut into parts by a hash of the digest, each part a perfect hash
without gaps: level after level, a digest takes the bit it has for itself in a bit array, digests that share one go
on to the next level, and the rank of its bit is its slot. A slot holds the full digest, the number of rows
and the winner (its id and its place in the stored rows), so a lookup compares all 32 bytes before it believes a slot.

A batch is grouped by digest first (counts combine before the shuffle, so a text that a third of all rows share is one row
per task), then looked up part by part: members change their slot, nonmembers have been grouped by themselves and become the next
generation of their part. At last every row is looked up in the finished index; a part with many rows is cut into slices of
``SLICE_ROWS``, each with a copy of the part's shard, so a hot digest is spread over tasks and no task holds more than a slice and one part.

Texts are equal when their bytes are, as SHA-256 tells them apart; nothing is normalised. Of equal texts the row with the
largest id stays.

Defined cases: a null text counts as empty; a null id is smaller than any other, and the id that stays is null if all are;
of rows equal in id and text exactly one has ``kept``; an empty table gives an empty index and result; columns besides id and
text are ignored by the lookup and carried by ``deduplicate``, whatever their names. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.textops import mix
from quillvec.session import stored

#: Distinct digests per part of the index, and rows per slice of a lookup.
PART_DIGESTS = 1 << 15
SLICE_ROWS = 1 << 15
#: Bits per digest that is still without a slot, and levels before the few left over are kept as a sorted list.
SPARE, LEVELS = 2.0, 24

SHARD = (
    "part int, generation int, sizes array<int>, bits binary, rest binary, digests binary, "
    "counts array<bigint>, keys array<bigint>, places array<bigint>"
)
GROUP = "digest binary, n bigint, key bigint, place bigint"


class PerfectHash:
    """Distinct 32-byte digests to slots 0..n-1. ``sizes`` and ``bits`` are the levels, ``rest`` the digests beyond them."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        sizes, arrays, left = [], [], np.arange(len(digests))
        words = digests.view("<u8")
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(SPARE * len(left)))
            at = cls._places(words[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            left = left[~alone[at]]
        rest = np.sort(_whole(digests[left]))
        return cls(np.array(sizes, np.int32), np.concatenate(arrays) if arrays else np.zeros(0, bool), rest)

    @staticmethod
    def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(words[:, level % 4] + salt) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot each digest has if it is a member; -1 or any slot if it is none."""
        words, found, left = digests.view("<u8"), np.full(len(digests), -1), np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            at = self._places(words[left], level, int(size)) + self.starts[level]
            here = self.bits[at]
            found[left[here]] = self.rank[at[here]]
            left = left[~here]
        if len(self.rest) and len(left):
            sought = _whole(digests[left])
            at = np.minimum(np.searchsorted(self.rest, sought), len(self.rest) - 1)
            here = self.rest[at] == sought
            found[left[here]] = int(self.bits.sum()) + at[here]
        return found


def _whole(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("S32").ravel() if len(digests) else np.zeros(0, "S32")


def _digests(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), 32)


class Shard:
    """One part of one generation: the perfect hash and its slots."""

    def __init__(self, hash_: PerfectHash, digests: np.ndarray, counts, keys, keyed, places):
        self.hash, self.digests, self.counts, self.keys, self.keyed, self.places = hash_, digests, counts, keys, keyed, places

    @classmethod
    def of(cls, digests: np.ndarray, counts, keys, keyed, places) -> Shard:
        hash_ = PerfectHash.of(digests)
        order = np.argsort(hash_.slots(digests))
        return cls(hash_, digests[order], counts[order], keys[order], keyed[order], places[order])

    @classmethod
    def read(cls, row: dict) -> Shard:
        sizes = np.array(row["sizes"], np.int32)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        keyed = np.array([k is not None for k in row["keys"]], bool)
        keys = np.array([k or 0 for k in row["keys"]], np.int64)
        rest = np.frombuffer(row["rest"], "S32")
        return cls(PerfectHash(sizes, bits, rest), digests, np.array(row["counts"], np.int64), keys, keyed, np.array(row["places"], np.int64))

    def row(self, part: int, generation: int) -> dict:
        return {
            "part": part,
            "generation": generation,
            "sizes": self.hash.sizes.tolist(),
            "bits": np.packbits(self.hash.bits).tobytes(),
            "rest": self.hash.rest.tobytes(),
            "digests": self.digests.tobytes(),
            "counts": self.counts.tolist(),
            "keys": [k if has else None for k, has in zip(self.keys.tolist(), self.keyed.tolist())],
            "places": self.places.tolist(),
        }

    def members(self, digests: np.ndarray) -> np.ndarray:
        """Slot of every digest, -1 where the slot holds other bytes."""
        slots = self.hash.slots(digests)
        some = np.flatnonzero(slots >= 0)
        same = (self.digests[slots[some]] == digests[some]).all(axis=1)
        slots[some[~same]] = -1
        return slots


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(place, key, digest)`` of every row, written once; ``place`` names the row from then on."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.unhex(F.sha2(body, 256)).alias("digest"))
    return stored(rows.withColumn("place", F.monotonically_increasing_id()), "digests")


def groups(rows: DataFrame) -> DataFrame:
    """``(digest, n, key, place)``: rows per digest and the winner, the row with the largest id. Written once."""
    winner = F.coalesce(F.max_by("place", "key"), F.max("place"))
    made = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("key"), winner.alias("place"))
    return stored(made, "digest-groups")


def with_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.crc32("digest"), F.lit(parts)).cast("int"))


class Index:
    """The stored shards of all generations, dealt into ``parts``; ``size`` distinct digests."""

    def __init__(self, shards: DataFrame, parts: int, size: int):
        self.shards, self.parts, self.size = shards, parts, size

    def entries(self) -> DataFrame:
        """The slots as rows ``(digest, n, key, place)``."""

        def unpack(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    one = Shard.read(row)
                    keys = pa.array(one.keys, mask=~one.keyed)
                    digests = pa.array([d.tobytes() for d in one.digests], pa.binary())
                    yield pa.RecordBatch.from_arrays([digests, pa.array(one.counts), keys, pa.array(one.places)], names=["digest", "n", "key", "place"])

        return self.shards.mapInArrow(unpack, GROUP)


def _columns(table: pa.Table):
    keyed = table["key"].is_valid().to_numpy()
    keys = table["key"].fill_null(0).to_numpy()
    return _digests(table["digest"]), table["n"].to_numpy(), keys, keyed, table["place"].to_numpy()


def _typed(rows: list[dict]) -> pa.Table:
    kinds = {"part": pa.int32(), "generation": pa.int32(), "sizes": pa.list_(pa.int32())}
    kinds |= {name: pa.binary() for name in ("bits", "rest", "digests")}
    kinds |= {name: pa.list_(pa.int64()) for name in ("counts", "keys", "places")}
    return pa.Table.from_pylist(rows, schema=pa.schema(kinds))


def _absorb(key, batch: pa.Table, held: pa.Table) -> pa.Table:
    """The shards of one part after a batch of grouped digests: refreshed slots, and a new generation of nonmembers."""
    shards = {row["generation"]: Shard.read(row) for row in held.to_pylist()}
    digests, counts, keys, keyed, places = _columns(batch)
    left = np.arange(len(digests))
    for shard in shards.values():
        slots = shard.members(digests[left])
        mine, at = left[slots >= 0], slots[slots >= 0]
        shard.counts[at] += counts[mine]
        better = keyed[mine] & (~shard.keyed[at] | (keys[mine] > shard.keys[at]))
        mine, at = mine[better], at[better]
        shard.keys[at], shard.keyed[at], shard.places[at] = keys[mine], True, places[mine]
        left = left[slots < 0]
    if len(left):
        fresh = Shard.of(digests[left], counts[left], keys[left], keyed[left], places[left])
        shards[max(shards, default=-1) + 1] = fresh
    return _typed([shard.row(key[0].as_py(), generation) for generation, shard in shards.items()])


def empty_index(spark, expected: int) -> Index:
    """An index for about ``expected`` distinct digests; it is dealt anew if many more come."""
    return Index(spark.createDataFrame([], SHARD), max(1, -(-expected // PART_DIGESTS)), 0)


def absorb(index: Index, batch: DataFrame) -> Index:
    """The index with a batch of ``groups`` looked up and added."""
    size = index.size + batch.count()  # at least as many as there are digests
    if size > 2 * index.parts * PART_DIGESTS:
        wider = empty_index(batch.sparkSession, size)
        index = absorb(wider, stored(index.entries(), "digest-groups")) if index.size else wider
    dealt = with_part(batch, index.parts).groupBy("part").cogroup(index.shards.groupBy("part"))
    shards = stored(dealt.applyInArrow(_absorb, SHARD), "digest-index")
    held = shards.agg(F.sum(F.size("counts"))).first()[0]
    return Index(shards, index.parts, held or 0)


def resolve(rows: DataFrame, index: Index) -> DataFrame:
    """``(place, key, digest, keep, group_size, kept)`` of every row, from its slot.

    A row whose digest is in no slot has null in the last three.
    """
    dealt = with_part(rows, index.parts)
    sizes = stored(dealt.groupBy("part").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices")), "digest-slices")
    sliced = dealt.join(sizes, "part").withColumn("slice", F.pmod(F.xxhash64("place"), F.col("slices")).cast("int"))
    copies = index.shards.join(sizes, "part").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def look_up(some: pa.Table, held: pa.Table) -> pa.Table:
        digests = _digests(some["digest"])
        n, keep = np.zeros(len(digests), np.int64), np.zeros(len(digests), np.int64)
        keyed, winner = np.zeros(len(digests), bool), np.full(len(digests), -1, np.int64)
        for row in held.to_pylist():
            shard = Shard.read(row)
            slots = shard.members(digests)
            here, at = np.flatnonzero(slots >= 0), slots[slots >= 0]
            n[here], keep[here], keyed[here], winner[here] = shard.counts[at], shard.keys[at], shard.keyed[at], shard.places[at]
        unknown = n == 0
        kept = pa.array(winner == some["place"].to_numpy(), mask=unknown)
        columns = [some["place"], some["key"], some["digest"], pa.array(keep, mask=~keyed), pa.array(n, mask=unknown), kept]
        return pa.table(columns, names=["place", "key", "digest", "keep", "group_size", "kept"])

    left = sliced.select("part", "slice", "place", "key", "digest").groupBy("part", "slice")
    right = copies.drop("slices").groupBy("part", "slice")
    schema = "place bigint, key bigint, digest binary, keep bigint, group_size bigint, kept boolean"
    return left.cogroup(right).applyInArrow(look_up, schema)


def find(docs: DataFrame, history=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(place, key, digest, keep, group_size, kept)`` of every row of ``docs``.

    The rows where the condition ``history`` holds (on ``key``; default: none) are indexed first, the others looked up as
    the next batch. It only decides in which order rows come, not what is equal.
    """
    rows = digest_rows(docs, key, text)
    old = F.coalesce(F.lit(False) if history is None else history, F.lit(False))
    batches = [groups(rows.where(old)), groups(rows.where(~old))]
    index = empty_index(docs.sparkSession, sum(batch.count() for batch in batches))
    for batch in batches:
        index = absorb(index, batch)
    return resolve(rows, index)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The table is written once, to name its rows."""
    place = "__place"
    while place in docs.columns:
        place += "_"
    held = stored(docs.withColumn(place, F.monotonically_increasing_id()), "dedup-rows")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = held.select(F.col(key).cast("bigint").alias("key"), F.unhex(F.sha2(body, 256)).alias("digest"), F.col(place).alias("place"))
    made = groups(rows)
    index = absorb(empty_index(docs.sparkSession, made.count()), made)
    stay = resolve(rows, index).where("kept").select(F.col("place").alias(place))
    return held.join(stay, place, "left_semi").select(*docs.columns)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    half = F.crc32(F.col("key").cast("string").cast("binary")) % 2 == 0
    return find(docs, half).select(
        F.col("key").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
