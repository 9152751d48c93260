"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike (lower case, every run of other signs than letters and
numbers is one space). An item of m characters may differ from a passage by ``k = floor(RATE * m)`` edits; it is
split into k + 1 pieces, of which one at least must then occur unchanged. One Aho-Corasick pass over a
whole text finds all piece hits; each hit fixes a window around the item's place, and Myers'
bit-parallel algorithm gives the least edit distance of the item to a part of the window. Every
hit is verified; nothing is capped.

The documents are mapped where they lie: no shuffle, whatever passage they share. The items are fetched in blocks of
at most about ``BLOCK_BYTES`` (their size is summed first); a larger benchmark takes several blocks, one
after the other in the same tasks.

Defined cases: a null or empty text, or one without letters and numbers, has no match, and an item
like that matches nothing; items of fewer than 1 / RATE characters must occur exactly, in the query and the
stage as whole words (`yes` is not found in `eyes`); of equally near passages the first is reported; a text of any length is searched
whole, in one pass; repeated items and repeated documents are
reported each; other columns pass through unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.labelled import kept_rows
from quillvec.llm.textops import freed, process_cache

RATE = 0.06
BLOCK_BYTES = 32 << 20
LEAKS = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 nearly equal pieces."""
    parts = int(rate * len(item)) + 1
    cuts = [len(item) * j // parts for j in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, end of the first such substring)."""
    m = len(pattern)
    where: dict[str, int] = {}
    for j, sign in enumerate(pattern):
        where[sign] = where.get(sign, 0) | 1 << j
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, sign in enumerate(text):
        equal = where.get(sign, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more = down | (~(across | up) & mask)
        less = up & across
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more, less = more << 1 & mask, less << 1 & mask
        up = less | (~(vertical | more) & mask)
        down = more & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """The pieces of a block of items as one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, whole_words: bool = False) -> None:
        import ahocorasick

        self.items, self.rate, self.whole_words = items, rate, whole_words
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            if item:
                for offset, piece in pieces(item, rate):
                    found.setdefault(piece, []).append((number, offset + len(piece)))
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        self.ready = bool(found)
        if self.ready:
            self.automaton.make_automaton()

    @staticmethod
    def bordered(text: str, start: int, end: int) -> bool:
        return (not start or text[start - 1] == " ") and (end == len(text) or text[end] == " ")

    def __call__(self, text: str) -> list[dict]:
        """The best match of every item within its budget, as far as there is one."""
        if not self.ready or not text:
            return []
        windows: dict[int, list[int]] = {}
        for at, places in self.automaton.iter(text):
            for number, ends in places:
                windows.setdefault(number, []).append(at + 1 - ends)
        out = []
        for number, starts in windows.items():
            name, item = self.items[number]
            budget = int(self.rate * len(item))
            if self.whole_words and not budget:
                starts = [s for s in starts if self.bordered(text, s, s + len(item))]
                if not starts:
                    continue
            best = None
            # hits that lie within the budget of each other share a window
            starts.sort()
            low = high = starts[0]
            groups = []
            for start in starts[1:]:
                if start - high > budget:
                    groups.append((low, high))
                    low = start
                high = start
            groups.append((low, high))
            for low, high in groups:
                begin = max(0, low - budget)
                window = text[begin : high + len(item) + budget]
                distance, end = myers(item, window)
                if distance <= budget and (best is None or distance < best["distance"]):
                    back = myers(item[::-1], window[:end][::-1])[1]
                    best = {"item_id": name, "distance": distance, "start": begin + end - back, "end": begin + end}
            if best:
                out.append(best)
        return out


def find(
    docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, whole_words: bool = False
) -> DataFrame:
    """``docs`` with ``leaks``: the items (``item_id``, ``text``) found in a text, the edit distance and
    the place of the passage in the normalised text. Null item ids stay null. With ``whole_words`` an item
    that must occur exactly has a blank or an end of the text on both sides."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), normalised(F.col("text")).alias("t"))
    total = wanted.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    blocks = -(-total // block_bytes) or 1
    key = uuid.uuid4().hex
    rows = docs.drop("leaks", "__norm").withColumn("__norm", normalised(F.col("text")))
    base = StructType([f for f in docs.schema.fields if f.name not in ("leaks", "__norm")])
    for block in range(blocks):
        mine = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("t", "item_id"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(sorted(((r[0], r[1]) for r in mine.collect()), key=lambda r: (r[1], r[0] or 0)))
        schema = StructType([*rows.schema.fields[: len(base) + 1], *StructType.fromDDL(f"leaks {LEAKS}").fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch], held=held, arrow=arrow, number=block) -> Iterator[pa.RecordBatch]:
            finder = process_cache(f"finder_{number}", key, lambda: Finder(held.value, rate, whole_words))
            for batch in batches:
                for row in range(0, batch.num_rows, 1000):
                    part = batch.slice(row, 1000)
                    before = part.column("leaks").to_pylist() if "leaks" in part.schema.names else [[]] * part.num_rows
                    found = [a + finder(t) for a, t in zip(before, part.column("__norm").to_pylist())]
                    columns = [part.column(n) for n in arrow.names[:-1]] + [pa.array(found, arrow.field("leaks").type)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        rows = rows.mapInArrow(freed(run), schema)
    return rows.drop("__norm")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), whole_words=True)
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", "leak.item_id", "leak.distance", "leak.start", "leak.end")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, with their own columns."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept_rows(docs, {"leaks", "__norm"}, lambda rows: find(rows, items, whole_words=True).where(F.size("leaks") == 0))
