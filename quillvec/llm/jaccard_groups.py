"""N-gram Jaccard join by a token-group matrix, with the components of its links.

Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text give a set of five-word shingles per document, as 64-bit
hashes; two documents link when the Jaccard similarity of their sets reaches ``PERCENT``. Equal sets are
one class, decided by a 64-bit key of the set. The rest works on classes, and finds every link:

1. *Postings.* Shingles are ordered by a fixed rule, those that many documents share last. Linked sets of n and m shingles have at
   least min(l(n), l(m)) common shingles among the first n - ceil(0.75 n) + l(n) of either (``prefix``, ``slack``).
   Only these are shuffled, packed by shingle hash. A block of documents sends a shingle once however
   many of its documents hold it, so a frequent shingle costs one entry per block. Shingles of one class only are dropped, and with them
   every class that has fewer than the least number of shared ones.
2. *Groups.* Classes that agree in a min-hash are compared with the smallest class among them; the components of
   these links are groups. The classes left alone form families by their most frequent min-hash, linked or not, so that near
   copies below the bar are not thousands of groups. A group is cut into cells of about ``CELL`` shingles.
3. *Token-group matrix.* A cell stands for the union of its members' postings. Two cells with too few common
   shingles are passed over. Of the others the smaller travels, as packed sets, to the larger: there the cell's union bounds the overlap
   of each class once more, and only for classes that still qualify the cell is opened and overlaps are counted. A task gives
   only links that connect something new; members of one component are never paired.

Every comparison is exact, on whole texts. Links and components stay DataFrames.

Rows are told apart by numbers. These are given once, and written with ids and texts to the shared folder; every pass reads
that table. So the input may come in other partitions or another order whenever it is read.

Defined cases: a text with fewer than five words has its whole word sequence as its one shingle; a null text or one
without words has no shingle and links with nothing; repeated ids and rows without id are documents of their own (a component's id is
its smallest id that is not null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.textops import Words, freed, mix, powers, slices
from quillvec.session import durable, stored

WIDTH = 5
PERCENT = 75
SLACK = 12  # one extra prefix shingle for so many of the set
MINHASHES = 6
CELL = 50_000  # shingles of the sets of a cell, on average at most
PARTNERS = 64
FREQUENT_BITS = 21
FREQUENT_IN_BLOCK = 2
BROADCAST_BYTES = 64 << 20
BLOCK_POSTINGS = 500_000
BUCKET_POSTINGS = 2_000_000
SLICE = 2 << 20


# -- sets ------------------------------------------------------------------------------------


class Shingler:
    """The shingle sets of a column's texts."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.words = width, Words()
        self.power = powers(width + 1)

    def __call__(self, column) -> Iterator[np.ndarray]:
        """A sorted array of distinct hashes for each row."""
        hashes, offsets = self.words.hashes(column)
        width = self.width
        rolling = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for j in range(width):
            rolling += hashes[j : j + len(rolling)] * self.power[j]
        rolling = mix(rolling)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolling[a : b - width + 1])
            elif b > a:
                short = (hashes[a:b] * self.power[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64) ^ np.uint64(0x5DEECE66D))
            else:
                yield np.zeros(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def least_common(n, percent: int = PERCENT):
    """The least overlap of a set of ``n`` with any set it links with."""
    return -(-percent * n // 100)


def slack(n):
    return -(-n // SLACK)


def prefix(n, percent: int = PERCENT):
    return n - least_common(n, percent) + slack(n)


def least_shared(n, percent: int = PERCENT):
    """Prefix shingles that a set of ``n`` shares with any set it links with, at least."""
    return slack(least_common(n, percent))


def class_of(shingles: np.ndarray) -> int:
    """The class key of a set: a hash of its sorted elements."""
    total = (mix(shingles) * (shingles | np.uint64(1))).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


# -- packed numbers --------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes; small ones cost few bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


# -- pass 1: one row per document, and frequent shingles ---------------------------------------

_PROFILE = "row bigint, id bigint, n int, class bigint, frequent binary, counts binary"


def _profiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, block, seen = Shingler(width), [], set()
        size = 0

        def frequent() -> tuple[bytes | None, bytes | None]:
            if not block:
                return None, None
            values, counts = np.unique(np.concatenate(block), return_counts=True)
            often = counts >= FREQUENT_IN_BLOCK
            return _pack(values[often]), _pack(counts[often])

        def batch_of(rows, ids, ns, classes, a, b) -> pa.RecordBatch:
            columns = zip((rows, ids, ns, classes, a, b), ("row", "id", "n", "class", "frequent", "counts"))
            kinds = {"n": pa.int32(), "frequent": pa.binary(), "counts": pa.binary()}
            arrays = [(name, pa.array(values, kinds.get(name, pa.int64()))) for values, name in columns]
            return pa.RecordBatch.from_arrays([v for _, v in arrays], names=[name for name, _ in arrays])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ns, classes = [], []
                for shingles in shingler(part.column("text")):
                    ns.append(len(shingles))
                    classes.append(class_of(shingles) if len(shingles) else None)
                    if len(shingles) and classes[-1] not in seen:
                        seen.add(classes[-1])
                        block.append(shingles)
                        size += len(shingles)
                rows = part.num_rows
                yield batch_of(
                    part.column("row").to_pylist(), part.column("id").to_pylist(), ns, classes, [None] * rows, [None] * rows
                )
                if size > 4 * BLOCK_POSTINGS:
                    a, b = frequent()
                    yield batch_of([None], [None], [None], [None], [a], [b])
                    block, seen, size = [], set(), 0
        if block:
            a, b = frequent()
            yield batch_of([None], [None], [None], [None], [a], [b])

    return run


def _frequent_table(profiles: DataFrame, bits: int) -> np.ndarray:
    """Level (about log2 of the documents counted) of shingles by the low bits of their hash.

    Of fixed size whatever the data: it only orders shingles, any collision is harmless.
    """
    pieces = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for values, counts in zip(*(batch.column(c).to_pylist() for c in ("frequent", "counts"))):
                np.add.at(total, (_unpack(values) & np.uint64((1 << bits) - 1)).astype(np.int64), _unpack(counts).astype(np.int64))
        parts = total.reshape(pieces, -1)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "n": pa.array([_pack(p) for p in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist()):
                totals[piece] = totals.get(piece, 0) + _unpack(n)
        if totals:
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(list(totals), pa.int32()), "n": pa.array([_pack(x) for x in totals.values()], pa.binary())}
            )

    rows = profiles.where(F.col("frequent").isNotNull()).select("frequent", "counts")
    sums = rows.mapInArrow(freed(count), "piece int, n binary").repartition(pieces, "piece").mapInArrow(freed(add), "piece int, n binary").collect()
    table = np.zeros(1 << bits, np.uint8)
    for row in sums:
        part = _unpack(row["n"]).astype(np.float64)
        table[row["piece"] * len(part) : (row["piece"] + 1) * len(part)] = np.ceil(np.log2(part + 1))
    return table


# -- pass 2: postings --------------------------------------------------------------------------

_PACKED = "bucket int, tokens binary, docs binary, places binary, classes binary, sizes binary, many binary"
_POSTING = "token bigint, class bigint, n int, pos int"


def _postings(width: int, percent: int, buckets: int, levels):
    def pack(tokens: np.ndarray, docs: np.ndarray, places: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per bucket with the first document of every shingle, and flags for those of several
        classes; then the other documents of these."""
        order = np.lexsort((docs, tokens))
        tokens, docs, places = tokens[order], docs[order], places[order]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        start = np.flatnonzero(first)
        many = np.diff(np.append(start, len(tokens))) > 1
        bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
        rest = np.flatnonzero(~first)
        rows = []
        for at, flags in ((start, many), (rest, np.ones(len(rest), bool))):
            if not len(at):
                continue
            by = np.argsort(bucket[at], kind="stable")
            at, flags = at[by], flags[by]
            edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                mine = at[edges[b] : edges[b + 1]]
                used, local = np.unique(docs[mine], return_inverse=True)
                deltas = np.diff(tokens[mine], prepend=np.uint64(0))  # ascending, or equal
                rows.append(
                    (b, _pack(deltas), _pack(local), _pack(places[mine]), classes[used].astype("<i8").tobytes(), sizes[used].astype("<i4").tobytes(),
                     np.packbits(flags[edges[b] : edges[b + 1]]).tobytes())
                )
        for k in range(0, len(rows), 16):
            columns = list(zip(*rows[k : k + 16]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=[x.split()[0] for x in _PACKED.split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level = Shingler(width), levels.value
        low = np.uint64(len(level) - 1)
        tokens, docs, places, classes, sizes, seen, held = [], [], [], [], [], set(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for shingles in shingler(part.column("text")):
                    n = len(shingles)
                    if n < 2:
                        continue  # links with equal sets only
                    name = class_of(shingles)
                    if name in seen:
                        continue
                    seen.add(name)
                    # hashes ascend already, so a stable sort by level gives (level, hash)
                    chosen = shingles[np.argsort(level[shingles & low], kind="stable")[: prefix(n, percent)]]
                    tokens.append(chosen)
                    docs.append(np.full(len(chosen), len(classes), np.int32))
                    places.append(np.arange(len(chosen)))
                    classes.append(name)
                    sizes.append(n)
                    held += len(chosen)
                    if held >= BLOCK_POSTINGS:
                        yield from pack(*map(np.concatenate, (tokens, docs, places)), np.array(classes), np.array(sizes))
                        tokens, docs, places, classes, sizes, seen, held = [], [], [], [], [], set(), 0
        if held:
            yield from pack(*map(np.concatenate, (tokens, docs, places)), np.array(classes), np.array(sizes))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of shingles that several classes hold, bucket by bucket."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        tokens, classes, sizes, places, many = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((classes, tokens))
        tokens, classes, sizes, places, many = (x[order] for x in (tokens, classes, sizes, places, many))
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        fresh = new.copy()
        fresh[1:] |= classes[1:] != classes[:-1]
        group = np.cumsum(new) - 1
        several = (np.bincount(group, weights=fresh) > 1) | (np.bincount(group, weights=many) > 0)
        use = np.flatnonzero(fresh & several[group])
        for k in range(0, len(use), 1 << 16):
            at = use[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[at].view(np.int64)), pa.array(classes[at]), pa.array(sizes[at], pa.int32()), pa.array(places[at], pa.int32())],
                names=["token", "class", "n", "pos"],
            )

    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                yield from close(held)
                bucket, held = row["bucket"], []
            tokens, local = np.cumsum(_unpack(row["tokens"]), dtype=np.uint64), _unpack(row["docs"]).astype(np.int64)
            classes, sizes = np.frombuffer(row["classes"], "<i8"), np.frombuffer(row["sizes"], "<i4")
            many = np.unpackbits(np.frombuffer(row["many"], np.uint8), count=len(tokens)).astype(bool)
            held.append((tokens, classes[local], sizes[local], _unpack(row["places"]).astype(np.int32), many))
    yield from close(held)


# -- comparing, components ---------------------------------------------------------------------


def compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part in slices(batch, "ta", SLICE):
                left, right = shingler(part.column("ta")), shingler(part.column("tb"))
                keep = pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
                yield part.select(["a", "b"]).filter(keep)

    one = texts.select(F.col("class").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(freed(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``links (a, b)``; ``comp`` is the smallest node reached.

    Each round takes the smallest label among the neighbours, then the label's own label, which halves the
    distances; every round is checkpointed.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        near = labels.join(least, "node").select("node", F.col("comp").alias("before"), F.least("comp", "other").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = near.join(jump, "comp", "left").select("node", "before", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        moved = durable(moved)
        labels = moved.select("node", "comp")
        if moved.where(F.col("before") != F.col("comp")).isEmpty():
            return labels


# -- the operator ------------------------------------------------------------------------------


def classes_and_links(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(``row, id, n, class`` of every document, ``node, comp`` of the classes with links or None) of stored ``row, id, text``."""
    spark = rows.sparkSession
    profiles = stored(rows.mapInArrow(freed(_profiles(width)), _PROFILE), "jaccard-profiles")
    documents = profiles.where(F.col("row").isNotNull()).select("row", "id", "n", "class")
    prefixes = F.expr(f"n - ({percent} * n + 99) div 100 + (n + {SLACK - 1}) div {SLACK}")
    total = documents.agg(F.sum(prefixes)).collect()[0][0] or 0
    if total == 0:
        return documents, None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * partitions, -(-total // BUCKET_POSTINGS))
    levels = spark.sparkContext.broadcast(_frequent_table(profiles, FREQUENT_BITS))

    packed = rows.select("text").mapInArrow(freed(_postings(width, percent, buckets, levels)), _PACKED)
    shared = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(freed(_shared), _POSTING)
    shared = shared.groupBy("class", "token").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    need = f"(({percent} * n + 99) div 100 + {SLACK - 1}) div {SLACK}"
    shared = stored(shared, "jaccard-shared")
    alive = shared.groupBy("class").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(f"shared >= {need}")
    alive = durable(alive.select("class", "n"))
    living = alive.count()
    if living == 0:
        return documents, None
    posts = shared.join(alive.select("class"), "class")

    # One text for each class that may link. The places, 24 bytes a class, travel to the texts if they are few,
    # else both are shuffled.
    first = documents.where("n > 1").groupBy("class").agg(F.min("row").alias("row")).join(alive, "class")
    first = F.broadcast(durable(first)) if 24 * living <= BROADCAST_BYTES else first
    texts = rows.select("row", "text").join(first, "row").select("class", "n", "text")
    texts = stored(texts.mapInArrow(freed(_with_minhashes(width)), "class bigint, n int, text string, minhash array<bigint>"), "jaccard-texts")

    # Groups: links with the smallest class of the same min-hash. Classes that stay alone form families with those that
    # share their most frequent min-hash, whether or not they link.
    keyed = texts.select("class", F.posexplode("minhash").alias("j", "h"))
    pivots = keyed.groupBy("j", "h").agg(F.min("class").alias("a"), F.count("*").alias("members")).where("members > 1")
    met = durable(keyed.join(pivots, ["j", "h"]).select("class", "a", "members"))
    stars = met.where("a < class").select("a", F.col("class").alias("b")).distinct()
    found = durable(compare(stars, texts, width, percent))
    groups = None if found.isEmpty() else components(found)
    family = met.groupBy("class").agg(F.max_by("a", F.struct("members", "a")).alias("family"))
    homes = texts.select("class", "n").join(family, "class", "left")
    if groups is not None:
        homes = homes.join(groups.withColumnRenamed("node", "class"), "class", "left")
    else:
        homes = homes.withColumn("comp", F.lit(None).cast("bigint"))
    homes = homes.select("class", "n", F.col("comp").isNull().alias("lone"), F.coalesce("comp", "family", "class").alias("family"))
    weights = homes.groupBy("family", "lone").agg((F.sum("n") / F.lit(CELL)).cast("int").alias("cuts"))
    homes = homes.join(weights, ["family", "lone"])
    cell = F.concat_ws(":", "family", F.col("lone").cast("string"), F.pmod(F.xxhash64("class"), F.col("cuts") + 1))
    homes = durable(homes.select("class", "family", "lone", cell.alias("cell")))

    cells = texts.select("class", "text").join(homes, "class").select("cell", "lone", "class", "text")
    cells = cells.repartition("cell").sortWithinPartitions("cell", "class").mapInArrow(freed(_cells(width)), _CELL)
    cells = stored(cells, "jaccard-cells")
    pairs = durable(_qualifying(posts.join(homes, "class"), percent))
    more = durable(_open(pairs, cells, percent))
    if more.isEmpty():
        return documents, groups
    if groups is not None:
        more = more.union(groups.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")))
    return documents, components(more)


# -- token-group matrix ------------------------------------------------------------------------

_CELL = "cell string, lone boolean, total bigint, classes binary, sizes binary, tokens binary"


def _cells(width: int):
    """One row per cell, of rows sorted by cell: classes, set sizes and the sorted sets one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, name, lone, classes, sets = Shingler(width), None, None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not classes:
                return
            sizes = np.array([len(s) for s in sets], "<i8")
            columns = [name], [lone], [int(sizes.sum())], [np.array(classes, "<i8").tobytes()], [sizes.tobytes()]
            kinds = pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays.append(pa.array([np.concatenate(sets).astype("<u8").tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _CELL.split(", ")])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys = (part.column(c).to_pylist() for c in ("cell", "lone", "class"))
                for one, alone, each, shingles in zip(*keys, shingler(part.column("text"))):
                    if one != name:
                        yield from close()
                        name, lone, classes, sets = one, alone, [], []
                    classes.append(each)
                    sets.append(shingles)
        yield from close()

    return run


def _qualifying(posts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` of cells that may hold a link, from ``token, n, pos, family, lone, cell`` of their classes.

    Linked sets of n and m shingles have an overlap of o or more, so the first n - o + l of one and m - o + l of the other
    have l common ones: a shingle further back need not be met. Sets of a cell have several sizes; the bounds take the
    most favourable ones, and two places more for rounding.
    """
    matrix = posts.groupBy("token", "cell", "lone", "family").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("first"), F.count("*").alias("members")
    )
    several = matrix.groupBy("token").agg(F.count("*").alias("c"), F.max(F.expr("lone AND members > 1")).alias("own")).where("c > 1 OR own")
    matrix = stored(matrix.join(several.select("token"), "token"), "jaccard-matrix")

    def near(a: str, b: str) -> str:
        n, m = f"{a}.high", f"greatest({b}.low, ({percent} * {a}.high + 99) div 100)"
        o = f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"
        spare = f"if({a}.low = {a}.high AND {b}.low = {b}.high, 0, 2)"
        return f"{a}.first < {n} - {o} + (least({n}, {m}) + {SLACK - 1}) div {SLACK} + {spare}"

    met = matrix.alias("p").join(matrix.alias("q"), F.expr("p.token = q.token")).where(
        "(p.cell < q.cell AND (p.lone OR q.lone OR p.family <> q.family) OR p.cell = q.cell AND p.lone AND p.members > 1) "
        f"AND 100 * p.high >= {percent} * q.low AND 100 * q.high >= {percent} * p.low AND {near('p', 'q')} AND {near('q', 'p')}"
    )
    overlap = met.groupBy(F.col("p.cell").alias("x"), F.col("q.cell").alias("y")).agg(
        F.count("*").alias("c"), F.min("p.low").alias("n1"), F.min("q.low").alias("n2")
    )
    return overlap.where(f"c >= (least(n1, n2) + {SLACK - 1}) div {SLACK}").select("x", "y")


def _open(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes of the cells ``x`` and ``y``; those that join nothing new within a task are left out.

    The smaller cell of a pair travels to the larger one. A cell with many partners is opened by several tasks.
    """
    size = cells.select("cell", "total")
    sized = pairs.join(size.toDF("x", "sx"), "x").join(size.toDF("y", "sy"), "y")
    sized = sized.select(F.expr("if(sx >= sy, x, y)").alias("x"), F.expr("if(sx >= sy, y, x)").alias("y"))
    many = sized.groupBy("x").agg((F.count("*") / F.lit(PARTNERS)).cast("int").alias("cuts"))
    sized = durable(sized.join(many, "x").select("x", F.pmod(F.xxhash64("y"), F.col("cuts") + 1).alias("part"), "y"))
    fields = ["lone", "classes", "sizes", "tokens"]
    body = cells.select("cell", *fields)
    heads = sized.select("x", "part").distinct().join(body.withColumnRenamed("cell", "x"), "x").select("x", "part", F.lit("").alias("y"), *fields)
    visits = sized.where("x <> y").join(body.withColumnRenamed("cell", "y"), "y").select("x", "part", "y", *fields)
    own = sized.where("x = y").select("x", "part", "y", *(F.lit(None).cast(body.schema[f].dataType).alias(f) for f in fields))
    rows = heads.unionByName(visits).unionByName(own).repartition("x", "part").sortWithinPartitions("x", "part", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if row["y"] == "":
                    held = Cell(row, percent)
                else:
                    for one, two in held.links(row if row["classes"] is not None else None):
                        a.append(min(one, two))
                        b.append(max(one, two))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(freed(run), "a bigint, b bigint").distinct()


class Cell:
    """The sets of a cell as holders of each distinct shingle, and which of its classes are known to be connected."""

    def __init__(self, row: dict, percent: int = PERCENT) -> None:
        self.percent = percent
        self.classes, self.sizes, self.sets = self.read(row)
        owners = np.repeat(np.arange(len(self.classes)), self.sizes)
        order = np.argsort(self.sets, kind="stable")
        self.owners = owners[order]
        self.tokens, self.starts = np.unique(self.sets[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(self.sets)))
        self.labels = np.arange(len(self.classes)) if row["lone"] else np.zeros(len(self.classes), np.int64)

    @staticmethod
    def read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["classes"], "<i8"), np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["tokens"], "<u8")

    def near(self, shingles: np.ndarray) -> np.ndarray:
        """The members that link with a set. The cell's union bounds the overlap: most sets go no further."""
        n = len(shingles)
        at = np.searchsorted(self.tokens, shingles)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == shingles]
        if len(at) < least_common(n, self.percent):
            return np.zeros(0, np.int64)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + counts, counts)
        common = np.bincount(self.owners[places], minlength=len(self.classes))
        return np.flatnonzero(100 * common >= self.percent * (n + self.sizes - common))

    def links(self, other: dict | None) -> Iterator[tuple[int, int]]:
        """Links with the classes of another cell, or within this one; they connect all that all links connect."""
        classes, sizes, sets = (self.classes, self.sizes, self.sets) if other is None else self.read(other)
        joined: set[int] = set()  # labels connected with the other cell, if that is one component
        edges = np.append(0, np.cumsum(sizes))
        for k in range(len(classes)):
            found = self.near(sets[edges[k] : edges[k + 1]])
            if other is None:
                found = found[self.labels[found] != self.labels[k]]
            if not len(found):
                continue
            labels, first = np.unique(self.labels[found], return_index=True)
            if other is not None and not other["lone"]:
                fresh = [j for label, j in zip(labels.tolist(), first.tolist()) if label not in joined]
                joined.update(labels.tolist())
            else:
                fresh = first.tolist()
            for j in fresh:
                yield int(classes[k]), int(self.classes[found[j]])
            to = self.labels[k] if other is None else labels[0]
            self.labels[np.isin(self.labels, labels)] = to
            if joined & set(labels.tolist()):
                joined.add(int(to))


def _with_minhashes(width: int):
    salts = mix(np.arange(101, 101 + MINHASHES, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lows = [[int(mix(s ^ salt).min().view(np.int64)) for salt in salts] for s in shingler(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), part.column("n"), part.column("text"), pa.array(lows, pa.list_(pa.int64()))],
                    names=["class", "n", "text", "minhash"],
                )

    return run


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``(row, key, n_shingles, component_id)``; ``row`` is a number of the document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return components_of(stored(rows, "jaccard-rows"), key, width, percent)


def components_of(rows: DataFrame, key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``link_components`` of rows that are stored as ``row, id, text``."""
    documents, comps = classes_and_links(rows, width, percent)
    if comps is None:
        named = documents.withColumn("comp", F.col("class"))
    else:
        named = documents.join(comps.withColumnRenamed("node", "class"), "class", "left")
        named = named.withColumn("comp", F.coalesce("comp", "class"))
    smallest = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"))
    out = named.join(smallest, "comp", "left")
    return out.select(
        "row", F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "comp"
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return link_components(docs).select("doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest id (and row number), and all without shingles."""
    place = "__row"
    while place in map(str.lower, docs.columns):
        place += "_"
    rows = stored(docs.withColumn(place, F.monotonically_increasing_id()), "jaccard-rows")
    found = components_of(rows.select(F.col(place).alias("row"), F.col("doc_id").cast("bigint").alias("id"), "text"))
    best = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    dropped = found.where("comp IS NOT NULL").join(best, "comp").where(F.col("row") != F.col("best.row")).select("row")
    return rows.join(dropped.withColumnRenamed("row", place), place, "left_anti").select(*docs.columns)
