"""Sharding, nearest neighbours, the Jaccard join and the pipeline against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillvec.llm import ann_pstable as ann
from quillvec.llm import jaccard_groups as jaccard
from quillvec.llm import shard_interleave as sharding

FOLDER = "/root/testdata/sf0.01"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# -- sharding ------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i % 50}", "en", "hot" if i % 3 == 0 else None if i % 10 == 1 else f"s{i % 7}", 1) for i in range(1003)]
    docs = spark.createDataFrame(rows, DOCUMENT).withColumn("shard", F.lit("clash"))
    got = sharding.interleave(docs, shards=16, carry=("text",)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1003))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    totals = Counter(r.source for r in got)
    for (source, shard), n in Counter((r.source, r.shard) for r in got).items():
        assert abs(n - totals[source] / 16) <= 3, (source, shard)
    assert all(r.size == len(r.text.encode()) + 1 and r.text_crc32 == crc32(r.text.encode()) for r in got)


def test_shards_equal_a_plain_interleaving(spark):
    rows = [(i, f"é{i}", "en", f"s{i * i % 5}", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("bigint")))
    by_source = {}
    for i, s, h in hashed.collect():
        by_source.setdefault(s, []).append((h, i))
    line = sorted(((2 * r + 1) / (2 * len(v)), "=" + s, h, i) for s, v in by_source.items() for r, (h, i) in enumerate(sorted(v)))
    want = {i: (p * 16 // 200, p) for p, (*_, i) in enumerate(line)}
    starts = {s: -(-s * 200 // 16) for s in range(16)}
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs).collect()}
    assert got == {i: (s, p - starts[s]) for i, (s, p) in want.items()}


def test_shards_of_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 50000, "en", "", 1)]
    got = sharding.interleave(spark.createDataFrame(rows, DOCUMENT), shards=3).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 50001] and Counter(r.shard for r in got) == {0: 2, 1: 1, 2: 1}
    assert sharding.interleave(spark.createDataFrame([], DOCUMENT)).count() == 0


# -- nearest neighbours --------------------------------------------------------------------


def brute_nearest(queries, vectors, k):
    out = {}
    for q, x in queries:
        rows = sorted((float(np.sqrt(((x - y) ** 2).sum())), v) for v, y in vectors if v != q and len(y) == len(x))
        out[q] = rows[:k]
    return out


def test_recall_of_the_registered_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = [(r[0], np.array(r[1], float)) for r in rows]
    want = brute_nearest([v for v in vectors if v[0] % 100 == 0], vectors, 10)
    got = {}
    for r in ann.query(spark, FOLDER).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    recall = np.mean([len({v for _, v in want[q]} & {v for _, v in got[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    for hits in got.values():
        assert hits == sorted(hits) and len(hits) == 10


def test_few_probes_still_give_k_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = brute_nearest([(i, np.array(v)) for i, v in rows if i % 20 == 0], [(i, np.array(v)) for i, v in rows], 5)
    sparse = ann.search(queries, table, k=5, tables=1, hashes=6, probes=1, width=0.05).collect()
    for q in want:
        hits = sorted((r for r in sparse if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in hits] == [v for _, v in want[q]]
        assert [r.score for r in hits] == pytest.approx([d for d, _ in want[q]])
    whole, blocks = (sorted(map(tuple, ann.search(queries, table, k=5, block_bytes=b).collect())) for b in (1 << 25, 40000))
    assert whole == blocks


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [
        (100, [0.0, 0.0]), (101, None), (102, [nan, 1.0]), (103, [1.0, None]), (104, [inf, 1.0]), (105, []), (None, [1.0, 1.0]), (106, [1.0, 2.0, 3.0]), (107, [5.0, 5.0]), (7, [1.0, 0.0])
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    queries = table.where("vec_id IN (0, 100, 101, 102, 106, 107)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted(map(tuple, ann.search(queries, table, k=10).select("query_id", "rank", "vec_id", "score").collect()))
    assert [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert [r[2] for r in got if r[0] == 107] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    assert {r[0] for r in got} == {0, 107}
    assert ann.search(queries.limit(0), table).count() == 0 and ann.search(queries, table.limit(0)).count() == 0


# -- Jaccard join --------------------------------------------------------------------------


def brute_components(rows):
    """[(id, shingles, component id)] in row order, from all pairs."""
    fold = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    ids = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            ids[find(k)] = min(ids.get(find(k), name), name)
    return [(name, len(sets[k]), ids.get(find(k))) for k, (name, _) in enumerate(rows)]


def near_copies(seed, base_words=60, families=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for family in range(families):
        base = [rng.choice(vocabulary) for _ in range(base_words + family)]
        for _ in range(rng.randint(1, 25)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            if rng.random() < 0.4:
                words += passage
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_POSTINGS", 300)  # several blocks per task
    monkeypatch.setattr(jaccard, "MINHASHES", 1 if seed == 1 else 6)  # links left for the matrix
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5, "doc_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("cell, partners", [(50_000, 64), (600, 2)])
def test_lone_near_copies_round_a_large_group(spark, monkeypatch, cell, partners):
    """Documents that share two thirds of their shingles with a group, and with each other, without linking."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = [" ".join(base[:-1] + [f"end{k}"]) for k in range(70)]
    for k in range(120):
        at = rng.randrange(40)
        rows.append(" ".join(base[at:] + [f"own{k}_{j}" for j in range(rng.choice((8, 22, 24)) - at // 4)]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4, "doc_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect())
    want = sorted(brute_components(rows))
    assert got == want
    assert 20 < sum(name == component for name, _, component in want) < 150


def test_cells_emit_links_that_connect_all_links():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))

    def sets(n):
        return [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 62, 4).astype(np.uint64)])) for _ in range(n)]

    def row(lone, first, members):
        sizes = np.array([len(s) for s in members], "<i8")
        names = np.arange(first, first + len(members), dtype="<i8")
        return {"lone": lone, "classes": names.tobytes(), "sizes": sizes.tobytes(), "tokens": np.concatenate(members).tobytes()}

    def roots(n, edges):
        parent = list(range(n))
        for a, b in edges:
            old, to = parent[a], parent[b]
            parent = [to if p == old else p for p in parent]
        return [parent.index(p) for p in parent]

    for lone in ((True, True), (True, False), (False, True), (False, False)):
        mine, theirs = sets(30), sets(25)
        every = mine + theirs
        known = [(0, k) for k in range(30)] * (not lone[0]) + [(30, 30 + k) for k in range(25)] * (not lone[1])
        cell = jaccard.Cell(row(lone[0], 0, mine))
        got = list(cell.links(None)) * lone[0] + list(cell.links(row(lone[1], 30, theirs)))
        assert all(jaccard.linked(every[a], every[b]) for a, b in got) and len(got) <= 2 * 55
        links = [(a, b) for a in range(55) for b in range(a) if jaccard.linked(every[a], every[b]) and (b < 30 <= a or lone[0] and a < 30)]
        assert roots(55, known + got) == roots(55, known + links)


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, n // 8).astype(np.uint64)]))
        if jaccard.linked(a, b):
            both = np.intersect1d(a[: jaccard.prefix(len(a))], b[: jaccard.prefix(len(b))])
            assert len(both) >= min(jaccard.slack(len(a)), jaccard.slack(len(b))) >= jaccard.least_shared(max(len(a), len(b))) - 1
            assert len(both) >= max(jaccard.least_shared(len(a)), jaccard.least_shared(len(b))) or len(both) >= min(
                jaccard.least_shared(len(a)), jaccard.least_shared(len(b))
            )


def test_jaccard_awkward_rows(spark):
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "A b  c d e f"), (5, None), (6, ""), (7, " \n"), (8, "x"), (9, "X"), (3, "x y"), (3, "x y"), (10, long), (11, long + "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
    assert jaccard.link_components(docs.limit(0)).count() == 0
    lonely = docs.where("doc_id IN (5, 6, 8)")
    assert {r.component_id for r in jaccard.link_components(lonely).collect()} == {5, 6, 8}


def test_rows_that_move_between_scans(spark):
    def other_order(batches):
        rng = np.random.default_rng()
        for batch in batches:
            yield batch.take(pa.array(rng.permutation(batch.num_rows)))

    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    moving = docs.mapInArrow(other_order, docs.schema)
    want = brute_components(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(moving).collect())
    assert got == sorted(want)
    kept = [(r.doc_id, r.text) for r in jaccard.stage(spark, moving, FOLDER).collect()]
    assert sorted(kept) == sorted((name, text) for (name, text), (_, _, least) in zip(rows, want) if name == least)


def test_components_of_a_long_path(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201)], "a bigint, b bigint")
    got = {r.node: r.comp for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, FOLDER).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        sizes.append(kept.count())
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
            assert all(name == component for name, n, component in brute_components_by_shingle(rows) if n)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = labels.where("toxic = 1")  # a few dozen to learn from in four languages
    assert spark.read.parquet(str(tmp_path / "toxicity")).join(toxic, "doc_id").count() <= 0.25 * toxic.count()
    bench = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for r in kept.select("text").collect():
        text = " ".join(re.findall(r"[^\W_]+", r.text.lower()))
        assert not any(item in text for item in bench)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    same = last.join(kept.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), "doc_id")
    assert same.where("h = decoded_sha256").count() == sizes[-1]


def brute_components_by_shingle(rows):
    """As ``brute_components``, comparing only texts with a common shingle."""
    groups = {}
    for k, (_, text) in enumerate(rows):
        w = (text or "").lower().split()
        for j in range(0, max(1, len(w) - 4)):
            groups.setdefault(tuple(w[j : j + 5]), set()).add(k)
    near = {}
    for members in groups.values():
        if 1 < len(members) < 60:
            for k in members:
                near.setdefault(k, set()).update(members)
    out = []
    for k, (name, _) in enumerate(rows):
        some = sorted(near.get(k, {k}))
        out += [r for r in brute_components([rows[j] for j in some]) if r[0] == name][:1] if k % 10 == 0 else []
    return out


def test_stages_keep_columns_of_any_name(spark):
    names = ["toxic_score", "Lang_Pred", "leaks", "__row", "__norm", "toxic_words"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(row[name] == f"{name}{row.doc_id}" for row in rows for name in names)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
