import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.functions.vector import euclidean, inner_product
from quillvec.operators import ivf, lsh
from quillvec.operators.blockscan import BlockTopK, exact_keys, rank_hits, unusable_vectors
from quillvec.operators.recall import recall_at_k
from quillvec.operators.search import argsort_head, distance_row, k_sweep, knn

DIM = 16


def frame(spark, ids, matrix, key, value):
    kind = pa.float32() if matrix.dtype == np.float32 else pa.float64()
    return spark.createDataFrame(pa.table({key: pa.array(ids, pa.int64()), value: pa.array(list(matrix), pa.list_(kind))}))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((600, DIM)) * rng.integers(1, 5, (600, 1))).astype(np.float32)
    base[400:600] = base[7]  # a third of all rows are copies: equal scores everywhere
    queries = rng.standard_normal((12, DIM))
    queries[0] = base[3]
    vectors = frame(spark, np.arange(600), base, "vec_id", "embedding").repartition(5)
    return base, queries, vectors, frame(spark, np.arange(12) + 100, queries, "query_id", "qv")


def keys_of(query, base, metric):
    n = len(base)
    return exact_keys(query[None, :].astype(np.float64), np.zeros(n, int), base, np.arange(n), metric)


def brute(base, queries, k, metric, allowed=None):
    out = {}
    for q in range(len(queries)):
        key = keys_of(queries[q], base, metric)
        ids = np.lexsort((np.arange(len(base)), -key))
        ids = [i for i in ids if allowed is None or i in allowed[q]]
        for rank, i in enumerate(ids[:k], 1):
            out[q + 100, rank] = (int(i), float(key[i] if metric == "ip" else -key[i]))
    return out


def answers(hits):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize(
    "limits", [{}, {"block_bytes": 8 * DIM * 3}, {"block_bytes": 8 * DIM * 3, "pass_bytes": 8 * DIM * 6}]
)
def test_knn_is_exact_with_ties(data, metric, limits):
    base, queries, vectors, q = data
    assert answers(knn(q, vectors, 20, metric, **limits)) == brute(base, queries, 20, metric)


@pytest.mark.parametrize("metric,expr", [("ip", inner_product), ("l2", euclidean)])
def test_scores_equal_native_expression_bit_for_bit(data, metric, expr):
    _, _, vectors, q = data
    hits = knn(q, vectors, 30, metric).join(q, "query_id").join(vectors, "vec_id")
    assert hits.filter(F.col("score") != expr(F.col("qv"), F.col("embedding"))).count() == 0


def test_fewer_vectors_than_k_and_unusable_vectors(spark, data):
    _, _, _, q = data
    rows = [(1, [1.0] * DIM), (2, [1.0] * (DIM - 1)), (3, None), (4, [float("nan")] + [0.0] * (DIM - 1)), (5, [0.0] * DIM)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    hits = knn(q, vectors, 10, on_unusable="skip")
    assert {r.vec_id for r in hits.collect()} == {1, 5}
    assert hits.count() == 24
    with pytest.raises(Exception, match="finite components"):
        knn(q, vectors, 10).count()
    rejects = {r.vec_id: r.reason for r in unusable_vectors(vectors, DIM).collect()}
    assert rejects == {2: f"{DIM - 1} components", 3: "null", 4: "component not finite"}
    centroids = vectors.filter("vec_id = 1").selectExpr("0 AS cell", "cast(embedding AS array<double>) AS c")
    with pytest.raises(Exception, match="finite components"):
        ivf.ivf_assign(vectors, centroids).count()
    assert ivf.ivf_assign(vectors, centroids, "skip").filter("cell IS NULL").count() == 3


def test_queries_of_several_lengths_are_an_error(spark, data):
    _, _, vectors, q = data
    mixed = q.unionByName(q.select(F.lit(7).cast("bigint").alias("query_id"), F.slice("qv", 1, 3).alias("qv")))
    with pytest.raises(ValueError, match="components"):
        knn(mixed, vectors, 5)


def test_no_exchange_carries_vectors(data):
    _, _, vectors, q = data
    plan = knn(q, vectors, 5, block_bytes=8 * DIM * 3, pass_bytes=1)._jdf.queryExecution().optimizedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Repartition" in line or "Join" in line]
    assert plan.count("MapInArrow") == 4 and not [line for line in shuffled if "Repartition" not in line]


def test_many_cells_in_blocks(spark, data):
    base, _, vectors, _ = data
    centroids = frame(spark, np.arange(40), np.concatenate([base[:20], base[:20]]).astype(np.float64), "cell", "c")
    one = {r.vec_id: r.cell for r in ivf.ivf_assign(vectors, centroids).collect()}
    assert {r.vec_id: r.cell for r in ivf.ivf_assign(vectors, centroids, block_bytes=8 * DIM * 7).collect()} == one


def test_huge_values_do_not_overflow_selection():
    base = np.full((5, 4), 1e30, dtype=np.float32) * np.arange(1, 6, dtype=np.float32)[:, None]
    best = BlockTopK(np.array([0]), np.full((1, 4), 1e20), 2, "ip")
    best.add(np.arange(5), base)
    assert best.best_id.tolist() == [4, 3]


def test_no_queries(spark, data):
    _, _, vectors, q = data
    assert knn(q.filter("query_id < 0"), vectors, 5).count() == 0


def test_distance_row_and_argsort(data):
    base, queries, vectors, _ = data
    row = distance_row(F.lit(queries[2].tolist()).cast("array<double>"), vectors)
    assert row.count() == len(base)
    plan = argsort_head(row, 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    want = brute(base, queries, 7, "l2")
    assert [(r.vec_id, r.distance) for r in argsort_head(row, 7).collect()] == [want[102, i] for i in range(1, 8)]


def test_salted_ranking_keeps_the_same_rows(spark, data):
    _, _, vectors, q = data
    partial = knn(q, vectors, 200).select("query_id", "vec_id", "score").unionByName(
        knn(q, vectors, 300).filter("rank > 200").select("query_id", "vec_id", "score")
    )
    for metric in ("ip", "l2"):
        plain = rank_hits(partial, 25, metric, fan=1)
        assert answers(rank_hits(partial, 25, metric, fan=4)) == answers(plain)


def test_k_sweep(data):
    _, _, vectors, q = data
    sizes = {r.k: r["count"] for r in k_sweep(knn(q, vectors, 100)).groupBy("k").count().collect()}
    assert sizes == {1: 12, 10: 120, 100: 1200}


def test_broadcast_plan_has_no_cross_join(data):
    _, _, vectors, q = data
    plan = knn(q, vectors, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def cells(spark, data):
    base, _, vectors, _ = data
    centroids = frame(spark, np.arange(5), base[:5].astype(np.float64), "cell", "c")
    return centroids, ivf.ivf_assign(vectors, centroids)


def test_ivf_assign_takes_best_centroid_lowest_on_ties(spark, data):
    base, _, vectors, _ = data
    twice = np.concatenate([base[:4], base[:4]]).astype(np.float64)
    centroids = frame(spark, np.arange(8), twice, "cell", "c")
    got = {r.vec_id: r.cell for r in ivf.ivf_assign(vectors, centroids).collect()}
    for i in range(len(base)):
        keys = keys_of(base[i], twice, "ip")
        assert got[i] == keys.argmax()


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 8 * DIM * 3}])
@pytest.mark.parametrize("nprobe", [1, 3, 5])
def test_ivf_search_equals_brute_force_inside_cells(data, cells, nprobe, limits):
    base, queries, _, q = data
    centroids, index = cells
    member = {r.vec_id: r.cell for r in index.collect()}
    visit = [np.lexsort((np.arange(5), -keys_of(queries[i], base[:5], "ip")))[:nprobe] for i in range(12)]
    allowed = [{v for v, c in member.items() if c in visit[i]} for i in range(12)]
    got = answers(ivf.ivf_search(q, index, centroids, 15, nprobe, **limits))
    assert got == brute(base, queries, 15, "ip", allowed)


def test_ivf_recall_grows_with_nprobe_to_one(data, cells):
    _, _, vectors, q = data
    centroids, index = cells
    exact = knn(q, vectors, 10)
    recalls = []
    for nprobe in (1, 3, 5):
        approx = ivf.ivf_search(q, index, centroids, 10, nprobe)
        recalls.append({r.k: r.recall for r in recall_at_k(approx, exact, (1, 10)).collect()})
    assert recalls[0][10] <= recalls[1][10] <= recalls[2][10]
    assert recalls[2] == {1: 1.0, 10: 1.0}


def test_ivf_train(data):
    _, _, vectors, _ = data
    assert [ivf.cell_count(n) for n in (5, 60, 10**6)] == [1, 2, 100]
    centroids = ivf.ivf_train(vectors, seed=1)
    rows = centroids.orderBy("cell").collect()
    assert [r.cell for r in rows] == list(range(len(rows))) and 1 <= len(rows) <= 20
    assert all(len(r.c) == DIM for r in rows)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 8 * DIM * 3}])
def test_lsh_search_equals_brute_force_inside_buckets(spark, data, limits):
    base, queries, vectors, q = data
    bits, tables = 4, 3
    planes = lsh.hyperplanes(spark, DIM, tables, bits, seed=5)
    h = np.array([r.h for r in planes.orderBy("plane").collect()])
    vc, qc = lsh.bucket_codes(base, h, bits), lsh.bucket_codes(queries, h, bits)
    allowed = [set(np.flatnonzero((vc == qc[i]).any(axis=1)).tolist()) for i in range(12)]
    index = lsh.lsh_assign(vectors, planes, bits)
    got = answers(lsh.lsh_search(q, index, planes, bits, 10, **limits))
    assert got == brute(base, queries, 10, "ip", allowed)


def test_lsh_bucket_limit(spark):
    with pytest.raises(ValueError):
        lsh.hyperplanes(spark, 4, tables=64, bits=20)
