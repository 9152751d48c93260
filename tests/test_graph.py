"""Neighbour graphs against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.operators import graph
from quillvec.operators.ivf import ivf_assign, ivf_search
from quillvec.operators.recall import recall_at_k
from quillvec.operators.search import knn

VECTORS = "vec_id bigint, embedding array<double>"
QUERIES = "query_id bigint, qv array<double>"


def some(spark, n=400, dim=8, queries=30, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)).astype(np.float32) * (1 + rng.integers(0, 4, size=(n, 1)))
    points[:copies] = points[0]
    rows = [(i, v.tolist()) for i, v in enumerate(points.astype(float))]
    asked = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(queries, dim)))]
    return spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(asked, QUERIES)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("copies", [0, 150])
def test_graph_of_full_width_is_exact(spark, tmp_path, metric, copies):
    vectors, asked = some(spark, copies=copies)
    index = graph.graph_build(vectors, str(tmp_path / "g"), metric, shard_rows=128)
    walked = graph.graph_walk(asked, index, 10, ef=400, metric=metric)
    assert sorted(graph.graph_search(walked, 10, metric).collect()) == sorted(knn(asked, vectors, 10, metric).collect())
    assert {r.visited for r in graph.visits(walked).collect()} == {400}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_graph_finds_most_and_compares_few(spark, tmp_path, metric):
    vectors, asked = some(spark, n=3000)
    index = graph.graph_build(vectors, str(tmp_path / "g"), metric)
    walked = graph.graph_walk(asked, index, 10, ef=50, metric=metric)
    found = recall_at_k(graph.graph_search(walked, 10, metric), knn(asked, vectors, 10, metric), [10]).first()
    assert found.recall >= 0.95 and found.n_queries == 30
    assert all(50 <= r.visited < 900 for r in graph.visits(walked).collect())


def test_graph_reads_only_probed_cells(spark, tmp_path):
    vectors, asked = some(spark)
    cells = spark.createDataFrame([(c, [1.0 if c == j else 0.0 for j in range(8)]) for c in range(8)], "cell int, c array<double>")
    index = graph.graph_build(vectors, str(tmp_path / "g"), centroids=cells, shard_rows=32)
    assert index.count() > 8 and index.agg(F.max(F.size("ids"))).first()[0] < 80
    one = asked.where("query_id = 3")
    walked = graph.graph_walk(one, index, 5, ef=400, centroids=cells, nprobe=1)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (=|IN)", plan), plan
    want = ivf_search(one, ivf_assign(vectors, cells), cells, 5, 1)
    assert sorted(graph.graph_search(walked, 5).collect()) == sorted(want.collect())
    blocks = graph.graph_walk(asked, index, 5, ef=400, centroids=cells, nprobe=8, block_bytes=500, pass_bytes=1500)
    assert sorted(graph.graph_search(blocks, 5).collect()) == sorted(knn(asked, vectors, 5).collect())


def test_graph_of_awkward_vectors(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0])]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], QUERIES)
    with pytest.raises(Exception, match="finite components"):
        graph.graph_build(vectors, str(tmp_path / "bad"))
    index = graph.graph_build(vectors, str(tmp_path / "g"), on_unusable="skip")
    got = graph.graph_search(graph.graph_walk(asked, index, 10), 10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 1.0), (1, 0.0), (2, 0.0)]
    assert graph.graph_walk(asked.limit(0), index).count() == 0
    alone = graph.graph_build(vectors.where("vec_id = 1"), str(tmp_path / "one"), "l2")
    assert graph.graph_search(graph.graph_walk(asked, alone, 10, metric="l2"), 10, "l2").count() == 1
    none = graph.graph_build(vectors.limit(0), str(tmp_path / "none"))
    assert graph.graph_search(graph.graph_walk(asked, none), 10).count() == 0


def test_every_part_of_a_graph_has_an_entry():
    rng = np.random.default_rng(2)
    values = np.repeat(rng.normal(size=(40, 4)), 50, axis=0).astype(np.float32)
    edges, entries = graph.neighbour_graph(values, "l2", 4, 12)
    best, visited = graph.walk(values[:1], values, edges, entries, 2000, "l2")
    assert len(entries) > 1 and visited[0] == 2000 and sorted(best[0]) == list(range(2000))
