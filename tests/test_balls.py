"""Ball search against the full scan, and its pruning."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.operators import balls
from quillvec.operators.search import knn

VECTORS = "vec_id bigint, embedding array<double>"
QUERIES = "query_id bigint, qv array<double>"


def clustered(spark, n=600, dim=6, seed=3):
    """Five far apart clusters; a third of all vectors are copies of one, and queries lie in and outside the clusters."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)) + 30.0 * rng.integers(0, 5, size=(n, 1)) * np.eye(dim)[0]
    points[: n // 3] = points[0]
    asked = np.vstack([points[[0, n - 1, n - 2]], rng.normal(size=(4, dim)) * 60])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], VECTORS).repartition(4)
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], QUERIES)


def built(vectors, path, nlist=5, rows=40):
    return balls.ball_build(vectors, balls.ball_train(vectors, nlist, seed=2), str(path), ball_rows=rows)


@pytest.mark.parametrize("k,limits", [(1, {}), (10, {"first": 2}), (10, {"block_bytes": 150, "pass_bytes": 300}), (700, {})])
def test_balls_equal_the_full_scan(spark, tmp_path, k, limits):
    vectors, asked = clustered(spark)
    index, table = built(vectors, tmp_path / "b")
    got = balls.ball_search(asked, index, table, k, **limits)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn(asked, vectors, k, "l2").collect()))


def test_radii_hold_and_shells_cut_large_cells(spark, tmp_path):
    vectors, _ = clustered(spark)
    index, table = built(vectors, tmp_path / "b", nlist=2)
    rows = {r.ball: r for r in table.collect()}
    assert sum(r.n for r in rows.values()) == 600 and len(rows) > 2
    for r in index.collect():
        far = float(np.sqrt(((np.array(r.embedding) - rows[r.ball].c) ** 2).sum()))
        assert rows[r.ball].inner - 1e-9 <= far <= rows[r.ball].outer + 1e-9


def test_far_balls_are_left_out(spark, tmp_path):
    vectors, asked = clustered(spark)
    index, table = built(vectors, tmp_path / "b")
    visits = balls.ball_visits(asked.where("query_id < 3"), index, table, 5)
    assert all(r.visited < 400 for r in visits.rows().collect())
    plan = balls._scan(asked, visits.balls.where("query_id = 1"), index, 5, {})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ball#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_bounds_never_exclude_a_holder():
    rng = np.random.default_rng(5)
    for scale in (1e-6, 1.0, 1e6):
        points, centre = scale * rng.normal(size=(50, 4)), 100 * scale * rng.normal(size=4)
        far = np.sqrt(((points - centre) ** 2).sum(axis=1))
        row = pa.RecordBatch.from_pydict({"c": [centre.tolist()], "inner": [far.min()], "outer": [far.max()]})
        queries = scale * rng.normal(size=(30, 4))
        nearest = np.sqrt(((queries[:, None] - points) ** 2).sum(axis=2)).min(axis=1)
        assert balls.may_hold(queries, nearest, row).all()
        assert not balls.may_hold(queries, (np.sqrt(((queries - centre) ** 2).sum(axis=1)) - far.max()).clip(0) * 0.99, row).all()


def test_bounds_are_computed_for_some_queries_at_a_time():
    rng = np.random.default_rng(7)
    queries, centres = np.hstack([rng.normal(size=(6000, 4)), np.full((6000, 1), 0.5)]), rng.normal(size=(300, 4))
    radius = np.full(300, 0.3)
    table = pa.RecordBatch.from_pydict({"ball": np.arange(300, dtype=np.int32), "c": centres.tolist(), "inner": 0 * radius, "outer": radius, "n": np.arange(300)})
    ids = 10 * np.arange(6000)
    tracemalloc.start()
    got = set()
    for batch in balls._holders([(ids[:5500], queries[:5500]), (ids[5500:], queries[5500:])], table):
        got.update(zip(batch["query_id"].to_pylist(), batch["ball"].to_pylist(), batch["n"].to_pylist()))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    for _ in balls._holders([(ids, queries)], table):
        pass
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    flags = balls.may_hold(queries[:, :-1], queries[:, -1], table)
    assert got == {(10 * q, b, b) for q, b in np.argwhere(flags).tolist()}
    assert peak < 40 << 20  # all queries at once: a dozen arrays of 12 MB


def test_balls_of_nothing(spark, tmp_path):
    vectors, asked = clustered(spark, n=30)
    index, table = built(vectors, tmp_path / "b", nlist=2)
    assert balls.ball_search(asked.limit(0), index, table, 3).count() == 0
    few = balls.ball_search(asked, index, table, 50)
    assert few.groupBy("query_id").count().agg(F.min("count"), F.max("count")).first() == (30, 30)
