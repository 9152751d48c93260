"""Two-level cells against plain products."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.operators import quantiser
from quillvec.operators.search import knn

DIM = 6


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(900, DIM))
    points[:300] = points[0]  # one coarse cell holds a third of all rows
    extra = [None if i % 3 else f"x{i}" for i in range(900)]
    vectors = spark.createDataFrame(pa.table({"vec_id": range(900), "embedding": list(points), "coarse": extra})).repartition(5)
    tree = quantiser.quantiser_train(vectors, 80, seed=4)
    fine = {r.cell: (r.coarse, np.array(r.c)) for r in tree.fine.collect()}
    coarse = {r.cell: np.array(r.c) for r in tree.coarse.collect()}
    return points, vectors, tree, coarse, fine


def test_cells_are_numbered_through(made):
    _, _, _, coarse, fine = made
    assert sorted(fine) == list(range(len(fine))) and 40 <= len(fine) <= 90 and len(coarse) == 9
    assert {c for c, _ in fine.values()} <= set(coarse)


@pytest.mark.parametrize("limits", [{}, {"slice_bytes": 8 * DIM * 50}])
def test_each_vector_has_the_best_cell_of_its_coarse_cell(made, limits):
    points, vectors, tree, coarse, fine = made
    rows = quantiser.quantiser_assign(vectors, tree, **limits).collect()
    assert sorted(r.vec_id for r in rows) == list(range(900))
    for r in rows:
        v = points[r.vec_id]
        best = max(coarse, key=lambda c: (float(v @ coarse[c]), -c))
        mine = {c: float(v @ x) for c, (of, x) in fine.items() if of == best}
        assert fine[r.cell][0] == best and mine[r.cell] >= max(mine.values()) - 1e-12
        assert r.coarse == (None if r.vec_id % 3 else f"x{r.vec_id}")


def test_search_of_all_cells_is_exact_and_few_cells_find_most(spark, made):
    _, vectors, tree, coarse, fine = made
    asked = vectors.where("vec_id % 90 = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    index = quantiser.quantiser_assign(vectors.select("vec_id", "embedding"), tree)
    want = sorted(map(tuple, knn(asked, vectors, 10).collect()))
    whole = quantiser.quantiser_search(asked, index, tree, 10, len(fine), len(coarse))
    assert sorted(map(tuple, whole.collect())) == want
    some = quantiser.quantiser_search(asked, index, tree, 10, 20, 4)
    assert len(set(map(tuple, some.select("query_id", "vec_id").collect())) & {(q, v) for q, _, v, _ in want}) >= 0.6 * len(want)


def test_agreement_counts_equal_plain_ones(made):
    points, vectors, tree, _, fine = made
    cells = {r.vec_id: r.cell for r in quantiser.quantiser_assign(vectors, tree).collect()}
    products = points @ np.array([fine[c][1] for c in range(len(fine))]).T
    same = sum(products[i, cells[i]] >= products[i].max() - 1e-12 for i in range(900))
    got = quantiser.agreement(vectors, tree).first()
    assert got.n == 900 and abs(got.agree - same) <= 2 and got.agree > 500


def test_unusable_vectors(spark, made):
    _, _, tree, _, _ = made
    bad = spark.createDataFrame([(1, None), (2, [1.0] * DIM), (3, [float("nan")] * DIM), (4, [0.0] * DIM)], "vec_id bigint, embedding array<double>")
    assert sorted(r.vec_id for r in quantiser.quantiser_assign(bad, tree, "skip").collect()) == [2, 4]
    with pytest.raises(Exception, match="finite components"):
        quantiser.quantiser_assign(bad, tree).collect()
    assert quantiser.quantiser_assign(bad.limit(0), tree).count() == 0
