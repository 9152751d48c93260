"""The posting table of the hyperplane search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.operators import lsh

BITS, TABLES, DIM = 4, 3, 12


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(500, DIM)).astype(np.float32)
    points[:170] = points[0]  # a third of all rows in one bucket of every table
    vectors = spark.createDataFrame(pa.table({"vec_id": range(500), "embedding": list(points)})).repartition(4)
    asked = spark.createDataFrame(pa.table({"query_id": range(9), "qv": list(rng.normal(size=(9, DIM)))}))
    planes = lsh.hyperplanes(spark, DIM, TABLES, BITS)
    path = str(tmp_path_factory.mktemp("postings") / "p")
    return vectors, asked, planes, lsh.lsh_postings(vectors, planes, BITS, path, folders=24)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("limits", [{}, {"block_bytes": 300, "pass_bytes": 900}])
def test_postings_answer_as_the_scan_does(made, metric, limits):
    vectors, asked, planes, postings = made
    want = lsh.lsh_search(asked, lsh.lsh_assign(vectors, planes, BITS), planes, BITS, 10, metric)
    got = lsh.posting_search(asked, postings, planes, 10, metric, **limits)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fewer_probes_read_fewer_files(made):
    _, asked, planes, postings = made
    assert postings.rows.count() == 500 * TABLES
    files = lambda rows: rows.select(F.col("_metadata.file_path")).distinct().count()
    read = [files(postings.probed(lsh.posting_probes(asked, postings, planes, tables))) for tables in (1, 2, 3)]
    one = files(postings.probed(lsh.posting_probes(asked.where("query_id = 4"), postings, planes, 1)))
    assert one < read[0] < read[1] < read[2] < files(postings.rows)
    plan = postings.probed(lsh.posting_probes(asked, postings, planes, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan


def test_recall_grows_with_the_tables(made):
    vectors, asked, planes, postings = made
    found = [lsh.posting_search(asked, postings, planes, 10, tables=t).agg(F.sum("score")).first()[0] or 0.0 for t in (1, 3)]
    assert found[0] < found[1]


def test_postings_of_nothing(spark, made, tmp_path):
    vectors, asked, planes, postings = made
    assert lsh.posting_search(asked.limit(0), postings, planes).count() == 0
    none = lsh.lsh_postings(vectors.limit(0), planes, BITS, str(tmp_path / "p"))
    assert lsh.posting_search(asked, none, planes).count() == 0
