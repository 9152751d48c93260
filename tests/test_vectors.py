import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.functions.vector import half, to_half
from quillvec.operators.embedding import HashingEncoder, embed, embed_hashing, embedded, rejected
from quillvec.operators.ivf import ivf_assign, ivf_build, ivf_search
from quillvec.operators.verify import corpus_verification, shard_errors, verify_files, verify_shards
from quillvec.sources import vectors as V
from quillvec.streaming.ingest import vector_sink, vector_stream


def test_half_equals_numpy(spark):
    rng = np.random.default_rng(1)
    edge = [0.0, -0.0, 2.0**-24, 2.0**-25, 2.0**-25 * 1.0001, 2.0**-14, 1.0, 65504.0, 65519.0, 65519.999, 65520.0, 1e6, -1e6, math.inf, -math.inf]
    powers = [s * 2.0**e * f for e in range(-26, 17) for f in (1, 1 - 2**-12, 1 + 2**-11, 1 + 3 * 2**-11) for s in (1, -1)]
    values = np.array([*edge, *powers, *rng.standard_normal(5000), *(rng.standard_normal(5000) * 10.0 ** rng.integers(-7, 5, 5000))])
    rows = spark.createDataFrame(pa.table({"i": np.arange(len(values)), "x": values}))
    got = np.array([r.h for r in rows.select("i", half(F.col("x")).alias("h")).orderBy("i").collect()])
    with np.errstate(over="ignore"):
        assert np.array_equal(got, values.astype(np.float16).astype(np.float64))
    nan = spark.createDataFrame([([float("nan"), 1.00048828125],)], "v array<double>").select(to_half(F.col("v")).alias("v")).first().v
    assert math.isnan(nan[0]) and nan[1] == 1.0


def test_random_vectors_do_not_depend_on_partitioning(spark):
    ids = spark.range(300).withColumnRenamed("id", "vec_id")
    first = {(r.vec_id, r.dim): r.embedding for r in V.random_vectors(ids.repartition(7), (8, 16), 5).collect()}
    again = {(r.vec_id, r.dim): r.embedding for r in V.random_vectors(ids.coalesce(1), (8, 16), 5).collect()}
    assert first == again and len(first) == 600
    assert first != {(r.vec_id, r.dim): r.embedding for r in V.random_vectors(ids, (8, 16), 6).collect()}


def test_random_moments_and_independence(spark):
    x = np.array([r.embedding for r in V.random_vector_table(spark, 4000, [32], seed=9).collect()])
    n = x.size
    assert abs(x.mean()) < 5 / n**0.5 and abs(x.std() - 1) < 5 / (2 * n) ** 0.5
    z = (x - x.mean()) / x.std()
    assert abs((z**3).mean()) < 5 * (6 / n) ** 0.5 and abs((z**4).mean() - 3) < 5 * (24 / n) ** 0.5
    correlation = np.corrcoef(x.T) - np.eye(32)
    assert abs(correlation).max() < 5.5 / 4000**0.5
    q = np.array([r.qv for r in V.random_queries(spark, 32, 4000, seed=9).orderBy("query_id").collect()])
    assert abs(np.corrcoef(q.ravel(), x.ravel())[0, 1]) < 5 / n**0.5
    assert not np.array_equal(q, q.astype(np.float16).astype(np.float64))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "vectors")
    V.write_vectors(V.random_vector_table(spark, 1250, (8, 16), seed=1).coalesce(1), path, max_rows=500)
    return path


def test_store_layout_and_scan(spark, stored):
    files = [f for f in os.listdir(f"{stored}/dim=8") if f.endswith(".parquet")]
    assert len(files) == 3
    back = V.read_vectors(spark, stored, 8)
    assert back.count() == 1250 and back.filter(F.size("embedding") != 8).count() == 0
    assert "PartitionFilters: [isnotnull(dim" in back._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        V.read_vectors(spark, stored, 99)


def test_worker_ranges_are_written_apart(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("vec_id"), (F.col("id") / 4).cast("int").alias("worker_id"))
    V.write_vectors(rows, str(tmp_path / "w"), by="worker_id", rebalance=True)
    assert sorted(d for d in os.listdir(tmp_path / "w") if "=" in d) == ["worker_id=0", "worker_id=1", "worker_id=2"]
    assert spark.read.parquet(str(tmp_path / "w")).count() == 10


def test_damaged_files_are_skipped_and_listed(spark, tmp_path):
    path = str(tmp_path / "v")
    V.write_vectors(V.random_vector_table(spark, 100, (8,), seed=1).coalesce(1), path, max_rows=50)
    target = sorted(f for f in os.listdir(f"{path}/dim=8") if f.endswith(".parquet"))[0]
    crc = f"{path}/dim=8/.{target}.crc"
    if os.path.exists(crc):
        os.unlink(crc)
    with open(f"{path}/dim=8/{target}", "wb") as out:
        out.write(b"not parquet at all")
    with pytest.raises(Exception):
        V.read_vectors(spark, path, 8).count()
    assert V.read_vectors(spark, path, 8, skip_unreadable=True).count() == 50
    assert [os.path.basename(r.file) for r in V.unreadable_files(spark, path).collect()] == [target]


def test_a_file_damaged_at_its_end_is_left_out_whole(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in ("good", "bad"):
        os.makedirs(tmp_path / "dim=8", exist_ok=True)
        values = pa.array([[float(i)] * 8 for i in range(2000)], pa.list_(pa.float32()))
        table = pa.table({"vec_id": pa.array(range(2000), pa.int64()), "embedding": values})
        pq.write_table(table, tmp_path / "dim=8" / f"{name}.parquet", row_group_size=250, compression="zstd", use_dictionary=False)
    bad = tmp_path / "dim=8" / "bad.parquet"
    group = pq.read_metadata(bad).row_group(7)
    start = group.column(0).data_page_offset
    data = bytearray(bad.read_bytes())
    data[start : start + 200] = bytes(200)
    bad.write_bytes(bytes(data))
    (row,) = V.unreadable_files(spark, str(tmp_path)).collect()
    assert os.path.basename(row.file) == "bad.parquet" and row.rows == 2000 and row.read < 2000
    assert V.read_vectors(spark, str(tmp_path), 8, skip_unreadable=True).count() == 2000
    with pytest.raises(Exception):
        V.read_vectors(spark, str(tmp_path), 8).select(F.sum("vec_id")).collect()


def test_stack_refuses_a_wrong_length(spark):
    rows = spark.createDataFrame([(1, 2, [1.0, 2.0]), (2, 2, [1.0])], "vec_id bigint, dim int, embedding array<float>")
    assert V.stack([rows.filter("vec_id = 1")]).collect()[0].embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="vector 2 has 1 components"):
        V.stack([rows, rows]).collect()


def test_verify_stored_table(spark, stored):
    rows = V.with_file(spark.read.parquet(stored))
    got = {r.dim: r for r in verify_shards(rows, (8, 16, 32), 1250).collect()}
    assert [got[d].total_vectors for d in (8, 16, 32)] == [1250, 1250, 0]
    assert [got[d].file_count for d in (8, 16, 32)] == [3, 3, 0]
    assert [got[d].mark for d in (8, 16, 32)] == ["✓", "✓", "✗"]
    size = sum(os.path.getsize(f"{stored}/dim=8/{f}") for f in os.listdir(f"{stored}/dim=8") if f.endswith(".parquet"))
    assert got[8].total_size_bytes == size and got[8].total_size == f"{size / 1024:.2f} KB"
    assert got[32].total_size == "0 bytes"
    assert [(r.dim, r.error) for r in shard_errors(rows, (8, 16, 32)).collect()] == [(32, "dimension 32 is missing")]


def test_verify_faults(spark):
    v = [1.0] * 4
    rows = [
        (4, "f1", 10, v, "m"), (4, "f1", 10, v, None),
        (4, "f2", 20, v[:3], "m"),
        (4, "f3", 30, None, "m"),
        (8, "g1", 5, v + v, None),
    ]
    table = spark.createDataFrame(rows, "dim int, file string, file_size bigint, embedding array<float>, metadata string")
    got = {r.dim: tuple(r)[1:5] for r in verify_shards(table, (4, 8), 3).collect()}
    assert got == {4: (3, 2, 30, 2), 8: (1, 1, 5, 0)}
    errors = {r.file: r.error for r in shard_errors(table, (4, 8)).collect()}
    assert errors == {"f2": "dimension is 3, expected 4", "f3": "rows without a vector"}
    files = {r.file: r for r in verify_files(table).collect()}
    assert {f: r.status for f, r in files.items()} == {"f1": "MISMATCH", "f2": "WARN", "f3": "ERROR", "g1": "ERROR"}
    total = corpus_verification(verify_files(table)).first()
    assert tuple(total) == (2, 3, 4, 2, 1, 1)


# -- embedding -----------------------------------------------------------------------------


def words(spark, n, partitions=1):
    rows = spark.range(n, numPartitions=partitions)
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: F.concat(F.lit("w"), i)).alias("tokens"))


def test_every_row_is_embedded_in_full_batches(spark):
    def make():
        def encode(batch):
            return np.full((len(batch), 4), len(batch), dtype=np.float64)

        return encode

    done = embed(words(spark, 25), make, 4, batch_size=10).collect()
    assert sorted(r.id for r in done) == list(range(25))
    assert sorted(r.embedding[0] for r in done) == [5.0] * 5 + [10.0] * 20


def test_batches_fill_across_arrow_blocks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        done = embed(words(spark, 25), lambda: lambda b: np.full((len(b), 1), len(b)), 1, batch_size=10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.embedding[0] for r in done) == [5.0] * 5 + [10.0] * 20 and len({r.id for r in done}) == 25


def test_failed_batch_is_reported_and_the_rest_goes_on(spark):
    def make():
        def encode(batch):
            if len(batch) < 10:
                raise RuntimeError("no room")
            return np.ones((len(batch), 2))

        return encode

    done = embed(words(spark, 25), make, 2, batch_size=10)
    assert embedded(done).count() == 20
    assert {(r.id, r.embed_error) for r in rejected(done).collect()} == {(i, "RuntimeError: no room") for i in range(20, 25)}
    with pytest.raises(Exception, match="no room"):
        embed(words(spark, 25), make, 2, batch_size=10, on_error="fail").collect()
    wrong = embed(words(spark, 3), lambda: lambda b: np.ones((len(b), 3)), 2)
    assert rejected(wrong).count() == 3


def test_vectors_are_half_precision(spark):
    make = lambda: lambda batch: np.full((len(batch), 1), 0.1)
    assert embed(words(spark, 1), make, 1).first().embedding == [float(np.float16(0.1))]
    assert embed(words(spark, 1), make, 1, half=False).first().embedding == [float(np.float32(0.1))]


def test_hashing_encoder(spark):
    same = {tuple(r.embedding) for r in embed(words(spark, 40, 3), HashingEncoder(16), 16).filter("id % 5 = 3").collect()}
    assert len(same) == 1
    matrix = HashingEncoder(16)()([["a", "b", "a"], [], ["b", "a", "a"]])
    assert np.allclose((matrix**2).sum(axis=1), [1, 0, 1]) and np.array_equal(matrix[0], matrix[2])
    native = embed_hashing(words(spark, 5), 32).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in native)


# -- stored cells, streams -----------------------------------------------------------------


def test_stored_cells_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((500, 8)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(500), "embedding": pa.array(list(base), pa.list_(pa.float32()))})
    vectors = spark.createDataFrame(table)
    centers = pa.table({"cell": pa.array(range(6), pa.int32()), "c": pa.array(list(base[:6].astype(float)), pa.list_(pa.float64()))})
    centroids = spark.createDataFrame(centers)
    index = ivf_build(vectors, centroids, str(tmp_path / "cells"))
    assert index.count() == 500
    queries = V.random_queries(spark, 8, 2, seed=1)
    hits = ivf_search(queries, index, centroids, 5, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    fresh = ivf_search(queries, ivf_assign(vectors, centroids), centroids, 5, 2)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, fresh.collect()))


def test_stream_of_files_to_vectors(spark, tmp_path):
    rows = [("r1/a.py", "line\n" * 12), ("r1/.git/x", "line\n" * 12), ("r2/b", "tiny"), ("r2/c", "some text here")]
    files = spark.createDataFrame(rows, "path string, content string")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    sink = vector_sink(vector_stream(stream, HashingEncoder(8), 8), str(tmp_path / "out"), str(tmp_path / "state"))
    running = sink.trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.path, r.chunk_no) for r in got.collect()) == [("r1/a.py", 0), ("r1/a.py", 1), ("r2/c", 0)]
    assert got.filter((F.col("dim") != 8) | (F.size("embedding") != 8)).count() == 0
