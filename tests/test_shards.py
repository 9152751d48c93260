"""The committing shard writer."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.sources import shards


def rows_of(spark, n, dims=(2, 3)):
    one = spark.range(n).withColumnRenamed("id", "vec_id").withColumn("dim", F.explode(F.lit(list(dims)).cast("array<int>")))
    return one.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.col("dim")), lambda j: (F.col("vec_id") + j).cast("float")))


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def test_shards_are_exact_and_read_back(spark, tmp_path):
    path, rows = str(tmp_path / "s"), rows_of(spark, 250).repartition(7)
    shards.write_shards(rows, path, max_rows=60)
    listed = shards.read_manifest(spark, path).collect()
    assert sorted((r.dim, r.shard, r.rows) for r in listed) == [(d, s, 60 if s < 4 else 10) for d in (2, 3) for s in range(5)]
    assert all(os.path.getsize(f"{path}/{r.file}") == r.bytes for r in listed)
    back = shards.read_shards(spark, path)
    assert back.exceptAll(rows.select(back.columns)).count() == 0 and back.count() == 500
    assert shards.read_shards(spark, path, 3).where("dim <> 3").count() == 0
    assert not os.path.exists(f"{path}/_drafts/{os.listdir(path + '/_manifest')[0].split('.')[0]}")


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "s")
    bad = rows_of(spark, 100).withColumn("embedding", F.when(F.col("vec_id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("embedding")))
    placed = rows_of(spark, 100).select("vec_id", "dim", "embedding", F.floor(F.col("vec_id") / 10).alias("shard"))
    spoilt = placed.join(bad.select("vec_id", "dim", F.col("embedding").alias("e")), ["vec_id", "dim"]).select("vec_id", "dim", F.col("e").alias("embedding"), "shard")
    spark.dataSource.register(shards.VectorShards)
    dealt = spoilt.repartitionByRange(4, "dim", "shard").sortWithinPartitions("dim", "shard")
    with pytest.raises(Exception, match="lost"):
        dealt.write.format(shards.FORMAT).mode("append").option("max_rows", 10).save(path)
    assert [f for f in files_below(path) if f.startswith(("dim_", "_manifest"))] == []


def batch(dim, shard, ids):
    n = len(ids)
    return pa.RecordBatch.from_pydict({"vec_id": ids, "dim": pa.array([dim] * n, pa.int32()), "embedding": [[1.0] * dim] * n, "shard": [shard] * n})


def test_repeated_and_killed_tasks_leave_no_shard(tmp_path):
    writer = shards.ShardWriter({"path": str(tmp_path), "max_rows": "5"})
    lost = writer.write(iter([batch(2, 0, [1, 2])]))  # an attempt whose message never arrives
    with pytest.raises(RuntimeError):
        writer.write(_until_killed())
    done = [writer.write(iter([batch(2, 0, [1, 2]), batch(2, 0, [3]), batch(2, 1, [4])])), writer.write(iter([])), None]
    writer.commit(done)
    assert files_below(tmp_path) == [f"_manifest/{writer.run}.json", "dim_2/batch_000000.parquet", "dim_2/batch_000001.parquet"]
    listed = [json.loads(line) for line in open(tmp_path / "_manifest" / f"{writer.run}.json")]
    assert [(r["shard"], r["rows"]) for r in listed] == [(0, 3), (1, 1)] and lost.shards


def _until_killed():
    yield batch(2, 3, [7, 8])
    raise RuntimeError("killed")


def test_aborted_and_clashing_writes(tmp_path):
    first, second = (shards.ShardWriter({"path": str(tmp_path), "max_rows": "5"}) for _ in range(2))
    gone = first.write(iter([batch(2, 0, [1])]))
    first.abort([gone])
    assert files_below(tmp_path) == []
    second.commit([second.write(iter([batch(2, 0, [1])]))])
    third = shards.ShardWriter({"path": str(tmp_path), "max_rows": "5"})
    with pytest.raises(FileExistsError):
        third.commit([third.write(iter([batch(2, 0, [9])]))])
    with pytest.raises(ValueError, match="more than"):
        third.write(iter([batch(2, 1, list(range(6)))]))


def test_nothing_to_write(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_shards(rows_of(spark, 0), path)
    assert shards.read_shards(spark, path).count() == 0
