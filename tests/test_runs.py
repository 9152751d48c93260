"""What goes on over several runs: numbers, embeddings; and the index in ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.operators import embedding, ordinal
from quillvec.sources import files


def names(spark, low, high):
    return spark.range(low, high).select(F.format_string("p%05d", "id").alias("path")).repartition(5)


def numbers(spark, path):
    return {r.path: r.idx for r in spark.read.schema("path string, idx bigint, run string").parquet(f"{path}/rows").collect()}


def test_numbers_go_on_without_gaps(spark, tmp_path):
    path = str(tmp_path / "n")
    assert ordinal.number_run(names(spark, 0, 40), ["path"], path, "a").agg(F.max("idx")).first()[0] == 40
    ordinal.number_run(names(spark, 40, 40), ["path"], path, "none")
    ordinal.number_run(names(spark, 40, 100), ["path"], path, "b")
    assert numbers(spark, path) == {f"p{i:05d}": i + 1 for i in range(100)}


def test_a_replayed_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "n")
    ordinal.number_run(names(spark, 0, 10), ["path"], path, "a")
    ordinal.number_run(names(spark, 10, 20), ["path"], path, "b")
    again = ordinal.number_run(names(spark, 500, 900), ["path"], path, "a")
    assert {r.path: r.idx for r in again.collect()} == {f"p{i:05d}": i + 1 for i in range(10)}
    assert len(numbers(spark, path)) == 20 and ordinal.counters(again, path).count() == 2


def test_a_run_that_broke_off_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "n")
    ordinal.number_run(names(spark, 0, 10), ["path"], path, "a")
    names(spark, 0, 99).withColumn("idx", F.lit(7).cast("bigint")).write.parquet(f"{path}/rows/run=b")  # rows, but no counter
    ordinal.number_run(names(spark, 10, 15), ["path"], path, "b")
    assert numbers(spark, path) == {f"p{i:05d}": i + 1 for i in range(15)}


def test_numbers_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "n")
    for start in (0, 30, 60):
        names(spark, start, start + 30).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start finds nothing new
        query = stream.writeStream.foreachBatch(lambda rows, n: ordinal.number_run(rows, ["path"], path, str(n)))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(numbers(spark, path).values()) == list(range(1, 91))


def test_a_range_opens_only_files_that_overlap_it(spark, tmp_path):
    path = str(tmp_path / "index")
    numbered = ordinal.with_ordinal(names(spark, 0, 300), ["path"])
    files.write_ranged_index(numbered, path, files=10)
    every, some = files.ranged_files(spark, path), files.ranged_files(spark, path, 100, 120)
    assert len(every) == 10 and 1 <= len(some) <= 3
    got = files.read_ranged_index(spark, path, 100, 120)
    assert {r.idx: r.path for r in got.collect()} == {i: f"p{i - 1:05d}" for i in range(100, 121)}
    assert {f.split("/")[-1] for f in got.inputFiles()} == {f.split("/")[-1] for f in some}
    assert files.read_ranged_index(spark, path, end=7).count() == 7 and files.read_ranged_index(spark, path, start=299).count() == 2
    assert files.read_ranged_index(spark, path).count() == 300 and files.read_ranged_index(spark, path, 900, 950).count() == 0


def choosy(bad):
    def make():
        def encode(batch):
            if any(set(words) & bad for words in batch):
                raise ValueError("not this one")
            return np.array([[len(words), 1.0] for words in batch])

        return encode

    return make


@pytest.mark.parametrize("size", [1, 7])
def test_failed_batches_come_again_and_each_row_is_embedded_once(spark, tmp_path, size):
    path = str(tmp_path / "e")
    rows = [(i, ["w"] * (i % 5) + (["bad"] if i % 10 == 3 else [])) for i in range(60)]
    tokens = spark.createDataFrame(rows, "id bigint, tokens array<string>").repartition(3)
    first = embedding.embed_run(tokens, choosy({"bad"}), 2, path, "1", ["id"], batch_size=size)
    failed = embedding.embed_failures(spark, path, tokens.schema, ["id"])
    assert first.count() == 60 and {r.embed_error for r in failed.collect()} == {"ValueError: not this one"}
    missing = {r.id for r in failed.collect()}
    assert missing >= {i for i, _ in rows if i % 10 == 3} and (size > 1 or len(missing) == 6)
    embedding.embed_run(tokens, choosy({"bad"}), 2, path, "2", ["id"], batch_size=1)
    embedding.embed_run(tokens, choosy(set()), 2, path, "3", ["id"], batch_size=size)
    embedding.embed_run(tokens, choosy(set()), 2, path, "3", ["id"], batch_size=size)  # repeated as a whole
    done = embedding.embedded_rows(spark, path, tokens.schema)
    assert sorted(r.id for r in done.collect()) == list(range(60))
    assert {r.id for r in done.where("run = '3'").collect()} == {i for i, _ in rows if i % 10 == 3}
    assert embedding.embed_failures(spark, path, tokens.schema, ["id"]).count() == 0
