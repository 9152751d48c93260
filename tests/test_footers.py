"""Verdicts from footers against verdicts from rows."""

import os

import pytest
from pyspark.sql import functions as F

from quillvec.operators import verify
from quillvec.sources import footers


def stored(spark, path, low, high):
    n = F.col("id")
    length = F.when(n % 50 == 7, 3).otherwise(F.when(n < 200, 4).otherwise(5))
    rows = spark.range(low, high).select(
        n.alias("vec_id"),
        F.when(~n.between(300, 399) & (n % 11 > 0), F.transform(F.sequence(F.lit(1), length), lambda j: j.cast("float"))).alias("embedding"),
        F.when(n % 13 > 0, F.format_string("m%d", n)).alias("metadata"),
        F.floor(n / 100).alias("part"),
    )
    footers.with_length(rows).repartition(4, "part").write.mode("append").partitionBy("part").option("parquet.block.size", 2000).parquet(path)


def test_footers_judge_as_the_rows_do(spark, tmp_path):
    path = str(tmp_path / "v")
    stored(spark, path, 0, 600)
    found = footers.read_footers(spark, path)
    plain = verify.verify_files(spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path")))
    name = F.regexp_extract("file", "part=.*$", 0)
    tidy = lambda df: sorted(map(tuple, df.withColumn("file", name).select(plain.columns).collect()))
    assert tidy(verify.judge_files(found)) == tidy(plain)
    assert {r.status for r in plain.collect()} >= {"ERROR", "MISMATCH"} and found.agg(F.sum("rows")).first()[0] == 600


def test_only_new_files_are_opened(spark, tmp_path):
    path = str(tmp_path / "v")
    stored(spark, path, 0, 300)
    first = footers.read_footers(spark, path)
    first.drop("opened").write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    assert not footers.read_footers(spark, path, known).where("opened").count()
    stored(spark, path, 300, 500)
    os.remove(known.where("file LIKE '%part=1/%'").first().file.removeprefix("file:"))
    again = footers.read_footers(spark, path, known)
    assert again.where("opened").agg(F.sum("rows")).first()[0] == 200 and again.count() == known.count() - 1 + 2
    whole = footers.read_footers(spark, path)
    assert again.drop("opened").exceptAll(whole.drop("opened")).count() == 0


@pytest.mark.parametrize("damage", [b"no parquet", b"PAR1" * 5])
def test_damaged_files_are_named(spark, tmp_path, damage):
    path = str(tmp_path / "v")
    stored(spark, path, 0, 100)
    (tmp_path / "v" / "bad.parquet").write_bytes(damage)
    bad = footers.read_footers(spark, path).where("problem IS NOT NULL").collect()
    assert [(os.path.basename(r.file), r.n_vectors, r.rows) for r in bad] == [("bad.parquet", 0, None)]
