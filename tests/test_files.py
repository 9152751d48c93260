import os

import pytest
from pyspark.sql import functions as F

from quillvec.operators.ordinal import with_batch, with_ordinal
from quillvec.plans.corpus import chunk_table, file_rejects, indexed_files, scanned_files, vector_table
from quillvec.operators.embedding import HashingEncoder
from quillvec.sources import files, repos


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("repositories")
    contents = {
        "r1/a.py": b"print('hello world')\n" * 3,
        "r1/__init__.py": b"# twelve chars\n",
        "r1/.clang-format": b"BasedOnStyle: LLVM\n",
        "r1/.git/HEAD": b"ref: refs/heads/main\n",
        "r1/.gitignore": b"*.pyc and more\n",
        "r1/deep/er/still/x.c": b"int main() { return 0; }\r\nline two\rline three\n",
        "r2/bad.txt": b"caf\xc3\xa9 \xff\xfe and some more\n",
        "r2/nul.bin": b"\x00" * 40,
        "r2/tiny": b"0123456789",
        "r2/odd : name.txt": b"a file with a colon\n",
    }
    for name, data in contents.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(base / "r1" / "deep", base / "r2" / "link")  # not entered
    os.symlink(base / "r1" / "a.py", base / "r2" / "copy.py")  # a file
    os.symlink(base / "nowhere", base / "r2" / "broken")
    return base, contents


@pytest.fixture
def roots(spark, tree):
    base, _ = tree
    return spark.createDataFrame([(r, str(base / r)) for r in ("r1", "r2")], "repo_name string, root string")


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_listing_finds_every_regular_file(roots, tree, levels):
    base, contents = tree
    got = files.list_files(roots, split_levels=levels).collect()
    assert sorted(os.path.relpath(r.path, base) for r in got) == sorted([*contents, "r2/copy.py"])
    sizes = {os.path.relpath(r.path, base): r.size for r in got}
    assert all(sizes[name] == len(data) for name, data in contents.items())


def test_listing_reports_missing_roots(spark):
    roots = spark.createDataFrame([("x", "/nonexistent/x")], "repo_name string, root string")
    row = files.list_files(roots).first()
    assert row.error and row.size is None


def test_contents_like_text_mode(spark, tree):
    base, contents = tree
    names = [*contents, "r2/none"]
    rows = spark.createDataFrame([(str(base / n),) for n in names], "path string")
    got = {os.path.relpath(r.path, base): r for r in files.read_contents(rows).collect()}
    for name in contents:
        want = (base / name).read_text(encoding="utf-8", errors="ignore")
        assert got[name].content == want and got[name].read_error is None
    assert got["r2/none"].content is None and got["r2/none"].read_error


def test_contents_across_read_blocks(spark, tmp_path, monkeypatch):
    for step in (1, 2, 3):
        data = "é\r\n\rx😀\r".encode() + b"\xf0\x9f" + b"\r"
        path = tmp_path / f"f{step}"
        path.write_bytes(data)
        monkeypatch.setattr(files, "_READ_BYTES", step)
        assert files._read_text(str(path), None)[0] == path.read_text(encoding="utf-8", errors="ignore")


def test_too_long_files_are_rejected_not_cut(spark, tmp_path):
    for n in (499_999, 500_000):
        (tmp_path / str(n)).write_text("é" * n)
    rows = spark.createDataFrame([(str(tmp_path / str(n)),) for n in (499_999, 500_000)], "path string")
    assert all(len(r.content) == int(os.path.basename(r.path)) for r in files.read_contents(rows).collect())
    got = {os.path.basename(r.path): r for r in files.read_contents(rows, 500_000).collect()}
    assert len(got["499999"].content) == 499_999
    assert got["500000"].content is None and "500000" in got["500000"].read_error


def test_index_lines(spark):
    lines = ["1 : /root/a.py", "2 : /root/a:b.py", "no colon", "x : /p", "", " \t 7\t:  /q r \t", "-3 : /n", ": /e", " 8 : /u\x1f"]
    parsed = files.parse_index_lines(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert sorted((r.idx, r.path) for r in files.valid_index(parsed).collect()) == [
        (-3, "/n"), (1, "/root/a.py"), (2, "/root/a:b.py"), (7, "/q r"), (8, "/u")
    ]
    assert sorted(r.reason for r in files.rejected_index(parsed).collect()) == ["no colon", "no colon", "no number", "no number"]


def test_index_round_trip_range_and_workers(spark, roots, tmp_path):
    numbered = files.number_files(files.list_files(roots).filter("error is null"))
    files.write_file_index(numbered, str(tmp_path / "index"))
    index = files.read_file_index(spark, str(tmp_path / "index"))
    rows = sorted((r.idx, r.path) for r in index.collect())
    assert [i for i, _ in rows] == list(range(1, 12))
    assert [p for _, p in rows] == sorted(p for _, p in rows)
    assert [r.idx for r in files.index_range(index, 3, 5).orderBy("idx").collect()] == [3, 4, 5]
    assert files.index_range(index, None, 5).count() == 5 and files.index_range(index, 5).count() == 7
    assert [r.worker_id for r in files.with_worker(index, 4).orderBy("idx").collect()] == [0] * 4 + [1] * 4 + [2] * 3
    some = index.filter("idx <= 4")
    assert files.existing(index, some).count() == 4 and files.missing(index, some).count() == 7


def test_scan_and_index_modes_agree(spark, roots, tree):
    base, _ = tree
    scanned = scanned_files(roots, str(base))
    want = {"r1/a.py", "r1/__init__.py", "r1/.clang-format", "r1/deep/er/still/x.c", "r2/bad.txt", "r2/odd : name.txt", "r2/copy.py"}
    assert {r.path for r in scanned.collect()} == want
    index = files.number_files(files.list_files(roots)).select("idx", "path")
    assert {tuple(r) for r in indexed_files(index, str(base)).collect()} == {tuple(r) for r in scanned.collect()}
    assert {r.path for r in indexed_files(index, str(base), skip_hidden=False).collect()} == want | {"r1/.git/HEAD", "r1/.gitignore"}
    assert {r.repo_name for r in scanned.collect()} == {"r1", "r2"}
    listed = files.list_files(roots)
    rejects = {r.path: r.reason for r in file_rejects(listed, str(base)).collect()}
    used = {f"{base}/{r.path}" for r in scanned.collect()}
    assert used | set(rejects) == {r.path for r in listed.collect()} and not used & set(rejects)
    elsewhere = spark.createDataFrame([(1, "/elsewhere/a.py")], "idx bigint, path string")
    assert [r.reason for r in file_rejects(elsewhere, str(base)).collect()] == ["outside the root"]
    assert indexed_files(elsewhere, str(base)).count() == 0
    vectors = vector_table(chunk_table(scanned), HashingEncoder(16), 16)
    assert vectors.count() == 7 and vectors.filter("embed_error is not null").count() == 0
    assert vectors.select("vec_id").distinct().count() == 7


def test_catalogue_is_distinct_and_sorted(spark):
    rows = [("u2", "b"), ("u1", "a"), ("u2", "b"), ("u3", "a")]
    got = repos.repo_catalog(spark.createDataFrame(rows, "repo_url string, repo_name string")).collect()
    assert [tuple(r) for r in got] == [("u1", "a"), ("u2", "b"), ("u3", "a")]


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_ordinal_is_dense_and_ordered(spark, partitions):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("x")).repartition(partitions)
    got = with_ordinal(rows, ["k"]).orderBy("idx").collect()
    assert [(r.idx, r.k) for r in got] == [(i + 1, i) for i in range(1000)]


def test_ordinal_with_one_frequent_value(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    numbered = with_ordinal(rows, ["k"], partitions=6)
    got = numbered.orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1, 901)) and [r.k for r in got] == sorted(r.k for r in got)
    assert len({r.id for r in got}) == 900
    assert max(len(p) for p in numbered.rdd.glom().collect()) < 400
    assert with_ordinal(rows.limit(0), ["k"]).count() == 0


def test_batch_numbers(spark):
    numbered = spark.range(1, 11).withColumnRenamed("id", "idx")
    assert [r.batch_no for r in with_batch(numbered, 4).orderBy("idx").collect()] == [0] * 4 + [1] * 4 + [2] * 2
