import pytest
from pyspark.sql import functions as F

from quillvec.functions import text
from quillvec.operators.chunking import chunk_lines, truncate_tokens
from quillvec.operators.corpus import content_rejects, usable_contents, visible_files


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw,want", [("a\r\nb", "a\nb"), ("a\rb", "a\nb"), ("a\r\r\nb", "a\n\nb"), ("a\n\rb", "a\n\nb"), ("plain", "plain")]
)
def test_newlines_as_universal_newlines(spark, raw, want):
    assert one(spark, raw, text.normalize_newlines) == want


@pytest.mark.parametrize("symbol", ["x", "é", "漢", "😀"])
@pytest.mark.parametrize("n,keep", [(10, False), (11, True), (39, True), (41, True), (499_999, True), (500_000, False)])
def test_length_window_counts_code_points(spark, symbol, n, keep):
    assert one(spark, symbol * n, text.is_usable_text) is keep


def test_nul_is_rejected_with_reason(spark):
    rows = spark.createDataFrame([(1, "x" * 20), (2, "x" * 20 + "\0"), (3, "short"), (4, None)], "id int, content string")
    assert [r.id for r in usable_contents(rows).collect()] == [1]
    assert {r.id: r.reason for r in content_rejects(rows).collect()} == {2: "NUL character", 3: "length", 4: "no content"}


@pytest.mark.parametrize(
    "path,suffix",
    [("d/a.PY", ".py"), ("a.tar.gz", ".gz"), (".gitignore", ""), ("x.", ""), ("Makefile", ""), ("d.x/Makefile", ""), ("..a", ".a"), (".a.b", ".b")],
)
def test_suffix(spark, path, suffix):
    assert one(spark, path, text.file_suffix) == suffix


def test_extension_table(spark):
    assert len(set(text.CODE_EXTENSIONS)) == 32
    assert one(spark, "r/A.PY", text.is_code_path) and not one(spark, "r/a.txt", text.is_code_path)


def test_hidden_and_git_paths(spark):
    paths = [".git/HEAD", "r/.gitignore", "r/.github/x.yml", "r/__init__.py", "r/.clang-format", "r/a.git/b", "r/x.gitx"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in visible_files(rows).collect()] == paths[3:]
    kept = rows.filter(~text.in_git_dir(F.col("path"))).collect()
    assert [r.path for r in kept] == paths[1:]


def test_relative_path_and_repo(spark):
    rel = spark.createDataFrame([("/root/repos/r1/a/b.py",), ("/elsewhere/c",)], "p string")
    rel = rel.select(text.relative_path(F.col("p"), "/root/repos/").alias("r"))
    assert [r.r for r in rel.collect()] == ["r1/a/b.py", "/elsewhere/c"]
    assert one(spark, "r1/a/b.py", text.repo_of) == "r1"


def brute_chunks(content, size=8, stride=4):
    lines = content.split("\n")
    if len(lines) < size:
        return ["\n".join(lines)]
    return ["\n".join(lines[i : i + size]) for i in range(0, len(lines) - size + 1, stride)]


@pytest.mark.parametrize("size,stride", [(8, 4), (3, 1), (2, 5)])
def test_chunks_equal_brute_force(spark, size, stride):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (1, 2, 7, 8, 9, 11, 12, 13, 50)] + ["", "a\n", "\n" * 8, "x\n" * 7]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, content string")
    chunks = chunk_lines(rows, size=size, stride=stride).orderBy("id", "chunk_no").collect()
    for i, body in enumerate(texts):
        mine = [r for r in chunks if r.id == i]
        assert [r.chunk for r in mine] == brute_chunks(body, size, stride)
        for r in mine:
            assert r.chunk == "\n".join(body.split("\n")[r.start_line - 1 : r.start_line - 1 + r.n_lines])
    assert not [r for r in chunks if r.id == 99]


def test_chunk_counts_by_line_count(spark):
    rows = spark.createDataFrame([(n, "\n".join("x" * n)) for n in (1, 7, 8, 9, 11, 12, 13)], "id int, content string")
    counts = {r.id: r["count"] for r in chunk_lines(rows).groupBy("id").count().collect()}
    assert counts == {1: 1, 7: 1, 8: 1, 9: 1, 11: 1, 12: 2, 13: 2}


@pytest.mark.parametrize("chunk", ["", "   ", "a", " a\tb\n\nc ", " ".join(map(str, range(500))), "\n" + " ".join(map(str, range(129)))])
def test_tokens(spark, chunk):
    rows = spark.createDataFrame([(chunk,)], "chunk string")
    assert truncate_tokens(rows).first().tokens == chunk.split()[:128]
