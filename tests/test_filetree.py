"""The file tree data source."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringStartsWith

from quillvec.sources import filetree

CONTENTS = {
    "r1/a.py": b"print('hello')\n" * 3,
    "r1/__init__.py": b"# twelve chars\r\nx\ry",
    "r1/.git/HEAD": b"ref: refs/heads/main\n",
    "r1/deep/er/still/x.tar.GZ": b"caf\xc3\xa9 \xff\xfe end\xc3",
    "r1/deep/.gitignore": b"*.pyc\n",
    "r2/tiny": b"",
    "r2/name.": b"0" * 500,
    "top.md": b"# beside the repositories\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, data in CONTENTS.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    os.symlink(base / "r1" / "deep", base / "r2" / "link")
    os.symlink(base / "nowhere", base / "r2" / "broken")
    return base


@pytest.mark.parametrize("levels,partitions", [(1, 256), (2, 1), (3, 2), (9, 256)])
def test_every_file_is_a_row(spark, root, levels, partitions):
    rows = filetree.read_file_tree(spark, f"file://{root}", levels=levels, partitions=partitions).collect()
    got = {os.path.relpath(r.path, root): r for r in rows}
    assert sorted(got) == sorted(CONTENTS)
    for name, r in got.items():
        want = CONTENTS[name].decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert (r.size, r.content, r.error) == (len(CONTENTS[name]), want, None)
        assert r.repo_name == (name.split("/")[0] if "/" in name else "")
    assert {n: got[n].extension for n in got if got[n].extension} == {"r1/a.py": ".py", "r1/__init__.py": ".py", "r1/deep/er/still/x.tar.GZ": ".gz", "top.md": ".md"}


def test_filters_are_pushed(spark, root):
    rows = filetree.read_file_tree(spark, str(root))
    some = rows.where((F.col("extension") == ".py") & (F.col("size") > 20) & (F.col("repo_name") == "r1") & F.col("content").contains("hello"))
    assert [os.path.basename(r.path) for r in some.collect()] == ["a.py"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if " Filter (" in line]
    assert len(kept) == 1 and "content" in kept[0] and not any(name in kept[0] for name in ("extension", "size", "repo_name")), plan


def test_pushed_filters_prune_folders_and_spare_files(root, monkeypatch):
    def reader(*filters):
        made = filetree.FileTreeReader({"path": str(root)})
        return made, list(made.pushFilters(list(filters)))

    one, left = reader(In(("repo_name",), ("r2",)), Not(EqualTo(("size",), 3)), EqualTo(("content",), "x"))
    assert [type(f) for f in left] == [Not, EqualTo]
    assert {place[0] for part in one.partitions() for place in part.places} <= {"r2", ""}
    opened = []
    monkeypatch.setattr(filetree, "_read_text", lambda path, most: (opened.append(path), ("", None))[1])
    two, left = reader(GreaterThan(("size",), 400), StringStartsWith(("path",), str(root)))
    names = [name for part in two.partitions() for batch in two.read(part) for name in batch["path"].to_pylist()]
    assert left == [] and names == opened == [str(root / "r2" / "name.")]


def test_errors_are_rows(spark, root):
    missing = filetree.read_file_tree(spark, str(root / "none")).collect()
    assert len(missing) == 1 and "No such file" in missing[0].error
    long = filetree.read_file_tree(spark, str(root), max_chars=100).where("error IS NOT NULL").collect()
    assert [(os.path.basename(r.path), r.content, r.error) for r in long] == [("name.", None, "has 100 characters or more")]
    with pytest.raises(Exception, match="root folder"):
        filetree.register_file_tree(spark)
        spark.read.format(filetree.FORMAT).load().count()


def test_listing_alone_opens_nothing(spark, root):
    rows = filetree.read_file_tree(spark, str(root), content="false")
    assert rows.where("content IS NOT NULL").count() == 0 and rows.count() == len(CONTENTS)


def test_written_files_are_whole_and_failures_are_named(spark, tmp_path):
    (tmp_path / "taken").write_text("a file, no folder")
    rows = [("a/b.txt", b"one"), ("taken/x", b"two"), ("c", None), (None, b"nowhere")]
    failed = filetree.write_file_tree(spark.createDataFrame(rows, "path string, content binary"), f"file://{tmp_path}").collect()
    assert {r.path for r in failed} == {"taken/x", None} and all(r.error for r in failed)
    assert (tmp_path / "a" / "b.txt").read_bytes() == b"one" and (tmp_path / "c").read_bytes() == b""
