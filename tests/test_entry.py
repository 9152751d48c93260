import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")

ROWS_ONLY = {"knn_random_queries"}


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(driver.QUERIES) - set(driver.SQL) == ROWS_ONLY


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["query_id", "rank", "vec_id", "score"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(driver.SQL))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, FOLDER, name) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_query_runs(spark, name):
    assert driver.queries()[name](spark, FOLDER).count() > 0


def test_tasks_run_where_the_package_is_not_installed(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as d\n"
        "from quillvec.session import build_session\n"
        "s = build_session('t', 'local[2]', **{'spark.ui.enabled': 'false'})\n"
        "print('rows', d.entry(s).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
