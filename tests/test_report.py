import math

import pytest
from pyspark.sql import functions as F

from quillvec.functions.display import bytes_to_gb, expected_mark, fixed, human_size, seconds_to_minutes, thousands
from quillvec.operators import corpus, report
from quillvec.operators.recall import recall_at_k
from quillvec.plans import sweep
from quillvec.plans.benchmark import report_tables
from quillvec.schemas import BENCHMARK, HIT, REPO_OUTCOME, TIMING
from quillvec.sources.results import write_results_csv
from quillvec.sources.vectors import random_queries, random_vector_table, stack


@pytest.fixture(scope="module")
def results(spark):
    nan = float("nan")
    rows = [
        (1, "FAISS", "IndexFlatIP", 128, 1000, 0.50001, 10.0, 0.002, 0.0, 1.0, 500.0),
        (2, "FAISS", "IndexIVFFlat", 128, 1000, 0.50004, 12.0, 0.001, 0.0, 0.5, 1000.0),
        (3, "scikit-learn", "BallTree", 128, 1000, 2.0, -3.5, 0.004, 0.0, 1.0, 250.0),
        (4, "SciPy", "cdist", 128, 1000, nan, 50.0, 0.004, 0.0, 1.0, nan),
        (5, "FAISS", "IndexFlatIP", 256, 1000, 0.9, -3.5, 0.00105, 0.0, 1.0, 952.38095),
    ]
    return report.results_table(spark.createDataFrame(rows, f"run_no INT, {BENCHMARK}"))


def test_latency_stats(spark):
    rows = [("a", "x", 8, 1, 1.0), ("a", "x", 8, 2, 3.0), ("b", "x", 8, 1, 2.0), ("c", "x", 8, 1, 0.0)]
    got = {r.library: r for r in report.latency_stats(spark.createDataFrame(rows, TIMING)).collect()}
    assert (got["a"].query_time_avg, got["a"].query_time_std, got["a"].throughput_qps) == (2.0, 1.0, 0.5)
    assert got["b"].query_time_std == 0.0 and got["c"].throughput_qps is None


def test_rounding_is_half_even(spark):
    row = spark.createDataFrame([(1, 0.00005, 0.00015)], "run_no int, build_time double, recall_at_k double")
    assert tuple(report.results_table(row).first()) == (1, 0.0, 0.0002)


def test_pivot_averages_index_types(results):
    got = {r.dimension: r for r in report.metric_pivot(results, "build_time", ["FAISS", "SciPy", "scikit-learn"]).collect()}
    assert got[128].FAISS == 0.5 and got[256].FAISS == 0.9 and got[128]["scikit-learn"] == 2.0
    assert got[256]["scikit-learn"] is None and math.isnan(got[128].SciPy)


def test_summary_in_order_of_appearance(results):
    summary = report.library_summary(results)
    assert [(r.library, r.runs) for r in summary.collect()] == [("FAISS", 3), ("scikit-learn", 1), ("SciPy", 1)]
    shown = report.summary_display(summary).collect()[0]
    assert shown.build_time == f"{(0.5 + 0.5 + 0.9) / 3:.3f}" and shown.memory == f"{18.5 / 3:.1f}"


def test_best_rows_first_run_wins_ties_and_nan_does_not_compete(results):
    got = {r.criterion: (r.run_no, r.value) for r in report.best_performers(results).collect()}
    assert got == {
        "fastest build": (1, 0.5),  # equal to run 2 after rounding
        "fastest query": (2, 0.001),
        "highest throughput": (2, 1000.0),
        "lowest memory": (3, -3.5),
    }


def test_recommendations(results):
    got = {r.criterion: r.index_type for r in report.recommendations(results).collect()}
    assert got == {"production": "IndexIVFFlat", "research": "BallTree", "memory-constrained": "BallTree"}
    none = report.recommendations(results, ("HNSWlib",), ("SciPy",))
    assert {r.criterion for r in none.collect()} == {"research", "memory-constrained"}
    assert report.recommendations(results.limit(0)).count() == 0
    assert report.in_libraries(results, report.PRODUCTION_STABLE).count() == 3


def test_boxplot(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 3, 4, 5, 6, 7, 100)] + [("b", 5.0), ("b", float("nan"))]
    got = {r.library: r for r in report.boxplot_stats(spark.createDataFrame(rows, "library string, query_time_avg double")).collect()}
    a = got["a"]
    assert (a.runs, a.q1, a.median, a.q3, a.whisker_low, a.whisker_high, a.outliers) == (9, 2.0, 4.0, 6.0, 1.0, 7.0, 1)
    assert (got["b"].runs, got["b"].q1, got["b"].outliers, got["b"].mean) == (1, 5.0, 0, 5.0)


def test_scaling_series(results):
    assert [r.run_no for r in report.scaling_series(results).collect()] == [1, 2, 5, 3, 4]


def test_csv(spark, results, tmp_path):
    write_results_csv(results, str(tmp_path / "csv"))
    back = spark.read.schema(results.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 5 and back.columns == results.columns


@pytest.mark.parametrize("size", [0, 1023, 1024, 1152, 1408, 1048575, 1048576, 5 * 2**20 + 12345, 2**30, 7 * 2**30 + 2**27])
def test_human_size_like_python(spark, size):
    got = spark.createDataFrame([(size,)], "s bigint").select(human_size(F.col("s")).alias("t")).first().t
    for unit, name in ((1, "bytes"), (1024, "KB"), (2**20, "MB"), (2**30, "GB")):
        if size < unit * 1024 or name == "GB":
            assert got == (f"{size} bytes" if unit == 1 else f"{size / unit:.2f} {name}")
            break


def test_formats(spark):
    row = spark.range(1).select(
        fixed(F.lit(0.125), 2).alias("a"), fixed(F.lit(2.5), 0).alias("b"), thousands(F.lit(1234567)).alias("c"),
        expected_mark(F.lit(3), 3).alias("d"), bytes_to_gb(F.lit(2**29)).alias("e"), seconds_to_minutes(F.lit(90)).alias("f"),
        fixed(F.lit(float("nan")), 1).alias("g"),
    ).first()
    assert tuple(row) == ("0.12", "2", "1,234,567", "✓", 0.5, 1.5, "NaN")


def test_recall(spark):
    exact = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (2, 1, 20, 0.9), (2, 2, 21, 0.8)], HIT)
    approx = spark.createDataFrame([(1, 1, 11, 0.8), (1, 2, 10, 0.7), (2, 1, 20, 0.9)], HIT)
    got = {r.k: (r.n_queries, r.recall) for r in recall_at_k(approx, exact, (1, 2)).collect()}
    assert got == {1: (2, 0.5), 2: (2, 0.75)}


STATUSES = ["cloned", "updated", "update_failed", "failed", "timeout", "git_error", "error", "future_error"]


def test_outcomes_and_totals(spark):
    outcomes = spark.createDataFrame([(f"r{i}", s, f"d{i}") for i, s in enumerate(STATUSES)], REPO_OUTCOME)
    files = spark.createDataFrame(
        [("r0", "r0/a.py", 2**29), ("r0", "r0/.git/a.py", 7), ("r0", "r0/.gitignore", 2**29), ("r3", "r3/b.c", 5)],
        "repo_name string, path string, size bigint",
    )
    stats = corpus.repo_stats(files)
    assert {r.repo_name: tuple(r)[1:] for r in stats.collect()} == {"r0": (2, 1, 1.0), "r3": (1, 1, 5 / 2**30)}
    assert {r.repo_name: r.total_files for r in corpus.outcome_stats(outcomes, stats).collect()} == {"r0": 2, "r1": 0}
    assert tuple(corpus.outcome_counts(outcomes).first()) == (8, 2, 6)
    assert [r.reason for r in corpus.failures(outcomes).orderBy("repo_name").collect()] == [f"d{i}" for i in range(2, 8)]
    totals = {r.repo_name: tuple(r)[1:] for r in corpus.corpus_totals(outcomes, stats).collect()}
    assert totals == {"r0": (2, 1, 1.0), "r1": (0, 0, 0.0), None: (2, 1, 1.0)}


def test_sweep_isolates_failures(spark):
    vectors = random_vector_table(spark, 300, (8, 16), seed=1)
    queries = stack([random_queries(spark, d, 5, seed=2) for d in (8, 16)])

    def fail(vectors, dim):
        raise RuntimeError("cannot build")

    methods = [sweep.flat_ip(), sweep.Method("broken", "x", fail, lambda q, b, k: q), sweep.flat_l2(), sweep.inverted_file(10, nlist=10), sweep.signed_planes(4, 2)]
    hits, results, failures = sweep.search_sweep(vectors, queries, methods, (8, 16, 99), k=20)
    rows = results.collect()
    assert len(rows) == 8 and {r.dimension for r in rows} == {8, 16}
    assert all(r.recall_at_k == 1.0 for r in rows if r.library in ("block", "inverted file"))
    assert all(r.num_vectors == 300 and r.throughput_qps > 0 for r in rows)
    assert sorted((f.dimension, f.library) for f in failures.collect()) == [(8, "broken"), (16, "broken"), (99, "")]
    assert all(r.query_time_std > 0 and r.memory_usage_mb is None for r in rows)
    assert hits.filter("library = 'block'").count() == 2 * 2 * 5 * 20
    tables = report_tables(results, ["block", "inverted file", "hyperplanes"], ["block"], ["hyperplanes"])
    assert len(tables) == 11 and all(table.count() > 0 for table in tables.values())
    assert tables["best_performers"].count() == 3 and tables["recommendations"].count() == 2
