"""Quantile sketches: exact while small, within their rank error beyond, merged like one."""

import random

import pytest

from quillvec.operators import sketches

ROWS = "library string, seconds double"


def test_small_groups_are_exact(spark):
    rows = [("a", float(x)) for x in (5, 1, 4, 2, 3)] + [("b", 7.0), ("b", None), ("b", float("nan"))]
    got = {r.library: r for r in sketches.quartiles(sketches.sketch(spark.createDataFrame(rows, ROWS), "seconds", ["library"])).collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3, got["a"].mean) == (2.0, 3.0, 4.0, 3.0)
    assert (got["a"].lowest, got["a"].highest, got["a"].runs) == (1.0, 5.0, 5)
    assert (got["b"].q1, got["b"].q3, got["b"].runs) == (7.0, 7.0, 1)


def test_merged_runs_stay_within_the_rank_error(spark, tmp_path):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.9 else "b", rng.expovariate(1.0) if k % 3 else 0.5) for k in range(30_000)]
    path, k = str(tmp_path / "runs"), 64
    frames = [spark.createDataFrame(rows[j::4], ROWS) for j in range(4)]
    for run, frame in enumerate([*frames, frames[3]]):
        sketches.add_run(frame, "seconds", ["library"], path, str(min(run, 3)), k)  # the last run is repeated
    stored = sketches.read_runs(spark, path)
    assert stored.count() == 8 and max(len(r.sketch) for r in stored.collect()) < 8 * 4 * k
    boxes = sketches.quartiles(sketches.merged(stored, ["library"], k))
    whole = spark.createDataFrame(rows, ROWS)
    assert {r.library: r.runs for r in boxes.collect()} == {r.library: r["count"] for r in whole.groupBy("library").count().collect()}
    assert all(r.miss <= sketches.rank_error(k) for r in sketches.rank_misses(whole, "seconds", boxes, ["library"]).collect())


def test_groups_merge_into_wider_ones(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], ROWS)
    fine = sketches.sketch(rows, "seconds", ["library"])
    whole = sketches.quartiles(sketches.merged(fine, [])).collect()[0]
    assert (whole.runs, whole.lowest, whole.median, whole.highest, whole.mean) == (3, 1.0, 2.0, 9.0, pytest.approx(4.0))


def test_misses_are_seen_and_empty_tables_pass(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(100)], ROWS)
    boxes = spark.createDataFrame([("a", 25.0, 90.0, 75.0)], "library string, q1 double, median double, q3 double")
    assert sketches.rank_misses(rows, "seconds", boxes, ["library"]).collect()[0].miss == pytest.approx(0.4)
    assert sketches.quartiles(sketches.sketch(rows.limit(0), "seconds", ["library"])).count() == 0
