"""Tables over search benchmarks: latency statistics, pivots, summaries and best picks.

A results table has the columns of ``schemas.BENCHMARK`` and a ``run_no`` that gives the order
of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.display import fixed, round_half_even

METRICS = ("build_time", "query_time_avg", "throughput_qps", "memory_usage_mb")
ROUNDED = ("build_time", "memory_usage_mb", "query_time_avg", "query_time_std", "recall_at_k", "throughput_qps")

# Which libraries the recommendations compare.
PRODUCTION = ("FAISS", "HNSWlib")
PRODUCTION_STABLE = ("FAISS",)
RESEARCH = ("scikit-learn", "SciPy")


def latency_stats(timings: DataFrame) -> DataFrame:
    """Mean, population deviation and throughput of ``seconds`` per library, index and dimension."""
    return timings.groupBy("library", "index_type", "dimension").agg(
        F.count("*").alias("n_queries"),
        F.avg("seconds").alias("query_time_avg"),
        F.stddev_pop("seconds").alias("query_time_std"),
        F.try_divide(F.lit(1.0), F.avg("seconds")).alias("throughput_qps"),
    )


def results_table(results: DataFrame) -> DataFrame:
    """Metrics rounded to 4 places, half to even. Everything below reads the rounded table."""
    return results.withColumns({c: round_half_even(F.col(c)) for c in ROUNDED if c in results.columns})


def in_libraries(results: DataFrame, libraries: Sequence[str]) -> DataFrame:
    return results.filter(F.col("library").isin(*libraries))


def metric_means(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``(metric, dimension, library, mean)`` of every library, from one aggregation."""
    means = results.groupBy("dimension", "library").agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot(["dimension", "library"], list(metrics), "metric", "mean")


def metric_pivot(results: DataFrame, metric: str, libraries: Sequence[str] | None = None) -> DataFrame:
    """Mean of a metric, dimension by library; without a list, all libraries are columns."""
    return results.groupBy("dimension").pivot("library", libraries and list(libraries)).agg(F.avg(metric)).orderBy("dimension")


def library_summary(results: DataFrame) -> DataFrame:
    """Mean metrics and number of runs per library, in order of first appearance."""
    return (
        results.groupBy("library")
        .agg(
            F.min("run_no").alias("first_run"),
            *[F.avg(m).alias(f"avg_{m}") for m in METRICS],
            F.count("*").alias("runs"),
        )
        .orderBy("first_run")
    )


def summary_display(summary: DataFrame) -> DataFrame:
    """The summary's numbers as text: times with 3 and 4 places, rates and sizes with 1."""
    return summary.select(
        "library",
        fixed(F.col("avg_build_time"), 3).alias("build_time"),
        fixed(F.col("avg_query_time_avg"), 4).alias("query_time"),
        fixed(F.col("avg_throughput_qps"), 1).alias("throughput"),
        fixed(F.col("avg_memory_usage_mb"), 1).alias("memory"),
        "runs",
    )


def _picks(results: DataFrame, wanted: Sequence[tuple[str, str, bool, Column]]) -> DataFrame:
    """Per ``(criterion, metric, largest, condition)`` the row with the best metric.

    The earliest run wins ties; NaN and null do not compete; a criterion without candidates has
    no row. All criteria share one pass over the table.
    """
    picks = []
    for criterion, metric, largest, condition in wanted:
        competes = condition & F.col(metric).isNotNull() & ~F.isnan(metric)
        row = F.struct(
            F.lit(criterion).alias("criterion"),
            "library",
            "index_type",
            "dimension",
            F.col(metric).alias("value"),
            "run_no",
        )
        run = -F.col("run_no") if largest else F.col("run_no")
        rank = F.when(competes, F.struct(F.col(metric), run))  # a null rank is passed over
        picks.append(F.max_by(row, rank) if largest else F.min_by(row, rank))
    best = results.agg(F.array(*picks).alias("best")).select(F.explode("best").alias("best"))
    return best.filter(F.col("best").isNotNull()).select("best.*")


def best_performers(results: DataFrame) -> DataFrame:
    everyone = F.lit(True)
    return _picks(
        results,
        [
            ("fastest build", "build_time", False, everyone),
            ("fastest query", "query_time_avg", False, everyone),
            ("highest throughput", "throughput_qps", True, everyone),
            ("lowest memory", "memory_usage_mb", False, everyone),
        ],
    )


def recommendations(
    results: DataFrame, production: Sequence[str] = PRODUCTION, research: Sequence[str] = RESEARCH
) -> DataFrame:
    """Best library per purpose; a purpose without candidates has no row."""
    return _picks(
        results,
        [
            ("production", "throughput_qps", True, F.col("library").isin(*production)),
            ("research", "query_time_avg", False, F.col("library").isin(*research)),
            ("memory-constrained", "memory_usage_mb", False, F.lit(True)),
        ],
    ).drop("value", "run_no")


def boxplot_stats(results: DataFrame, metric: str = "query_time_avg", by: str = "library") -> DataFrame:
    """Mean, quartiles, whiskers (last values within 1.5 interquartile ranges) and outliers.

    Equal values are counted first, so the quartiles and the whiskers work on distinct values.
    """
    values = results.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    counts = values.groupBy(by, F.col(metric).alias("x")).agg(F.count("*").alias("n"))
    quartiles = counts.groupBy(by).agg(
        F.sum("n").alias("runs"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("x", F.lit([0.25, 0.5, 0.75]).cast("array<double>"), F.col("n")).alias("q"),
    )
    boxes = quartiles.select(
        by, "runs", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    return (
        counts.join(boxes, by)
        .groupBy(by, "runs", "mean", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def scaling_series(results: DataFrame) -> DataFrame:
    """Query time against dimension per library, libraries and points in order of appearance."""
    first = results.groupBy("library").agg(F.min("run_no").alias("first_run"))
    return (
        results.select("library", "dimension", "query_time_avg", "run_no")
        .join(first, "library")
        .orderBy("first_run", "run_no")
        .drop("first_run")
    )
