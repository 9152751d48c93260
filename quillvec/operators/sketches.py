"""Mergeable quantile sketches of measurements.

Each run keeps one sketch (KLL) per group in place of its values; runs are merged without reading the values again. A sketch of
``k`` has a few ``k`` values however many it has seen. Of a group with at most ``k`` values the quartiles are exact; beyond
that the rank of an answer is within ``rank_error(k)`` of the one asked for, merged or not, but for rare draws. Counts, means and
extremes are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 800
QUARTILES = (0.25, 0.5, 0.75)


def rank_error(k: int = K) -> float:
    """How far, as a share of all values, the rank of one answer may lie from the one asked for.

    Twice the sketch's published error at 99 % confidence, as many answers are judged by it.
    """
    return 2 * 2.296 / k**0.9021


def sketch(rows: DataFrame, metric: str, by: Sequence[str], k: int = K) -> DataFrame:
    """``(*by, runs, total, lowest, highest, sketch)``; null and NaN are no values. Combined before the shuffle."""
    x = F.col(metric).cast("double")
    return rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.sum(x).alias("total"),
        F.min(x).alias("lowest"),
        F.max(x).alias("highest"),
        F.kll_sketch_agg_double(x, k).alias("sketch"),
    )


def merged(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """The sketches of several runs, or of finer groups, as one per group of ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("runs").alias("runs"),
        F.sum("total").alias("total"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )


def quartiles(sketches: DataFrame) -> DataFrame:
    """The groups with ``runs, mean, lowest, q1, median, q3, highest``."""
    others = [c for c in sketches.columns if c not in ("runs", "total", "lowest", "highest", "sketch")]
    found = F.kll_sketch_get_quantile_double("sketch", F.lit(list(QUARTILES)).cast("array<double>"))
    asked = sketches.withColumn("__q", found)
    q1, median, q3 = (F.col("__q")[j] for j in range(3))
    mean = F.col("total") / F.col("runs")
    return asked.select(
        *others, "runs", mean.alias("mean"), "lowest", q1.alias("q1"), median.alias("median"), q3.alias("q3"), "highest"
    )


def add_run(rows: DataFrame, metric: str, by: Sequence[str], path: str, run: str, k: int = K) -> None:
    """Writes the sketches of a run below ``path``; a repeated run replaces its own."""
    sketch(rows, metric, by, k).write.mode("overwrite").parquet(f"{path}/run={run}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all runs, with ``run``."""
    found = spark.read.parquet(path)
    return found.withColumn("run", F.col("run").cast(T.StringType()))


def rank_misses(rows: DataFrame, metric: str, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, miss)``: how far the ranks of the quartiles are from those asked for, as a share of the group's values.

    One pass over the values. A value that occurs several times has all their ranks.
    """
    x = F.col(metric).cast("double")
    values = rows.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("__x"))
    named = list(zip(("q1", "median", "q3"), QUARTILES))
    counts = values.join(boxes.select(*by, *(name for name, _ in named)), list(by)).groupBy(*by).agg(
        F.count("*").alias("__n"),
        *(F.count_if(F.col("__x") < F.col(name)).alias(f"__below_{name}") for name, _ in named),
        *(F.count_if(F.col("__x") <= F.col(name)).alias(f"__upto_{name}") for name, _ in named),
    )
    misses = [
        F.greatest(F.col(f"__below_{name}") / F.col("__n") - p, p - F.col(f"__upto_{name}") / F.col("__n"), F.lit(0.0))
        for name, p in named
    ]
    return counts.select(*by, F.greatest(*misses).alias("miss"))
