"""The benchmark results table as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results_csv(results: DataFrame, path: str, mode: str = "error") -> None:
    """One CSV file with a header. The table has a row per method, dimension and run."""
    results.coalesce(1).write.mode(mode).option("header", True).csv(path)
