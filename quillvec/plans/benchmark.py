"""All tables of a search benchmark's report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillvec.operators import report


def report_tables(
    results: DataFrame,
    libraries: Sequence[str],
    production: Sequence[str] = report.PRODUCTION,
    research: Sequence[str] = report.RESEARCH,
) -> dict[str, DataFrame]:
    """Name to table, all derived from the rounded results; ``libraries`` are the pivots' columns."""
    rounded = report.results_table(results)
    summary = report.library_summary(rounded)
    return {
        "results": rounded,
        **{f"pivot_{metric}": report.metric_pivot(rounded, metric, libraries) for metric in report.METRICS},
        "summary": summary,
        "summary_display": report.summary_display(summary),
        "best_performers": report.best_performers(rounded),
        "recommendations": report.recommendations(rounded, production, research),
        "boxplot": report.boxplot_stats(rounded),
        "scaling": report.scaling_series(rounded),
    }
