"""The repository catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame


def repo_catalog(repos: DataFrame) -> DataFrame:
    """Distinct ``(repo_url, repo_name)`` pairs, sorted."""
    return repos.select("repo_url", "repo_name").distinct().orderBy("repo_url", "repo_name")
