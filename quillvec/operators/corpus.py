"""Corpus rules: which files are used, repository statistics, outcomes and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.display import bytes_to_gb
from quillvec.functions.text import content_hash, in_git_dir, is_code_path, is_hidden_path, is_usable_text, repo_of

# Outcomes that count as success; every other status is a failure.
SUCCESS = ("cloned", "updated")


def visible_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Drops files with a path part that starts with ``.git``; give paths relative to the root."""
    return files.filter(~is_hidden_path(F.col(path)))


def usable_contents(files: DataFrame, content: str = "content") -> DataFrame:
    """Texts of a usable length without NUL characters."""
    return files.filter(is_usable_text(F.col(content)))


def content_rejects(files: DataFrame, content: str = "content") -> DataFrame:
    """The complement of ``usable_contents``, with a ``reason``."""
    text = F.col(content)
    reason = (
        F.when(text.isNull(), F.lit("no content"))
        .when(F.contains(text, F.lit("\x00")), F.lit("NUL character"))
        .when(~is_usable_text(text), F.lit("length"))
    )
    return files.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop(content)


def code_files(files: DataFrame, content: str = "content") -> DataFrame:
    """``(path, content, repo_name, file_hash)`` of usable files with relative paths."""
    return usable_contents(files, content).select(
        "path",
        F.col(content).alias("content"),
        repo_of(F.col("path")).alias("repo_name"),
        content_hash(F.col(content)).alias("file_hash"),
    )


def is_success(status: Column) -> Column:
    return status.isin(*SUCCESS)


def repo_stats(files: DataFrame) -> DataFrame:
    """``(repo_name, total_files, code_files, total_size_gb)`` over ``files(repo_name, path, size)``.

    Files inside a ``.git`` folder do not count; ``.gitignore`` does.
    """
    return (
        files.filter(~in_git_dir(F.col("path")))
        .groupBy("repo_name")
        .agg(
            F.count("*").alias("total_files"),
            F.count_if(is_code_path(F.col("path"))).alias("code_files"),
            bytes_to_gb(F.sum("size")).alias("total_size_gb"),
        )
    )


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(~is_success(F.col("status"))).select("repo_name", "status", F.col("detail").alias("reason"))


def outcome_stats(outcomes: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of the successful repositories. One without counted files gets zeros."""
    good = outcomes.filter(is_success(F.col("status"))).select("repo_name", "status")
    return good.join(stats, "repo_name", "left").fillna(0, ["total_files", "code_files", "total_size_gb"])


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    good = is_success(F.col("status"))
    return outcomes.agg(
        F.count("*").alias("repositories"),
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
    )


def corpus_totals(outcomes: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics per successful repository, and over all of them (``repo_name`` null)."""
    return (
        outcome_stats(outcomes, stats)
        .rollup("repo_name")
        .agg(
            F.sum("total_files").alias("total_files"),
            F.sum("code_files").alias("code_files"),
            F.sum("total_size_gb").alias("total_size_gb"),
        )
    )


def chunk_stats(chunks: DataFrame, by: str) -> DataFrame:
    """Files, chunks and lines per ``by`` over chunks with ``path``."""
    return chunks.groupBy(by, "path").agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines")).groupBy(by).agg(
        F.count("*").alias("files"), F.sum("n").alias("chunks"), F.sum("lines").alias("chunk_lines")
    )
