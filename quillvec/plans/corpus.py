"""From repositories to stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.text import MAX_CHARS, is_hidden_path, relative_path
from quillvec.operators.chunking import MAX_TOKENS, chunk_lines, truncate_tokens
from quillvec.operators.corpus import code_files, content_rejects, visible_files
from quillvec.operators.embedding import BATCH_SIZE, EncoderFactory, embed
from quillvec.sources.files import list_files, read_contents


def scanned_files(roots: DataFrame, base: str) -> DataFrame:
    """Usable files below ``roots(repo_name, root)`` with paths relative to ``base``."""
    files = list_files(roots).filter(F.col("error").isNull())
    return _loaded(files, base, skip_hidden=True)


def indexed_files(index: DataFrame, base: str, skip_hidden: bool = True) -> DataFrame:
    """Usable files of an index ``(idx, path)``, with paths relative to ``base``."""
    return _loaded(index, base, skip_hidden)


def _inside(base: str) -> Column:
    return F.startswith("path", F.lit(base.rstrip("/") + "/"))


def _loaded(files: DataFrame, base: str, skip_hidden: bool) -> DataFrame:
    relative = files.filter(_inside(base)).select("path", relative_path(F.col("path"), base).alias("relative"))
    if skip_hidden:
        relative = visible_files(relative, "relative")
    read = read_contents(relative, MAX_CHARS).filter(F.col("read_error").isNull())
    return code_files(read.select(F.col("relative").alias("path"), "content"))


def file_rejects(files: DataFrame, base: str, skip_hidden: bool = True) -> DataFrame:
    """``(path, reason)`` of what ``scanned_files`` (give it ``list_files``) or ``indexed_files`` leaves out."""
    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    hidden = is_hidden_path(relative_path(F.col("path"), base)) & F.lit(skip_hidden)
    reason = (
        F.when(known.isNotNull(), known)
        .when(~_inside(base), F.lit("outside the root"))
        .when(hidden, F.lit("hidden path"))
    )
    judged = files.select("path", reason.alias("reason"))
    read = read_contents(judged.filter(F.col("reason").isNull()).select("path"), MAX_CHARS)
    failed = read.filter(F.col("read_error").isNotNull()).select("path", F.col("read_error").alias("reason"))
    unusable = content_rejects(read.filter(F.col("read_error").isNull())).select("path", "reason")
    return judged.filter(F.col("reason").isNotNull()).unionByName(failed).unionByName(unusable)


def chunk_table(files: DataFrame) -> DataFrame:
    """Token-bounded chunks of ``code_files`` rows, keeping path, repository and hash."""
    return truncate_tokens(chunk_lines(files, "content"), limit=MAX_TOKENS)


def vector_table(chunks: DataFrame, make_encoder: EncoderFactory, dim: int, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Embedded chunks with a ``vec_id`` from their lineage, ready for ``write_vectors``.

    The id is a hash of path and chunk number: the same after any repartitioning, without a
    global numbering pass. Rejected batches keep ``embed_error``.
    """
    ids = chunks.withColumns({"vec_id": F.xxhash64("path", "chunk_no"), "dim": F.lit(dim)})
    return embed(ids, make_encoder, dim, "tokens", batch_size)
