"""Column expressions over file contents and paths. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes counted as code.
CODE_EXTENSIONS = (
    ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".py", ".js", ".ts",
    ".java", ".go", ".rs", ".php", ".rb", ".cs", ".scala", ".kt",
    ".swift", ".m", ".mm", ".sh", ".pl", ".lua", ".r", ".sql", ".html",
    ".css", ".xml", ".json", ".yml", ".yaml", ".md",
)

# Exclusive bounds on the number of characters of a usable file.
MIN_CHARS = 10
MAX_CHARS = 500_000


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF. Texts without CR, the usual case, are not rewritten."""
    lf = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\r")), lf).otherwise(text)


def within_length(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """Strictly between both bounds, in code points.

    A code point takes 1 to 4 bytes, so the byte length, which is stored, decides most texts
    without counting.
    """
    size = F.octet_length(text)
    return ((size > 4 * low) | (F.length(text) > low)) & ((size < high) | (F.length(text) < high))


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\x00"))


def is_usable_text(text: Column) -> Column:
    """Both rules; the byte length, which is stored, decides nearly all texts."""
    return within_length(text) & ~has_nul(text)


def content_hash(text: Column) -> Column:
    return F.md5(text)


def path_parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def is_hidden_path(path: Column) -> Column:
    """Any path part starts with ``.git`` (``.github`` and ``.gitignore`` too)."""
    return F.exists(path_parts(path), lambda part: F.startswith(part, F.lit(".git")))


def in_git_dir(path: Column) -> Column:
    """A path part is exactly ``.git``."""
    return F.array_contains(path_parts(path), ".git")


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix; empty for ``.gitignore``, ``x.`` and ``Makefile``."""
    name = F.element_at(path_parts(path), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def is_code_path(path: Column) -> Column:
    return file_suffix(path).isin(*CODE_EXTENSIONS)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def repo_of(relative: Column) -> Column:
    """First part of a path relative to the repositories' root."""
    return F.split(relative, "/", 2)[0]


def tokens(text: Column, limit: int) -> Column:
    """The first ``limit`` whitespace-separated tokens.

    Splitting stops behind them: one part more for what is left, one for a leading blank.
    """
    words = F.filter(F.split(text, r"\s+", limit + 2), lambda word: word != "")
    return F.slice(words, 1, limit)
