"""Array helpers that run inside tasks: words, byte-level pre-tokens and their hashes.

Everything works on the flat UTF-8 bytes of an Arrow string column, a few megabytes at a time, so
that one very long text costs no more memory than many short ones.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text handled at once; all temporary arrays are a small multiple of it.
CHUNK = 1 << 18

# The code points with Unicode's White_Space property.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
)
LETTER, NUMBER, SPACE, OTHER = range(4)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Powers of a fixed odd base modulo 2^64."""
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """64-bit polynomial hashes of consecutive segments of bytes or code points."""

    def __init__(self) -> None:
        self.pow = powers(64)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``values`` (uint64, any mixing) hashed over [start, end); the segments ascend."""
        if len(starts) == 0:
            return np.zeros(0, np.uint64)
        lengths = ends - starts
        longest = int(lengths.max())
        if longest > len(self.pow):
            self.pow = powers(2 * longest)
        at = np.arange(int(lengths.sum()))
        inner = at - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = values[inner + np.repeat(starts, lengths)] * self.pow[inner]
        sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _pieces(body: np.ndarray, offsets: np.ndarray, cut) -> Iterator[tuple[int, int, int, int]]:
    """Whole rows of about ``CHUNK`` bytes as (first row, last row, start, end); a longer row comes
    in several pieces, each ending where ``cut(body, from, to)`` says."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        start = int(offsets[row])
        last = max(row + 1, int(np.searchsorted(offsets, start + CHUNK, side="right")) - 1)
        end = int(offsets[last])
        if last > row + 1 or end - start <= CHUNK:
            yield row, last, start, end
        else:
            while end - start > CHUNK:
                at = cut(body, start + CHUNK, end)
                yield row, last, start, at
                start = at
            if start < end:
                yield row, last, start, end
        row = last


def _gap(body: np.ndarray, at: int, end: int) -> int:
    """The first ASCII white space at or after ``at``."""
    while at < end:
        window = body[at : min(at + 4096, end)]
        found = np.flatnonzero((window == 32) | ((window >= 9) & (window <= 13)))
        if len(found):
            return at + int(found[0])
        at += len(window)
    return end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column, A-Z lower-cased if asked."""

    def __init__(self, lower: bool = True) -> None:
        self.hasher = Hasher()
        self.gap = np.zeros(256, bool)
        self.gap[[9, 10, 11, 12, 13, 32]] = True
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32

    def pieces(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, row of each word from there, folded bytes, starts, ends, places in the row) for
        each piece."""
        body, offsets = flat(column)
        for row, last, start, end in _pieces(body, offsets, _gap):
            text = self.fold[body[start:end]]
            inside = ~self.gap[text]
            edge = inside.copy()
            edge[1:] &= ~inside[:-1]
            bounds = np.clip(offsets[row : last + 1], start, end) - start
            firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
            edge[firsts] = inside[firsts]
            starts = np.flatnonzero(edge)
            heads = np.zeros(len(inside) + 1, bool)
            heads[firsts] = True
            stop = inside.copy()
            stop[:-1] &= ~inside[1:] | heads[1:-1]
            ends = np.flatnonzero(stop) + 1
            of = np.searchsorted(bounds, starts, side="right") - 1
            yield row, of, text, starts, ends, starts + start - offsets[row + of]

    def hashes(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the word offset of every row."""
        rows, out = len(column), []
        counts = np.zeros(rows, np.int64)
        for row, of, text, starts, ends, _ in self.pieces(column):
            out.append(self.hasher(self.hasher.byte[text], starts, ends))
            if len(of):
                part = np.bincount(of)
                counts[row : row + len(part)] += part
        return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


class WordTable:
    """A row of numbers for every word, computed once per distinct word while it is held.

    ``rows(text, starts, ends, hashes)`` gives the rows of new words. At most ``limit`` words are
    carried from one call to the next.
    """

    def __init__(self, rows, lower: bool = True, limit: int = 150_000) -> None:
        self.rows, self.limit = rows, limit
        self.words = Words(lower)
        self.known: dict[int, int] = {}
        self.values: np.ndarray | None = None

    def __call__(self, column):
        """(place of every word in ``values``, word offset of every row, byte start and end in its row)."""
        if len(self.known) > self.limit:
            self.known = {}
        numbers, places, lengths = [], [], []
        counts = np.zeros(len(column), np.int64)
        for row, of, text, starts, ends, place in self.words.pieces(column):
            codes, values = pd.factorize(self.words.hasher(self.words.hasher.byte[text], starts, ends))
            found = np.fromiter((self.known.get(h, -1) for h in values.tolist()), np.int64, len(values))
            new = np.flatnonzero(found < 0)
            if len(new):
                first = np.full(len(values), len(codes))
                np.minimum.at(first, codes, np.arange(len(codes)))
                first = first[new]
                rows = self.rows(text, starts[first], ends[first], values[new])
                at, total = len(self.known), len(self.known) + len(new)
                if self.values is None or len(self.values) < total:
                    grown = np.zeros((max(total, 1 << 16, 2 * at), *rows.shape[1:]), rows.dtype)
                    if at:
                        grown[:at] = self.values[:at]
                    self.values = grown
                self.values[at:total] = rows
                found[new] = np.arange(at, total)
                self.known.update(zip(values[new].tolist(), range(at, total)))
            numbers.append(found[codes])
            places.append(place)
            lengths.append(ends - starts)
            if len(of):
                part = np.bincount(of)
                counts[row : row + len(part)] += part
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place = join(places)
        if self.values is None:
            self.values = self.rows(np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64))
        return join(numbers), np.concatenate([[0], np.cumsum(counts)]), place, place + join(lengths)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values`` between the offsets; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def affix_ids(text, starts, ends, hashes, prefixes, suffixes, bits: int) -> np.ndarray:
    """Hashed feature numbers of words: the word, its prefixes and its suffixes, as rows."""
    hasher, columns = Hasher(), [hashes]
    values = hasher.byte[text]
    for k in prefixes:
        columns.append(hasher(values, starts, np.minimum(ends, starts + k)) + np.uint64(2 * k + 1))
    for k in suffixes:
        columns.append(hasher(values, np.maximum(starts, ends - k), ends) + np.uint64(2 * k))
    out = np.stack(columns, axis=1) if len(hashes) else np.zeros((0, 1 + len(prefixes) + len(suffixes)), np.uint64)
    salt = np.arange(out.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(out + salt) >> np.uint64(64 - bits)).astype(np.int64)


def _letter_gap(body: np.ndarray, at: int, end: int) -> int:
    """The first space between two ASCII letters at or after ``at``: a sure pre-token start."""
    while at < end:
        window = body[at - 1 : min(at + 4096, end - 1) + 1]
        low = window | 32
        letter = (low >= 97) & (low <= 122)
        found = np.flatnonzero((window[1:-1] == 32) & letter[:-2] & letter[2:])
        if len(found):
            return at + int(found[0])
        at += max(len(window) - 2, 1)
    return end


class PreTokens:
    """The matches of the byte-level pattern (contractions, letters, numbers, other signs, each with
    one space before it, and white space), found with array operations."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        kinds = [self._kind(chr(c)) for c in range(0x10000)]
        self.table = np.array(kinds, np.uint8)
        self.table[list(WHITE_SPACE)] = SPACE

    @staticmethod
    def _kind(sign: str) -> int:
        major = unicodedata.category(sign)[0]
        return LETTER if major == "L" else NUMBER if major == "N" else OTHER

    def kinds(self, signs: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(signs, 0xFFFF)]
        far = np.flatnonzero(signs > 0xFFFF)
        if len(far):
            values, inverse = np.unique(signs[far], return_inverse=True)
            out[far] = np.array([self._kind(chr(int(v))) for v in values], np.uint8)[inverse]
        return out

    def split(self, signs: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Start of every pre-token; ``heads`` flags the first code point of each row."""
        n = len(signs)
        if n == 0:
            return np.zeros(0, np.int64)
        kind = self.kinds(signs)
        start = heads.copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        before_word = np.zeros(n, bool)
        before_word[:-1] = space[:-1] & ~space[1:] & ~heads[1:]
        joined = np.zeros(n, bool)
        joined[1:] = (before_word & (signs == 0x20))[:-1]
        start |= before_word
        start &= ~joined
        marks = np.flatnonzero(start & (signs == 0x27))
        if len(marks):
            padded = np.concatenate([signs, [0, 0]])
            apart = np.concatenate([heads, [True, True]])
            one, two = padded[marks + 1], padded[marks + 2]
            here = ~apart[marks + 1]
            short = here & np.isin(one, [ord(c) for c in "stmd"])
            pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
            pair |= (one == ord("l")) & (two == ord("l"))
            pair &= here & ~apart[marks + 2]
            start[marks[short | pair] + 1] = False
            after = np.concatenate([marks[short] + 2, marks[pair] + 3])
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def pieces(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, row of each pre-token from there, bytes, byte starts, byte ends, hashes)."""
        body, offsets = flat(column)
        for row, last, start, end in _pieces(body, offsets, _letter_gap):
            text = body[start:end]
            signs = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((text & 0xC0) != 0x80)
            heads = np.zeros(len(text) + 1, bool)
            bounds = np.clip(offsets[row : last + 1], start, end) - start
            heads[bounds[:-1]] = True
            first = self.split(signs, heads[lead])
            starts = lead[first]
            ends = np.append(starts[1:], len(text)) if len(starts) else starts
            hashes = self.hasher(self.hasher.byte[text], starts, ends)
            yield row, np.searchsorted(bounds, starts, side="right") - 1, text, starts, ends, hashes


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def slices(frame: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about ``limit`` bytes of one text column, one row at least."""
    _, offsets = flat(frame.column(column))
    row = 0
    while row < frame.num_rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield frame.slice(row, last - row)
        row = last


def freed(run):
    """The task function ``run``, whose worker gives freed memory back when a task ends.

    Workers are used again by later stages; what the allocators of Arrow and of the C library keep would else add to
    the executor's memory until then.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
        if trim:
            trim(0)

    return task


def shared(session, value):
    """A broadcast that executors without this package can read: call it in a task for a copy of ``value``.

    A plain broadcast names the class of an object; here the class travels with it, as task functions do.
    """
    import pickle

    from pyspark import cloudpickle

    held = session.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def process_cache(name: str, key: str, make):
    """What ``make()`` gave when a task of this worker process last asked for ``name`` with another key.

    One value per name is held, so a long-lived worker does not gather old ones.
    """
    import sys
    import types

    held = sys.modules.setdefault("_task_values", types.ModuleType("_task_values"))
    if getattr(held, name, (None,))[0] != key:
        setattr(held, name, (key, make()))
    return getattr(held, name)[1]
