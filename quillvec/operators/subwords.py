"""Truncation of chunks by the sub-word tokens of an encoder.

A byte-level tokenizer splits a text into pre-tokens and never merges across their borders. Texts for such a one are split
with array operations, and each distinct pre-token is encoded by the library once while a worker's cache holds it. A text that
spells an added token or has a character that Python does not know yet, and every text for a tokenizer of another kind, is given
to the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillvec.operators.chunking import MAX_TOKENS

try:
    from quillvec.llm.textops import flat, process_cache, runs
    from quillvec.llm.tokens_bitplane import WordIds
except ImportError:  # the llm folders may be absent: the library encodes all texts
    WordIds = None

_ROWS = 512  # chunks that are encoded at once
_ADDED = ("token_ids", "n_tokens", "kept")
_KINDS = (pa.list_(pa.int32()), pa.int32(), pa.string())


def truncate_subwords(
    df: DataFrame, tokenizer: str, text: str = "chunk", limit: int = MAX_TOKENS, special: int = 0
) -> DataFrame:
    """Adds ``token_ids``, the first ``limit - special`` sub-word ids, ``n_tokens`` of the whole text, and ``kept``, the part
    of the text that the ids stand for.

    ``tokenizer`` is the path of a tokenizers JSON file; it is read once, on the driver, and sent to the tasks. ``special`` is the
    number of places that the encoder fills with signs of its own. The rows are mapped where they lie.

    A null text has nulls, an empty one no ids. If the last id stands for a part of a character only, ``kept`` has the whole
    character. Columns called like the added ones are replaced.
    """
    keep = limit - special
    if keep < 1:
        raise ValueError("limit must leave room for a token")
    with open(tokenizer, encoding="utf-8") as file:
        read = file.read()
    rules, key = df.sparkSession.sparkContext.broadcast(read), hashlib.sha256(read.encode()).hexdigest()
    by_word = WordIds is not None and splits_bytes(json.loads(read))
    fields = [field for field in df.schema.fields if field.name not in _ADDED]
    ids, count, kept = T.ArrayType(T.IntegerType()), T.IntegerType(), T.StringType()
    schema = T.StructType(fields + [T.StructField(name, kind) for name, kind in zip(_ADDED, (ids, count, kept))])
    names = [field.name for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        words = process_cache("subwords", key, lambda: Words(rules.value)) if by_word else None
        encoder = Tokenizer.from_str(rules.value)
        encoder.no_truncation()
        encoder.no_padding()

        def whole(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part[text].to_pylist()
            codes = iter(encoder.encode_batch([t for t in texts if t is not None], add_special_tokens=False))
            rows = [(None, None, None) if t is None else cut(t, next(codes)) for t in texts]
            return added(part, [pa.array(values, kind) for values, kind in zip(zip(*rows), _KINDS)])

        def added(part: pa.RecordBatch, columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part[n] for n in names] + columns, names=[*names, *_ADDED])

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                if words is None:
                    yield whole(part)
                    continue
                marked = words.marked(part[text])
                if marked.any():
                    yield whole(part.filter(pa.array(marked)))
                    part = part.filter(pa.array(~marked))
                if part.num_rows:
                    yield added(part, words.cut(part[text], keep))

    def cut(whole: str, code) -> tuple[list[int], int, str]:
        found = code.ids
        if len(found) <= keep:
            return found, len(found), whole
        return found[:keep], len(found), whole[: code.token_to_chars(keep - 1)[1]]

    return df.mapInArrow(run, schema)


def splits_bytes(rules: dict) -> bool:
    """Whether a tokenizer encodes the pre-tokens of the byte-level pattern, byte for byte and each by itself."""
    before, model = rules.get("pre_tokenizer") or {}, rules["model"]
    plain = not any(rules.get(step) for step in ("normalizer", "post_processor"))
    plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    plain &= model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return bool(plain) and _signs() <= set(model["vocab"])


def _signs() -> set[str]:
    """The 256 characters that stand for bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    return set(ByteLevel.alphabet())


if WordIds is not None:

    class Words(WordIds):
        """First ids of texts, from ids of their pre-tokens."""

        def __init__(self, rules: str) -> None:
            super().__init__(None, rules)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: each of its signs is one
            self.lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]

            self.unknown = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])

        def marked(self, column: pa.Array) -> np.ndarray:
            """Also the rows with a character that the library's Unicode tables may have and Python's have not."""
            marked = super().marked(column)
            body, offsets = flat(column)
            if len(body) and body.max() >= 0xCD:  # U+0378 is the first unassigned one
                signs = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                far = np.flatnonzero(self.unknown[signs])
                if len(far):
                    lead = np.flatnonzero((body & 0xC0) != 0x80)
                    marked[np.searchsorted(offsets, lead[far], side="right") - 1] = True
            return marked

        def cut(self, column: pa.Array, keep: int) -> list[pa.Array]:
            """The added columns of texts that are not marked."""
            body, offsets = flat(column)
            whole = body.tobytes()
            whole.decode("utf-8")  # what is not UTF-8 is an error
            counts, ends, out, base = np.zeros(len(column), np.int64), offsets[1:].copy(), [], 0
            for row, of, text, starts, _, word in self.words(column):
                if len(word):
                    sizes = self.sizes[word]
                    total = np.cumsum(sizes)
                    first = np.searchsorted(of, of)  # first pre-token of the row in this piece
                    before = counts[row + of] + total - sizes - (total - sizes)[first]
                    room = keep - before
                    out.append(self.ids[runs(self.starts[word], np.clip(room, 0, sizes))])
                    last = np.flatnonzero((room > 0) & (room <= sizes))
                    if len(last):
                        taken = room[last]
                        lengths = self.lengths[self.ids[runs(self.starts[word[last]], taken)]]
                        end = starts[last] + np.add.reduceat(lengths, np.cumsum(taken) - taken)
                        for _ in range(3):  # to the end of a character
                            inside = end < len(text)
                            inside[inside] = (text[end[inside]] & 0xC0) == 0x80
                            end += inside
                        ends[row + of[last]] = base + end
                    part = np.bincount(of, weights=sizes).astype(np.int64)
                    counts[row : row + len(part)] += part
                base += len(text)
            null = column.is_null()
            ids = pa.array(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32))
            places = np.concatenate([[0], np.cumsum(np.minimum(counts, keep))]).astype(np.int32)
            missing = null.to_numpy(zero_copy_only=False)
            kept = [None if gone else whole[a:b] for gone, a, b in zip(missing, offsets.tolist(), ends.tolist())]
            return [
                pa.ListArray.from_arrays(pa.array(places), ids, mask=null),
                pa.array(counts.astype(np.int32), mask=missing),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]
