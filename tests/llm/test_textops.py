"""Array helpers against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import regex

from quillvec.llm import textops

ALPHABET = ["'s", "'ll", "'re", " ", "  ", "\n", "\t", "a", "Zé", "1", "٣", "!", "'", "''", "\u00a0", "日本", "😀", "x", "ve", "'d", "²", "\u3000", "é"]


def texts(n=800, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None, " ", "\n\n", "'", "a" * 3000]


@pytest.mark.parametrize("chunk", [1 << 18, 64])
def test_pre_tokens(monkeypatch, chunk):
    monkeypatch.setattr(textops, "CHUNK", chunk)
    rows = texts()
    found = [[] for _ in rows]
    for row, of, text, starts, ends, _ in textops.PreTokens().pieces(pa.array(rows)):
        body = text.tobytes()
        for o, a, b in zip(of, starts, ends):
            found[row + o].append(body[a:b].decode())
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert found == [pattern.findall(t or "") for t in rows]


@pytest.mark.parametrize("chunk", [1 << 18, 64])
def test_words(monkeypatch, chunk):
    monkeypatch.setattr(textops, "CHUNK", chunk)
    rows = texts(seed=2)
    found = [[] for _ in rows]
    for row, of, text, starts, ends, place in textops.Words().pieces(pa.array(rows)):
        body = text.tobytes()
        for o, a, b, p in zip(of, starts, ends, place):
            found[row + o].append(body[a:b].decode())
            assert rows[row + o].encode()[p : p + b - a].lower() == body[a:b].lower()
    fold = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for t in rows]


def test_equal_words_have_equal_hashes():
    hashes, offsets = textops.Words().hashes(pa.array(["The cat", "cat  the", None, ""]))
    assert offsets.tolist() == [0, 2, 4, 4, 4]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[0] != hashes[1]


def test_word_table_rows_are_those_of_the_word():
    table = textops.WordTable(lambda text, s, e, h: np.stack([e - s, h.astype(np.int64) % 97], axis=1), limit=3)
    for rows in (["aa b ccc", None], ["b dddd", "eeeee aa"], ["aa"]):
        words, offsets, starts, ends = table(pa.array(rows))
        assert table.values[words][:, 0].tolist() == (ends - starts).tolist()
        assert offsets[-1] == len(words)


def test_row_sums_and_runs():
    assert textops.row_sums(np.array([1.0, 2, 4]), np.array([0, 0, 2, 3, 3])).tolist() == [0, 3, 4, 0]
    assert textops.runs(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
