"""Truncation by sub-word tokens against the library itself, chunk by chunk."""

import json
import random
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from quillvec.operators import subwords
from quillvec.operators.subwords import truncate_subwords

TEXTS = ["", None, "one", "def f(x):\n    return x * 2\n" * 20, "naïve 😀😀 " * 60, "a" * 5000, "Wörter und Sätze " * 3]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit, special", [(128, 2), (16, 0), (1, 0)])
def test_equals_the_library(spark, name, limit, special):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, chunk string")
    got = {r.id: r for r in truncate_subwords(docs, path, limit=limit, special=special).collect()}
    plain = Tokenizer.from_file(path)
    for k, text in enumerate(TEXTS):
        if text is None:
            assert (got[k].token_ids, got[k].n_tokens, got[k].kept) == (None, None, None)
            continue
        whole = plain.encode(text, add_special_tokens=False)
        assert got[k].token_ids == whole.ids[: limit - special] and got[k].n_tokens == len(whole.ids)
        assert text.startswith(got[k].kept)
        if len(whole.ids) <= limit - special:
            assert got[k].kept == text
        else:
            again = plain.encode(got[k].kept, add_special_tokens=False).ids
            assert got[k].kept != text or len(again) > limit - special  # a last character in several tokens
            assert again[: limit - special - 3] == whole.ids[: max(limit - special - 3, 0)] or limit < 4


def test_columns_and_empty_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([("x y", "mine", 1)], "chunk string, kept string, other int")
    assert truncate_subwords(docs, path).columns == ["chunk", "other", "token_ids", "n_tokens", "kept"]
    assert truncate_subwords(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        truncate_subwords(docs, path, limit=2, special=2)


BYTES = public_tokenizers.path("byte_bpe_50k.json")
BITS = [
    "a", "word", " ", "  ", "\n", "\n\n", " \n", "\t", "😀", "naïve", "中文", "'s", "'ll", "'", "12", " 3", "!?", "\u00a0", "\u3000", "\x85", "\x1c",
    "\u200b", "👩\u200d👩\u200d👧", "x" * 300, "def f(x):", "\r\n", "½", "\x00", "<|endoftext|>", "\u0378", "\U000105c0", "\U0001e5ff",
]


def by_library(text, keep, plain=Tokenizer.from_file(BYTES)):
    code = plain.encode(text, add_special_tokens=False)
    return code.ids[:keep], len(code.ids), text if len(code.ids) <= keep else text[: code.offsets[keep - 1][1]]


@pytest.mark.parametrize("keep", [1, 2, 3, 7, 126])
def test_ids_counts_and_ends_are_the_library_s(spark, keep):
    rng = random.Random(keep)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.choice((0, 3, 20, 400)))) for _ in range(1300)] + [None, "x y " * 100_000 + "😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, chunk string").coalesce(1)
    got = {r.id: (r.token_ids, r.n_tokens, r.kept) for r in truncate_subwords(docs, BYTES, limit=keep).collect()}
    assert got == {k: (None, None, None) if t is None else by_library(t, keep) for k, t in enumerate(texts)}


def test_a_pretoken_is_encoded_once():
    rng = random.Random(1)
    plain = [b for b in BITS if b.isascii() and "<" not in b]
    texts = ["".join(rng.choice(plain) for _ in range(400)) for _ in range(60)]
    words = subwords.Words(open(BYTES, encoding="utf-8").read())
    assert not words.marked(pa.array(texts)).any()
    ids, counts, kept = words.cut(pa.array(texts), 126)
    assert list(zip(ids.to_pylist(), counts.to_pylist(), kept.to_pylist())) == [by_library(t, 126) for t in texts]
    learned, used = words.known.count, words.used
    assert learned < sum(counts.to_pylist()) / 10
    words.cut(pa.array(texts[::-1]), 7)
    assert (words.known.count, words.used) == (learned, used)


def test_only_tokenizers_of_bytes_go_by_words():
    rules = json.load(open(BYTES, encoding="utf-8"))
    assert subwords.splits_bytes(rules)
    assert not subwords.splits_bytes(json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8")))
    assert not subwords.splits_bytes(rules | {"normalizer": {"type": "NFC"}})
    assert not subwords.splits_bytes(rules | {"pre_tokenizer": rules["pre_tokenizer"] | {"add_prefix_space": True}})
    assert not subwords.splits_bytes(rules | {"model": rules["model"] | {"dropout": 0.1}})


def test_every_known_character_has_the_library_s_kind():
    words, split = subwords.Words(open(BYTES, encoding="utf-8").read()), ByteLevel(add_prefix_space=False, use_regex=True)
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    kinds = words.splitter.kinds(np.array([ord(c) for c in known], np.uint32)).tolist()
    for c, kind in zip(known, kinds):
        joins = [len(split.pre_tokenize_str(sign + c)) == 1 for sign in "a1."]
        assert joins == [kind == k for k in (0, 1, 3)], hex(ord(c))
