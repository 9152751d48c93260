"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams are the 1 to 4 code points of a word between its two borders, hashed; a gram's weight in a text is its share of
the text's grams times its inverse document frequency. Document frequencies are counted over all
documents that may be learnt from: each task adds up one vector, the vectors are summed in pieces. The classes' weights are
trained with follow-the-regularised-leader (proximal, per-coordinate rates) under an L1 and an L2 penalty on at
most ``PER_LANG`` documents per language, of at most ``LONGEST`` bytes; a language with fewer than ``FEW`` of these is filled up to
``FEW`` with its shortest longer texts, whole; a temperature fitted on documents kept back calibrates the
probabilities.

As a text's score is a mean over its grams, every distinct word needs its grams once. Prediction is a
map over the documents with a model of fixed size.

Defined cases: a text that is null or has no letter is `und` with score 1; without any label
everything is `und` with score 0; with one language everything that has a letter is that language; repeated rows
are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.labelled import kept_rows, remainder
from quillvec.llm.textops import Hasher, WordTable, freed, mix, powers, row_sums, runs, shared, slices

BITS = 17
LENGTHS = (1, 2, 3, 4)
PER_LANG = 1000
LONGEST = 10_000
FEW = 20
MAX_LANGS = 1000
UNKNOWN = "und"
SCALE = 50.0
PIECES = 64
SLICE = 2 << 20


@dataclass
class Model:
    weights: np.ndarray  # [grams, languages], times the inverse document frequency
    bias: np.ndarray
    langs: list[str]
    temperature: float


def grams_of(text, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """(hashed grams of all words, number of grams of each word)."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    # " word" after " word", and a last space: each word has a space on both sides
    body = np.full(int(sizes.sum()) + n + 1, 32, np.uint8)
    at = np.cumsum(sizes + 1) - sizes
    body[runs(at, sizes)] = text[runs(starts, sizes)]
    signs = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    borders = np.flatnonzero(signs == 32)  # words hold no space
    borders = borders[: n + 1]
    values, power = mix(signs + np.uint64(0x51ED270B)), powers(max(LENGTHS))
    out, counts = [], []
    length = np.diff(borders) - 1
    for k in LENGTHS:
        # starts within " word ": k code points, not one border alone
        first = borders[:-1] + (1 if k == 1 else 0)
        number = np.maximum(length + (0 if k == 1 else 3 - k), 0)
        begin = runs(first, number)
        total = np.zeros(len(begin), np.uint64)
        for j in range(k):
            total += values[begin + j] * power[j]
        out.append((mix(total + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        counts.append(number)
    # word by word
    owner = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order], np.sum(counts, axis=0)


class GramTable:
    """The grams of every word met, as ranges of one flat array."""

    def __init__(self, limit: int = 100_000) -> None:
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.table = WordTable(self._rows, limit=limit)

    def _rows(self, text, starts, ends, hashes) -> np.ndarray:
        if not self.table.known:
            self.used = 0
        grams, counts = grams_of(text, starts, ends)
        need = self.used + len(grams)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        self.flat[self.used : need] = grams
        begin = self.used + np.cumsum(counts) - counts
        self.used = need
        return np.stack([begin, counts], axis=1).astype(np.int64).reshape(-1, 2)

    def __call__(self, column):
        words, offsets, _, _ = self.table(column)
        return words, offsets

    def of(self, words: np.ndarray) -> np.ndarray:
        rows = self.table.values[words]
        return self.flat[runs(rows[:, 0], rows[:, 1])]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each gram, documents), over all of ``docs``."""
    width = (1 << BITS) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found, rows = GramTable(), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, offsets = table(part.column("text"))
                rows += part.num_rows
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if b > a:
                        found[np.unique(table.of(np.unique(words[a:b])))] += 1
        yield pa.RecordBatch.from_pydict(
            {
                "piece": pa.array(range(PIECES + 1), pa.int32()),
                "n": pa.array([*(x.tobytes() for x in found.reshape(PIECES, width)), np.array([rows]).tobytes()], pa.binary()),
            }
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist()):
                totals[piece] = totals.get(piece, 0) + np.frombuffer(n, np.int64)
        if totals:
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(list(totals), pa.int32()), "n": pa.array([x.tobytes() for x in totals.values()], pa.binary())}
            )

    kind = "piece int, n binary"
    parts = docs.select("text").mapInArrow(freed(count), kind).repartition(PIECES, "piece").mapInArrow(freed(add), kind).collect()
    sums = {row["piece"]: np.frombuffer(row["n"], np.int64) for row in parts}
    if not sums:
        return np.zeros(1 << BITS, np.int64), 0
    return np.concatenate([sums[k] for k in range(PIECES)]), int(sums[PIECES][0])


def fit(
    texts: pa.Table, frequency: np.ndarray, documents: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, rounds: int = 2
) -> Model:
    """A model from ``(text, lang)`` rows; every fifth row is kept back for the temperature."""
    langs = sorted(set(texts.column("lang").to_pylist()))
    size, k = 1 << BITS, len(langs)
    if k < 2:
        return Model(np.zeros((size, k)), np.zeros(k), langs, 1.0)
    y = np.array([langs.index(x) for x in texts.column("lang").to_pylist()])
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    table = GramTable(limit=10**9)
    words, offsets = table(texts.column("text"))
    rows = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        grams, counts = np.unique(table.of(words[a:b]), return_counts=True)
        rows.append((grams, SCALE * counts * idf[grams] / max(counts.sum(), 1)))
    z, square = np.zeros((size, k)), np.zeros((size, k))
    bias = np.zeros(k)
    order = np.random.default_rng(7).permutation(len(y))
    learn, keep = order[len(order) // 5 :], order[: len(order) // 5]

    def weights(grams):
        zg = z[grams]
        shrunk = np.sign(zg) * np.maximum(np.abs(zg) - l1, 0)
        return -shrunk / ((beta + np.sqrt(square[grams])) / alpha + l2)

    for _ in range(rounds):
        for i in learn.tolist():
            grams, x = rows[i]
            w = weights(grams)
            p = _softmax(x @ w + bias)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            z[grams] += g - (np.sqrt(square[grams] + g * g) - np.sqrt(square[grams])) / alpha * w
            square[grams] += g * g
            bias -= 0.02 * p
    logits = np.stack([rows[i][1] @ weights(rows[i][0]) + bias for i in (keep if len(keep) else learn).tolist()])
    truth = y[keep if len(keep) else learn]
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return Model((weights(np.arange(size)) * idf[:, None] * SCALE).astype(np.float32), bias, langs, float(grid[int(np.argmin(losses))]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Predictor:
    def __init__(self, model: Model) -> None:
        self.model = model

        def rows(text, starts, ends, hashes):
            grams, counts = grams_of(text, starts, ends)
            ends_ = np.cumsum(counts)
            sums = row_sums(model.weights[grams], np.concatenate([[0], ends_])) if len(counts) else np.zeros((0, len(model.langs)))
            return np.concatenate([sums, counts[:, None]], axis=1).astype(np.float32)

        self.table = WordTable(rows)

    def __call__(self, column) -> tuple[list[str], np.ndarray]:
        model = self.model
        texts = column.to_pylist()
        letter = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not model.langs:
            return [UNKNOWN] * len(texts), np.where(letter, 0.0, 1.0)
        words, offsets, _, _ = self.table(column)
        sums = row_sums(self.table.values[words], offsets)
        logits = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias
        p = _softmax(logits / model.temperature)
        best = p.argmax(axis=1)
        names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())]
        return names, np.where(letter, p[np.arange(len(best)), best], 1.0)


def train(docs: DataFrame, per_lang: int = PER_LANG, longest: int = LONGEST, max_langs: int = MAX_LANGS) -> Model:
    """A model from all ``(doc_id, text, lang)`` rows with a language, of which there are at most ``max_langs``."""
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency, documents = document_frequencies(named)
    short = F.octet_length("text") <= longest
    langs = named.groupBy("lang").agg(F.countDistinct(F.when(short & F.col("doc_id").isNotNull(), F.col("doc_id"))))
    langs = dict(map(tuple, langs.limit(max_langs + 1).collect()))
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    fits, chosen = named.where(short), None
    for lang in sorted(langs):
        # only ids are sorted; the texts follow by a join with at most per_lang ids
        some = fits.where((F.col("lang") == lang) & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_lang)
        chosen = some if chosen is None else chosen.unionByName(some)
    few = min(FEW, per_lang)
    longer = None
    for lang in sorted(x for x, n in langs.items() if n < few):
        some = named.where(~short & (F.col("lang") == lang)).select("doc_id", "lang", "text", F.octet_length("text").alias("__size"))
        some = some.orderBy("__size", F.xxhash64("doc_id"), "doc_id").limit(few - langs[lang]).select("text", "lang", "doc_id")
        longer = some if longer is None else longer.unionByName(some)
    if chosen is None:
        return Model(np.zeros((1 << BITS, 0)), np.zeros(0), [], 1.0)
    # one text of each id and language, however many rows it has
    texts = fits.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang")
    texts = texts.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "lang", "doc_id")
    texts = texts if longer is None else texts.unionByName(longer)
    texts = texts.orderBy("doc_id", "lang", "text").drop("doc_id").toArrow()
    return fit(texts, frequency, documents)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.drop("lang_pred", "lang_score")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("lang_pred string, lang_score double").fields])
    arrow = to_arrow_schema(schema)
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(held())
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names, scores = predictor(part.column("text"))
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(freed(run), schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a query may learn from, with only what it may use."""
    return docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    predicted = predict(docs.select("doc_id", "text"), train(learnable(docs)))
    return predicted.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with their own columns; all, if there is no language to learn."""
    model = train(learnable(docs))
    if not model.langs:
        return docs
    return kept_rows(docs, {"lang_pred", "lang_score"}, lambda rows: predict(rows, model).where(F.col("lang_pred") != UNKNOWN))
