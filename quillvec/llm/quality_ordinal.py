"""Quality by cumulative-link regression on graded ratings.

    P(grade <= g) = logistic(cut_g - w . x)

All grades share the weights ``w`` over hashed text features; the cuts ascend. ``x`` holds the shares of a
document's words with each hashed feature (the word as written, its prefixes and suffixes) and a few measures of
the whole text (share of distinct words, of signs, of capitals, word length). The expected
grade and the tail probability P(grade >= ``at_least``) select documents.

Scoring is a map over the documents with a model of fixed size. Fitting takes at most ``PER_GRADE``
documents of each grade, of at most ``LONGEST`` bytes.

Defined cases: a null or empty text has no word, all measures 0; without labels every document has
the lowest grade, 0, and tail probability 0; with one grade all have that grade; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.labelled import labelled_sample, remainder
from quillvec.llm.textops import WordTable, affix_ids, row_sums, shared, slices

BITS = 16
PREFIXES, SUFFIXES = (1, 2, 3), (1, 2, 3)
PER_GRADE = 2000
LONGEST = 10_000
MEASURES = 7
SELECT = 0.5
SLICE = 2 << 20


@dataclass
class Model:
    weights: np.ndarray  # hashed features
    measures: np.ndarray
    centre: np.ndarray  # mean and spread of the measures
    spread: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray


def word_rows(text, starts, ends, hashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, and their letters, capitals, signs and length in bytes."""
    ids = affix_ids(text, starts, ends, hashes, PREFIXES, SUFFIXES, BITS)
    capital = (text >= 65) & (text <= 90)
    letter = capital | ((text >= 97) & (text <= 122)) | (text >= 128)
    digit = (text >= 48) & (text <= 57)
    totals = [np.concatenate([[0], np.cumsum(x)]) for x in (capital, ~(letter | digit))]
    shape = np.stack([t[ends] - t[starts] for t in totals] + [ends - starts], axis=1) if len(starts) else np.zeros((0, 3))
    return ids, shape


def measures(words: np.ndarray, offsets: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """(distinct words, capitals, signs, word length, share of the commonest word, log size, repeats of the word
    before) per document."""
    n = np.diff(offsets)
    docs = np.repeat(np.arange(len(n)), n)
    top = int(words.max()) + 1 if len(words) else 1
    pairs, counts = np.unique(docs * top + words, return_counts=True)
    distinct = np.bincount(pairs // top, minlength=len(n))
    commonest = np.zeros(len(n))
    np.maximum.at(commonest, pairs // top, counts)
    size = np.maximum(n, 1)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])
    repeats = row_sums(again, offsets)
    sums = row_sums(shape, offsets)
    length = np.maximum(sums[:, 2], 1)
    return np.stack(
        [distinct / size, sums[:, 0] / length, sums[:, 1] / length, sums[:, 2] / size / 10, commonest / size, np.log1p(n) / 10, repeats / size],
        axis=1,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: pa.Table, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-5) -> Model:
    """A model from ``(text, y)`` rows; runs on the driver over a bounded sample."""
    labels = texts.column("y").to_numpy().astype(int)
    grades, y = np.unique(labels, return_inverse=True)
    size, k = 1 << BITS, len(grades)
    model = Model(np.zeros(size), np.zeros(MEASURES), np.zeros(MEASURES), np.ones(MEASURES), np.zeros(max(k - 1, 0)), grades)
    if k < 2:
        return model
    shapes: list[np.ndarray] = []

    def rows(text, starts, ends, hashes):
        ids, shape = word_rows(text, starts, ends, hashes)
        shapes.append(shape)
        return ids

    table = WordTable(rows, lower=False, limit=10**9)
    words, offsets, _, _ = table(texts.column("text"))
    features, shape = table.values[: len(table.known)], np.concatenate(shapes)
    extra = measures(words, offsets, shape[words])
    model.centre, model.spread = extra.mean(axis=0), extra.std(axis=0) + 1e-9
    extra = (extra - model.centre) / model.spread
    n = np.maximum(np.diff(offsets), 1)
    docs = np.repeat(np.arange(len(y)), np.diff(offsets))
    # Distinct (document, word) pairs with their share of the document.
    pairs, counts = np.unique(docs * len(features) + words, return_counts=True)
    doc, word = pairs // len(features), pairs % len(features)
    share = 10 * counts / n[doc]

    # Parameters: weights, measures, first cut, logs of the steps between cuts.
    theta = [np.zeros(size), np.zeros(MEASURES), np.linspace(-1, 1, k - 1)[:1], np.zeros(k - 2)]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    weight = (len(y) / k / np.bincount(y, minlength=k))[y]
    for step in range(1, rounds + 1):
        cuts = np.concatenate([theta[2], theta[2] + np.cumsum(np.exp(theta[3]))])
        z = np.bincount(doc, weights=share * theta[0][features].sum(axis=1)[word], minlength=len(y)) + extra @ theta[1]
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = np.where(y == k - 1, 1.0, _sigmoid(edges[y + 1] - z))
        lower = np.where(y == 0, 0.0, _sigmoid(edges[y] - z))
        # d(-log p)/dz = 1 - upper - lower for logistic links
        g = weight * (1 - upper - lower)
        inside = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        per_cut = np.array(
            [-(weight * du)[y == j].sum() + (weight * dl)[y == j + 1].sum() for j in range(k - 1)]
        )
        per_word = np.bincount(word, weights=share * g[doc], minlength=len(features))
        slopes = [
            np.bincount(features.ravel(), weights=np.repeat(per_word, features.shape[1]), minlength=size) / len(y) + penalty * theta[0],
            extra.T @ g / len(y) + penalty * theta[1],
            per_cut.sum(keepdims=True) / len(y),
            np.array([per_cut[j + 1 :].sum() * np.exp(theta[3][j]) for j in range(k - 2)]) / len(y),
        ]
        for j, slope in enumerate(slopes):
            first[j] = 0.8 * first[j] + 0.2 * slope
            second[j] = 0.95 * second[j] + 0.05 * slope * slope
            theta[j] = theta[j] - rate * (first[j] / (1 - 0.8**step)) / (np.sqrt(second[j] / (1 - 0.95**step)) + 1e-8)
    model.weights, model.measures = theta[0], theta[1]
    model.cuts = np.concatenate([theta[2], theta[2] + np.cumsum(np.exp(theta[3]))])
    return model


class Scorer:
    """(expected grade, tail probability) of texts under a model."""

    def __init__(self, model: Model, at_least: int) -> None:
        self.model, self.at_least = model, at_least

        def rows(text, starts, ends, hashes):
            ids, shape = word_rows(text, starts, ends, hashes)
            return np.concatenate([model.weights[ids].sum(axis=1)[:, None], shape], axis=1)

        self.table = WordTable(rows, lower=False)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        if len(model.grades) < 2:
            grade = float(model.grades[0]) if len(model.grades) else 0.0
            tail = float(len(model.grades) and grade >= self.at_least)
            return np.full(len(column), grade), np.full(len(column), tail)
        words, offsets, _, _ = self.table(column)
        rows = self.table.values[words]
        extra = (measures(words, offsets, rows[:, 1:]) - model.centre) / model.spread
        z = 10 * row_sums(rows[:, 0], offsets) / np.maximum(np.diff(offsets), 1) + extra @ model.measures
        below = np.concatenate([np.zeros((len(z), 1)), _sigmoid(model.cuts[None, :] - z[:, None]), np.ones((len(z), 1))], axis=1)
        p = np.diff(below, axis=1)
        return p @ model.grades.astype(float), p[:, model.grades >= self.at_least].sum(axis=1)


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", per_grade: int = PER_GRADE, longest: int = LONGEST) -> Model:
    return fit(labelled_sample(docs, ratings, grade, per_grade, longest))


def score(docs: DataFrame, model: Model, at_least: int = 1) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability``, the chance of ``at_least``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.drop("expected_grade", "tail_probability")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("expected_grade double, tail_probability double").fields])
    arrow = to_arrow_schema(schema)
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held(), at_least)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                columns = [*part.columns, *map(pa.array, scorer(part.column("text")))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(remainder("doc_id", 3) != 1)
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= SELECT).cast("int").alias("selected"),
    )
