"""Toxic spans by a linear-chain conditional random field.

Each word is in one of two states. Its emission score is a sum of hashed weights (the word, its
prefixes and suffixes, the words next to it); a 2 x 2 matrix scores transitions. ``fit`` learns from
labelled documents: a token of a toxic document counts as toxic if one of its features occurs far
more often in toxic than in clean documents, and the weights maximise the conditional likelihood of
these token labels. Forward-backward marginals give each token's probability; a document's score is a
logistic function of their sum and their maximum; consecutive tokens of 0.5 or more are a span.

Forward and backward odds are Moebius maps, so the words of all documents of a slice are cut into
short segments that advance together; one text of any length costs no more steps than many short ones.

Scoring is a map over the documents: no shuffle. The model is a few megabytes, whatever the data.
Fitting takes at most ``per_class`` documents of either label, of at most ``longest`` bytes.

Defined cases: a null or empty text has no token and the score of zero tokens; without any labelled document, or
with one class only, every score is the share of toxic labels (0 without labels); repeated rows score alike;
labels for absent documents and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.labelled import kept_rows, labelled_sample, remainder
from quillvec.llm.textops import WordTable, affix_ids, freed, row_sums, shared, slices

BITS = 18
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)
OWN = 1 + len(PREFIXES) + len(SUFFIXES)
PER_CLASS = 1200
LONGEST = 10_000
SEGMENT = 96
REJECT = 0.7
SLICE = 2 << 20


@dataclass
class Model:
    weights: np.ndarray  # 3 tables: own features, the word before, the word after
    moves: np.ndarray  # transition weights [from, to]
    start: float
    score: np.ndarray  # logistic weights of (1, log1p(sum), max)
    prior: float | None = None  # the score of everything, where nothing could be learnt


def word_features(text, starts, ends, hashes) -> np.ndarray:
    return affix_ids(text, starts, ends, hashes, PREFIXES, SUFFIXES, BITS)


def chain(emission: np.ndarray, offsets: np.ndarray, moves: np.ndarray, start: float, pairs: bool = False):
    """Marginals of state 1 for sequences of log-odds between ``offsets``; with ``pairs`` the odds
    of forward and backward messages too."""
    n = len(emission)
    t00, t01, t10, t11 = np.exp(moves).ravel()
    e = np.exp(np.clip(emission, -30, 30))
    sizes = np.diff(offsets)
    cuts = -(-sizes // SEGMENT)
    number = int(cuts.sum())
    row = np.repeat(np.arange(len(sizes)), cuts)
    rank = np.arange(number) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = offsets[:-1][row] + rank * SEGMENT
    length = np.minimum(SEGMENT, offsets[1:][row] - begin)
    order = np.argsort(-length, kind="stable")  # the segments still running are always the first ones
    begin, length = begin[order], length[order]
    where = np.empty(number, np.int64)
    where[order] = np.arange(number)
    live = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # segments longer than t
    before = (rank == 0)[order]

    # The map of each segment: odds after its last word from the odds before its first one. The first
    # word of a sequence has no transition: its odds are start * e.
    p, q, r, s = np.ones(number), np.zeros(number), np.zeros(number), np.ones(number)
    for t in range(SEGMENT):
        k = int(live[t])
        if not k:
            break
        x = e[begin[:k] + t]
        p2, q2 = x * (t11 * p[:k] + t01 * r[:k]), x * (t11 * q[:k] + t01 * s[:k])
        r2, s2 = t10 * p[:k] + t00 * r[:k], t10 * q[:k] + t00 * s[:k]
        if t == 0:
            f = before[:k]
            p2, q2, r2, s2 = (np.where(f, a, b) for a, b in ((x, p2), (0, q2), (0, r2), (1, s2)))
        top = np.maximum(np.maximum(p2, q2), np.maximum(r2, s2))
        p[:k], q[:k], r[:k], s[:k] = p2 / top, q2 / top, r2 / top, s2 / top

    # Odds before each segment, from segment to segment of the long sequences; and odds of the
    # backward message after each segment.
    entry, exit_ = np.full(number, np.exp(start)), np.ones(number)
    deepest = int(rank.max()) if number else 0
    by_rank = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[by_rank], np.arange(deepest + 2))
    for d in range(1, deepest + 1):
        now = by_rank[edges[d] : edges[d + 1]]
        at, to = where[now - 1], where[now]
        entry[to] = (p[at] * entry[at] + q[at]) / (r[at] * entry[at] + s[at])
    for d in range(deepest, 0, -1):
        now = by_rank[edges[d] : edges[d + 1]]
        at, to = where[now], where[now - 1]
        # A backward vector passes the transposed map.
        exit_[to] = (p[at] * exit_[at] + r[at]) / (q[at] * exit_[at] + s[at])

    forward, backward = np.empty(n), np.empty(n)
    a = entry.copy()
    for t in range(SEGMENT):
        k = int(live[t])
        if not k:
            break
        x = e[begin[:k] + t]
        moved = (a[:k] * t11 + t01) / (a[:k] * t10 + t00)
        if t == 0:
            moved = np.where(before[:k], a[:k], moved)
        a[:k] = x * moved
        forward[begin[:k] + t] = a[:k]
    b = exit_.copy()
    for t in range(SEGMENT - 1, -1, -1):
        k = int(live[t])
        if not k:
            continue
        at = begin[:k] + t
        backward[at] = b[:k]
        x = e[at] * b[:k]
        b[:k] = (t11 * x + t10) / (t01 * x + t00)
    odds = np.minimum(forward * backward, 1e12)
    marginal = odds / (1 + odds)
    return (marginal, forward, backward, e) if pairs else marginal


def emissions(own: np.ndarray, left: np.ndarray, right: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Own score plus what the words before and after say."""
    out = own.astype(np.float64)
    if len(out) > 1:
        inner = np.ones(len(out), bool)
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        inner[firsts] = False  # a first word has none before it
        at = np.flatnonzero(inner)
        out[at] += left[at - 1]
        out[at - 1] += right[at]
    return out


def fit(texts: pa.Table, rounds: int = 60, rate: float = 0.4, penalty: float = 2e-5) -> Model:
    """A model from ``(text, y)`` rows; runs on the driver over a bounded sample."""
    y = texts.column("y").to_numpy().astype(int)
    size = 1 << BITS
    zero = Model(np.zeros((3, size), np.float32), np.zeros((2, 2)), 0.0, np.zeros(3), float(y.mean()) if len(y) else 0.0)
    if len(set(y.tolist())) < 2:
        return zero
    table = WordTable(word_features, limit=10**9)
    words, offsets, _, _ = table(texts.column("text"))
    features = table.values[: len(table.known)]
    docs = np.repeat(np.arange(len(y)), np.diff(offsets))

    # Features of toxic documents: how many documents of either label have them.
    once = np.unique(docs * len(features) + words)
    owner, word = once // len(features), once % len(features)
    a, b = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for column in features.T:  # the kinds of features have ids of their own
        pairs = np.unique(owner * size + column[word])
        toxic = y[pairs // size] == 1
        a += np.bincount(pairs[toxic] % size, minlength=size)
        b += np.bincount(pairs[~toxic] % size, minlength=size)
    del once, owner, word, pairs, toxic
    share = ((a + 0.5) / (y.sum() + 1)) / ((b + 0.5) / ((1 - y).sum() + 1))
    marked = (a >= max(4, 0.008 * y.sum())) & (share >= 12)
    token = marked[features].any(axis=1)[words] & (y[docs] == 1)
    target = token.astype(float)

    # Adam on the conditional log-likelihood.
    first = np.zeros(len(words), bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    after = np.flatnonzero(~first)
    theta = np.zeros((3, size))
    moves, start = np.zeros(3), np.array([-3.0])  # (0,1), (1,0), (1,1); (0,0) is fixed at 0
    state = [np.zeros_like(x) for x in (theta, moves, start)], [np.zeros_like(x) for x in (theta, moves, start)]
    both = target[after - 1] * target[after]
    seen = np.array([(target[after]).sum() - both.sum(), target[after - 1].sum() - both.sum(), both.sum()])
    n = len(words)
    for step in range(1, rounds + 1):
        own = theta[0][features].sum(axis=1)[words]
        left, right = theta[1][features[:, 0]][words], theta[2][features[:, 0]][words]
        t = np.array([[0.0, moves[0]], [moves[1], moves[2]]])
        marginal, forward, backward, e = chain(emissions(own, left, right, offsets), offsets, t, float(start[0]), True)
        x = e[after] * backward[after]
        f = forward[after - 1]
        w = np.stack([np.ones(len(after)), np.exp(t[0, 1]) * x, f * np.exp(t[1, 0]), f * np.exp(t[1, 1]) * x])
        w = w[1:] / w.sum(axis=0)
        g = marginal - target
        per_word = np.bincount(words, weights=g, minlength=len(features))
        g_left = np.bincount(words[after - 1], weights=g[after], minlength=len(features))
        g_right = np.bincount(words[after], weights=g[after - 1], minlength=len(features))
        grad = np.stack(
            [
                np.bincount(features.ravel(), weights=np.repeat(per_word, OWN), minlength=size),
                np.bincount(features[:, 0], weights=g_left, minlength=size),
                np.bincount(features[:, 0], weights=g_right, minlength=size),
            ]
        )
        grads = (grad / n + penalty * theta, (w.sum(axis=1) - seen) / n, np.array([g[first].sum() / n]))
        for k, (value, slope) in enumerate(zip((theta, moves, start), grads)):
            state[0][k] = 0.8 * state[0][k] + 0.2 * slope
            state[1][k] = 0.95 * state[1][k] + 0.05 * slope * slope
            value -= rate * (state[0][k] / (1 - 0.8**step)) / (np.sqrt(state[1][k] / (1 - 0.95**step)) + 1e-9) * (np.abs(slope) > 0)
    t = np.array([[0.0, moves[0]], [moves[1], moves[2]]])
    model = Model(theta.astype(np.float32), t, float(start[0]), np.zeros(3))
    own = theta[0][features].sum(axis=1)[words]
    left, right = theta[1][features[:, 0]][words], theta[2][features[:, 0]][words]
    marginal = chain(emissions(own, left, right, offsets), offsets, t, model.start)
    model.score = _logistic(_summary(marginal, offsets), y)
    return model


def _summary(marginal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(1, log(1 + expected words of spans), greatest marginal) of every document."""
    solid = np.where(marginal < 0.5, 0.0, marginal)
    total = np.log1p(np.maximum(row_sums(solid, offsets), 0))
    most = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        most[full] = np.maximum.reduceat(marginal, offsets[:-1][full])
    return np.stack([np.ones(len(total)), total, most], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Newton's method with equal weight for both classes."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta))
        move = np.linalg.solve(bend, slope)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


class Tagger:
    """Scores of texts under a model; holds the emissions of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model

        def rows(text, starts, ends, hashes):
            ids = word_features(text, starts, ends, hashes)
            own = model.weights[0][ids].sum(axis=1)
            return np.stack([own, model.weights[1][ids[:, 0]], model.weights[2][ids[:, 0]]], axis=1)

        self.table = WordTable(rows)

    def __call__(self, column):
        """(scores, marginals, word offsets, byte starts, byte ends)."""
        words, offsets, starts, ends = self.table(column)
        rows = self.table.values[words]
        emission = emissions(rows[:, 0], rows[:, 1], rows[:, 2], offsets)
        marginal = chain(emission, offsets, self.model.moves, self.model.start)
        if self.model.prior is not None:
            return np.full(len(column), self.model.prior), np.zeros(len(words)), offsets, starts, ends
        score = 1 / (1 + np.exp(-np.clip(_summary(marginal, offsets) @ self.model.score, -30, 30)))
        return score, marginal, offsets, starts, ends


def spans_of(text: str, marginal: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Character ranges of consecutive words of 0.5 or more."""
    hit = np.flatnonzero(marginal >= 0.5)
    if not len(hit):
        return []
    body, out = text.encode(), []
    breaks = np.flatnonzero(np.diff(hit) > 1)
    for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hit) - 1]])):
        start, end = int(starts[hit[a]]), int(ends[hit[b]])
        at = len(body[:start].decode("utf-8", "replace"))
        out.append(
            {"start": at, "end": at + len(body[start:end].decode("utf-8", "replace")), "p": float(marginal[hit[a] : hit[b] + 1].max())}
        )
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", per_class, longest))


def tag(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``docs`` with ``toxic_score`` and, if asked for, ``toxic_spans`` (start, end in characters, p)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = "array<struct<start:int,end:int,p:double>>"
    extra = "toxic_score double, toxic_words int" + (f", toxic_spans {kind}" if spans else "")
    rows = docs.drop("toxic_score", "toxic_words", "toxic_spans")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(extra).fields])
    arrow = to_arrow_schema(schema)
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held())
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                score, marginal, offsets, starts, ends = tagger(part.column("text"))
                hits = row_sums((marginal >= 0.5).astype(float), offsets).round().astype(np.int32)
                columns = [*part.columns, pa.array(score), pa.array(hits)]
                if spans:
                    found = [[] for _ in hits]
                    for k in np.flatnonzero(hits).tolist():
                        mine = slice(int(offsets[k]), int(offsets[k + 1]))
                        found[k] = spans_of(part.column("text")[k].as_py(), marginal[mine], starts[mine], ends[mine])
                    columns.append(pa.array(found, arrow.field("toxic_spans").type))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(freed(run), schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The label rows that a query may learn from."""
    return labels.where(remainder("doc_id", 3) != 1)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = train(docs, learnable(spark.read.parquet(f"{folder}/labels.parquet")))
    tagged = tag(docs, model)
    return tagged.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= REJECT).cast("int").alias("predicted"),
        F.to_json("toxic_spans").alias("spans"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject, with their own columns."""
    labels = learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = train(docs.select("doc_id", "text"), labels)
    names = {"toxic_score", "toxic_words", "toxic_spans"}
    return kept_rows(docs, names, lambda rows: tag(rows, model, spans=False).where(F.col("toxic_score") < REJECT))
