"""The block kernel against plain NumPy, without Spark."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillvec.operators import blockscan
from quillvec.operators.blockscan import BlockTopK, exact_keys
from quillvec.operators.ivf import best_rows
from quillvec.sources.randoms import normal_matrix


def brute(queries, vectors, ids, k, metric, allowed):
    out = []
    for q in range(len(queries)):
        some = np.flatnonzero(allowed[q])
        keys = exact_keys(queries, np.full(len(some), q), vectors, some, metric)
        order = np.lexsort((ids[some], -keys))[:k]
        out += [(q, int(ids[some[i]]), float(keys[i])) for i in order]
    return out


def found(best):
    return list(zip(best.best_q.tolist(), best.best_id.tolist(), best.best_key.tolist()))


@settings(max_examples=150, deadline=None)
@given(
    seed=st.integers(0, 10**6),
    n=st.integers(1, 60),
    nq=st.integers(1, 5),
    dim=st.integers(1, 9),
    k=st.integers(1, 12),
    metric=st.sampled_from(["ip", "l2"]),
    scale=st.sampled_from([1e-30, 1e-18, 1e-6, 1.0, 1e3, 1e19]),
    whole=st.booleans(),
    blocks=st.integers(1, 4),
)
def test_any_split_gives_the_exact_answer(seed, n, nq, dim, k, metric, scale, whole, blocks):
    rng = np.random.default_rng(seed)
    draw = (lambda s: rng.integers(-2, 3, s)) if whole else rng.standard_normal  # whole numbers tie often
    vectors = (draw((n, dim)) * scale).astype(np.float32)
    queries = (draw((nq, dim)) * rng.choice([scale, 1.0, 1 / scale])).astype(np.float64)
    ids = rng.permutation(n).astype(np.int64) * 3
    best = BlockTopK(np.arange(nq), queries, k, metric)
    for part in np.array_split(np.arange(n), blocks):
        best.add(ids[part], vectors[part])
    assert found(best) == brute(queries, vectors, ids, k, metric, np.ones((nq, n), bool))


@settings(max_examples=100, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 50), k=st.integers(1, 8), parts=st.integers(1, 6), metric=st.sampled_from(["ip", "l2"]))
def test_overlapping_groups_count_a_pair_once(seed, n, k, parts, metric):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 3, (n, 4)).astype(np.float32)
    queries = rng.integers(-2, 3, (4, 4)).astype(np.float64)
    ids = np.arange(n, dtype=np.int64)
    best = BlockTopK(np.arange(4), queries, k, metric)
    allowed = np.zeros((4, n), bool)
    for rows in np.array_split(np.arange(n), 2):
        groups = []
        for _ in range(parts):
            q, v = np.flatnonzero(rng.random(4) < 0.6), np.flatnonzero(rng.random(len(rows)) < 0.6)
            if len(q) and len(v):
                groups.append((q, v))
                allowed[np.ix_(q, rows[v])] = True
        if groups:
            best.add(ids[rows], vectors[rows], groups)
    assert found(best) == brute(queries, vectors, ids, k, metric, allowed)


def close_clusters(rng, n, dim, spread):
    """Far apart clusters whose vectors lie nearer to each other than single precision can tell."""
    label = rng.integers(0, 4, n)
    return label, 30.0 * rng.standard_normal((4, dim))[label] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("rows", [60, 4000])  # of a group: fewer than single precision leaves anyway, or all
def test_close_vectors_of_far_clusters_fill_no_memory(grouped, rows):
    rng = np.random.default_rng(3)
    label, vectors = close_clusters(rng, 4000, 16, 0.001)
    ids, k = rng.permutation(4000).astype(np.int64), 20
    queries, of = vectors[:2000], label[:2000]
    groups = [(np.flatnonzero(of == c), some) for c in range(4) for some in np.array_split(np.flatnonzero(label == c), max(1, 1000 // rows))]
    best = BlockTopK(np.arange(2000), queries, k, "l2")
    tracemalloc.start()
    best.add(ids, vectors, groups if grouped else None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = np.arange(0, 2000, 100)
    want = brute(queries[some], vectors, ids, k, "l2", label[None, :] == of[some, None] if grouped else np.ones((20, 4000), bool))
    assert [(some[q], i, key) for q, i, key in want] == [x for x in found(best) if x[0] % 100 == 0]
    assert peak < 48 << 20


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_cut_candidates_give_the_exact_answer(monkeypatch, metric):
    monkeypatch.setattr(blockscan, "_PAIRS", 16)
    monkeypatch.setattr(blockscan, "_QUERY_BLOCK", 3)
    for seed in range(150):
        rng = np.random.default_rng(seed)
        n, nq, k = rng.integers(1, 80), rng.integers(1, 9), int(rng.integers(1, 6))
        vectors = close_clusters(rng, n, 3, rng.choice([0.0, 1e-4, 1.0]))[1]
        queries = close_clusters(rng, nq, 3, 1.0)[1] if seed % 2 else vectors[rng.integers(0, n, nq)]
        ids, allowed = rng.integers(0, 200, n), np.zeros((nq, n), bool)
        best = BlockTopK(np.arange(nq), queries, k, metric)
        for rows in np.array_split(np.arange(n), 2):
            groups = [(np.flatnonzero(rng.random(nq) < 0.7), np.flatnonzero(rng.random(len(rows)) < 0.7)) for _ in range(4)]
            groups = [(q, v) for q, v in groups if len(q) and len(v)] if seed % 3 else None
            if groups is None:
                allowed[:, rows] = True
            for q, v in groups or []:
                allowed[np.ix_(q, rows[v])] = True
            if groups is None or groups:
                best.add(ids[rows], vectors[rows], groups)
        assert found(best) == brute(queries, vectors, ids, k, metric, allowed)


@settings(max_examples=100, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 30), cells=st.integers(1, 9))
def test_best_cell_is_the_first_of_the_exact_maxima(seed, n, cells):
    rng = np.random.default_rng(seed)
    vectors, centroids = rng.standard_normal((n, 6)).astype(np.float32), rng.standard_normal((cells, 6))
    centroids[rng.integers(0, cells)] = centroids[0]
    for row, cell in enumerate(best_rows(vectors, centroids)):
        keys = exact_keys(vectors.astype(np.float64), np.full(cells, row), centroids, np.arange(cells), "ip")
        assert cell == keys.argmax()


@settings(max_examples=50, deadline=None)
@given(ids=st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20), dim=st.integers(1, 40), seed=st.integers(0, 2**63))
def test_a_row_depends_on_its_id_only(ids, dim, seed):
    matrix = normal_matrix(np.array(ids, dtype=np.int64), dim, seed, 0)
    assert np.isfinite(matrix).all() and matrix.shape == (len(ids), dim)
    for i, row in zip(ids, matrix):
        assert np.array_equal(row, normal_matrix(np.array([i], dtype=np.int64), dim, seed, 0)[0])
