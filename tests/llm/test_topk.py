import numpy as np
import pytest

from tidewatch.llm import topk_search


def brute(vectors, queries, k):
    out = []
    for q in sorted(queries):
        scored = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def cell(data, ids, k, **counted):
    q, x = topk_search.Block(ids[::50], data[::50]), topk_search.Block(ids, data)
    best = topk_search.search_cell(q, x, k, topk_search.seed(q, x, k), **counted)
    return [(int(i), int(v), int(s)) for i, known, found, scores in zip(q.ids, best.known, best.ids, best.scores, strict=True) for v, s in zip(found[known], scores[known], strict=True)]


@pytest.mark.parametrize("spread", [3, 200, 1 << 28])
def test_cells_find_the_best(spread, monkeypatch):
    monkeypatch.setattr(topk_search, "STRIPE", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    rng = np.random.default_rng(spread)
    data = rng.integers(-spread, spread, (700, 64))
    data[100:300] = data[50]  # ties
    assert cell(data, np.arange(700), 5) == [(q, i, s) for q, _, i, s in brute(dict(enumerate(data)), range(0, 700, 50), 5)]


def test_bounds_leave_few_pairs_to_score():
    """In groups of like vectors, less than a tenth of all pairs is scored, and no hit is lost."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (40, 16)).repeat(4, axis=1)
    data = centres[rng.integers(0, 40, 6000)] + rng.integers(-60, 60, (6000, 64))
    scored = [0]
    got = cell(data, np.arange(6000), 5, counter=scored)
    assert scored[0] < 0.1 * 120 * 6000
    assert got == [(q, i, s) for q, _, i, s in brute(dict(enumerate(data)), range(0, 6000, 50), 5)]


def test_every_row_counts(spark):
    """Rows that repeat an id each have their score, as in SQL."""
    table = spark.createDataFrame([(0, [1.0, 0.0]), (7, [5.0, 0.0]), (7, [9.0, 0.0]), (8, [1.0, 0.0])], "vec_id long, embedding array<double>")
    vectors = topk_search.integer_vectors(table)
    got = [tuple(r) for r in topk_search.top_k(vectors, vectors.filter("id % 50 = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 256 * 256 * 9), (0, 2, 7, 256 * 256 * 5), (0, 3, 8, 256 * 256)]


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 40 * 64)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(210)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1050, [0.5] * 3)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, score int")
    vectors = topk_search.integer_vectors(table)
    got = sorted(tuple(r) for r in topk_search.top_k(vectors, vectors.filter("id % 50 = 0"), 5).collect())
    kept = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    assert got == sorted(brute(kept, [i for i in kept if i % 50 == 0], 5))
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0
