import random

import numpy as np
import pytest

from parcelbook.llm import pivot_search, vector_blocks
from parcelbook.llm.hard_negatives import mine
from parcelbook.llm.pivot_search import distances, farthest, nearest, norms, search, upper_bounds
from parcelbook.llm.vector_blocks import first, products

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, score int, v string, key string"


def rows_of(seed, n, dim=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.3, 0.9]) for _ in range(dim)]
        rows.append((i, v, rng.choice([1, 1, 2, 3])))
    rows += [(n + i, list(rows[5][1]), 1 + i % 2) for i in range(60)]  # a group of copies: ties
    rows += [(1000, None, 1), (1001, [None, *[0.1] * 5], 1), (1002, [NAN] * 6, 1), (1003, [INF] * 6, 2), (1004, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    rows += [(10, list(rows[10][1]), rows[10][2])] * 3  # repeated rows
    rows += [(1010, [], 1), (1011, [0.9] * 3, 2), (1020, [0.9] * 9, 1)]  # lengths differ
    return rows


def whole(rows, labelled=True):
    out = {}
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        out[i] = min(out.get(i, (label, ints)), (label, ints)) if labelled else (0, ints)
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "a", "b") for i, v, label in rows], SCHEMA).repartition(5)


def brute_negatives(rows, every):
    x = whole(rows)
    out = []
    for a in (i for i in x if i % every == 0):
        others = sorted((-dot(x[a][1], x[i][1]), i) for i in x if i != a)
        positives = [(s, i) for s, i in others if x[i][0] == x[a][0]][:5]
        for ps, p in positives:
            fits = [(s, i) for s, i in others if x[i][0] != x[a][0] and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, k, i, -ps, -s) for k, (s, i) in enumerate(fits[:10], 1)]
    return sorted(out)


def brute_search(rows, every, k=5):
    x = whole(rows, False)
    out = []
    for q in (i for i in x if i % every == 0):
        best = sorted((-dot(x[q][1], x[i][1]), i) for i in x if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_match_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_blocks, "VALUES", 64)
        monkeypatch.setattr(vector_blocks, "BLOCKS", 3)
    rows = rows_of(1, 200)
    got = mine(frame(spark, rows), 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


@pytest.mark.parametrize("small", [False, True])
def test_search_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_blocks, "VALUES", 64)
        monkeypatch.setattr(vector_blocks, "BLOCKS", 3)
        monkeypatch.setattr(pivot_search, "ROUND", 4)
    rows = rows_of(2, 200)
    got = search(frame(spark, rows), 10, sample=40)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_search(rows, 10)


def test_few_rows_and_none(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(None, None, None)]):
        assert sorted(map(tuple, mine(frame(spark, rows), 10).collect())) == brute_negatives(rows, 10)
        assert sorted(map(tuple, search(frame(spark, rows), 10).collect())) == brute_search(rows, 10)


def test_zero_scores_open_a_window_before_their_negatives(spark):
    rows = [(0, [0.0, 1.0], 1), (9, [1.0, 0.0], 1), (3, [0.5, 0.0], 2), (4, [1.0, -1.0], 2)]
    assert sorted(map(tuple, mine(frame(spark, rows), 10).collect())) == [(0, 9, 1, 3, 0, 0)] == brute_negatives(rows, 10)


def test_products_are_exact_or_refused():
    big = np.array([[2**40, 3], [-(2**40), 1]], np.int64)
    other = np.array([[2**20 + 1, 5]], np.int64)
    assert products(big, other).tolist() == [[2**40 * (2**20 + 1) + 15], [-(2**40) * (2**20 + 1) + 5]]
    with pytest.raises(ValueError, match="64 bits"):
        products(big, np.array([[2**40, 1]], np.int64))


def test_first_keeps_ties_of_smaller_ids():
    s = np.array([[5, 7, 5, 5, vector_blocks.LOW]])
    assert first(s, np.array([9, 8, 3, 4, 1]), 3)[1].tolist() == [1, 2, 3]


def test_bounds_hold_and_rule_out_rows_of_other_clusters():
    rng = np.random.default_rng(3)
    centres = rng.integers(-800, 800, (12, 32))
    v = (centres[rng.integers(0, 12, 4000)] + rng.integers(-15, 16, (4000, 32))).astype(np.int64)
    ids = np.arange(len(v))
    pivots = farthest(v[:300], 16)
    by_pivot = np.ascontiguousarray(distances(v, pivots).astype(np.float32).T)
    q = v[:20]
    bound = upper_bounds(norms(q), by_pivot.T[:20], norms(v), by_pivot)
    exact = products(q, v)
    assert (bound >= exact).all()
    i, score, best, evaluated = nearest(q, ids[:20], bound, v, ids, 5)
    exact[np.arange(20), np.arange(20)] = vector_blocks.LOW
    r, c = first(exact, ids, 5)
    assert sorted(zip(i.tolist(), score.tolist(), best.tolist(), strict=True)) == sorted(zip(r.tolist(), exact[r, c].tolist(), c.tolist(), strict=True))
    assert evaluated < 0.3 * 20 * len(v)
