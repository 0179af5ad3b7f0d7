import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from parcelbook.llm import lm_scoring
from parcelbook.llm.lm_scoring import discounts, perplexity
from parcelbook.llm.store import pack, unpack


def brute(rows):
    toks = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    train = [t for (i, *_), t in zip(rows, toks, strict=True) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in t)
    big = Counter(p for t in train for p in zip([0, *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    cont = Counter(w for _, w in big)
    of = lambda x: [sum(k == i for k in x.values()) for i in (1, 2, 3, 4)]
    d2, d1 = discounts(*of(big)), discounts(*of(cont))
    total, left = Counter(), Counter()
    for (u, _), k in big.items():
        total[u] += k
        left[u] += d2[min(k, 3)]
    rest = sum(d1[min(k, 3)] for k in cont.values()) / len(big) if big else 1

    def p(u, w):
        q = 1 / (v + 1)
        if big:
            q = (cont[w] - d1[min(cont[w], 3)]) / len(big) + rest * q
        return (big[u, w] - d2[min(big[u, w], 3)]) / total[u] + left[u] / total[u] * q if total[u] else q

    out = []
    for (i, *_), t in zip(rows, toks, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        own = sum(math.log10(p(u, w)) for u, w in zip([0, *t[:-1]], t, strict=True))
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, base, own))
    if big:
        words = [*c, "never seen"]
        assert abs(sum(p(0, w) for w in words) - 1) < 1e-9
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[2:4], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    return len(got) == len(want) and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:]) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("piece", [1_000_000, 7])
def test_matches_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(lm_scoring, "PIECE", piece)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the a cat Dog sat é on mat").lower() if rng.random() < 0.1 else rng.choice(["the", "a", "Cat", "dog", "é", "sat"]) for _ in range(rng.randint(0, 30))), 1.0) for i in range(120)]
    rows += [(200, None, 1.0), (201, "", 1.0), (203, "the the " * 20_000, 1.0), (5, rows[5][1], 1.0), (None, "the cat", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(5)
    assert close(perplexity(docs, bytes_per_shard=2000).collect(), brute(rows))


def test_empty_and_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert close(perplexity(docs).collect(), brute([tuple(r) for r in docs.collect()]))
    assert perplexity(docs.limit(0)).count() == 0


def test_blocks_round_trip():
    arrays = [np.array([1, 5, 1 << 60], np.uint64), np.zeros(0, np.uint32), np.arange(9, dtype=np.uint32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))
