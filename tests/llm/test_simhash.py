import random

import numpy as np
import pytest
import xxhash

from parcelbook.llm.components import components
from parcelbook.llm.simhash import codeword_indices, fingerprint, keys, links, near_duplicates


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_documents_match_brute_force(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") * 3 for _ in range(400)]
    texts = [None, "", " \n", "One", "one two", "É ü", "a b c a b c a b c", "w " * 50_000]
    for _ in range(30):
        t = list(base)
        t[rng.randrange(400)] = "zz"
        texts.append(" ".join(t))
    rows = [(i, t, "f") for i, t in enumerate(texts)] + [(9, texts[9], "f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()
    fps = {i: brute_fp(t) for i, t, _ in rows}
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert sorted(map(tuple, got)) == sorted((i, f"{fps[i]:016x}", want[i]) for i, _, _ in rows)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text.encode().split(), 3) == brute_fp(text)


def test_any_two_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 2000)
    for flips in ([], [3], [0, 22], [7, 8]):
        y = x ^ sum(1 << f for f in flips)
        assert all(set(p) & set(q) for p, q in zip(codeword_indices(x), codeword_indices(y), strict=True))
    assert {len(set(p)) for p in codeword_indices(x)} <= {1, 6}
    rows, _ = keys(x.astype(np.uint64))
    assert np.bincount(rows).max() <= 18


@pytest.mark.parametrize("group", [1, 1024])
def test_links_connect_as_all_pairs_do(spark, group):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = links(spark.createDataFrame([(f,) for f in signed], "fp long"), group=group).collect()
    near = {frozenset((r.a, r.b)) for r in got}
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 2 for r in got)
    want = brute_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 2)
    assert brute_components(signed, lambda a, b: frozenset((a, b)) in near) == want


def test_components_of_chains_hubs_and_loops(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (50, 51), (51, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 50: 50, 51: 50}
