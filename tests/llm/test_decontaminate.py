import random

import numpy as np

from parcelbook.llm.common import word_hashes
from parcelbook.llm.decontaminate import RADIUS, candidates, index_of, leaks, leaks_in, simhash, similarity, _counted, shingles


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 3, 5, 12, 30, 30, 47, 59])]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            item = items[rng.randrange(3, 8)][1].split()
            if i % 6 == 0 and len(item) > 45:
                item[0] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = item
        docs.append((i, " ".join(t).upper() if i % 2 else " ".join(t), "x", 1.0))
    return docs, items


def brute(docs, items, least=0.8):
    index = index_of([(i, t.encode()) for i, t in items])
    out = {}
    for d, t, *_ in docs:
        h = word_hashes((t or "").encode().lower().split())
        for r, i in enumerate(index.ids):
            size = int(index.sizes[r])
            sims = [similarity(_counted(shingles(h[s : s + size])), index.grams[r], index.weights) for s in range(max(1, len(h) - size + 1))] if len(h) else [0]
            if max(sims) >= least:
                out[d, i] = max(sims)
    return out


def test_matches_all_windows(spark):
    docs, items = corpus()
    docs += [(100, None, "x", 1.0), (101, "", "x", 1.0), (102, items[7][1] + " a" * 200_000 + " " + items[4][1], "x", 1.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, similarity double").repartition(3)
    bench = spark.createDataFrame(items + [(9, None), (10, ""), (None, "a b"), (4, items[4][1])], "item_id long, text string")
    want = {k: v for k, v in brute(docs[:-1], items).items()}
    for per_slice in (100, 3):
        got = {(r.doc_id, r.item_id): r.similarity for r in leaks(frame, bench, per_slice=per_slice).collect()}
        assert {k for k in got if k[0] == 102} == {(102, 7), (102, 4)} | {k for k in got if k[0] == 102 and k[1] < 2}
        own = {k: v for k, v in got.items() if k[0] != 102}
        assert own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-9 for k in own)
    assert leaks(frame.limit(0), bench).count() == 0 and leaks(frame, bench.limit(0)).count() == 0


def test_blocks_miss_no_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = x[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    got = set(zip(*(v.tolist() for v in candidates(x, y)), strict=True))
    assert got == {(i, j) for i in range(300) for j in range(80) if int(x[i] ^ y[j]).bit_count() <= RADIUS}


def test_best_window(spark):
    index = index_of([(1, b"a b c d e f g")])
    assert leaks_in(word_hashes(b"x x a b c d e f g x".split()), index, 0.8) == {0: (1.0, 2)}


def test_edits_up_to_the_threshold(spark):
    """Leaks with words replaced at either end, inside or scattered: as by all windows, though bits differ widely."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 90)))) for i in range(40)]
    docs = []
    for i, text in items:
        n = len(text.split())
        most = (n - 4) // 9
        edits = [range(most), range(n - most, n), range(n // 2, n // 2 + max(1, most - 4))]
        for places in edits:
            t = text.split()
            for at in places:
                t[at] = rng.choice(words)
            docs.append((len(docs), " ".join([*rng.sample(words, 25), *t, *rng.sample(words, 25)])))
    index = index_of([(i, t.encode()) for i, t in items])
    want, beyond = {}, 0
    for d, t in docs:
        i, h = d // 3, word_hashes(t.encode().split())
        size = int(index.sizes[i])
        windows = [h[s : s + size] for s in range(len(h) - size + 1)]
        sims = [similarity(_counted(shingles(w)), index.grams[i], index.weights) for w in windows]
        if max(sims) >= 0.8:
            want[d, i] = max(sims)
            beyond += all(s < 0.8 or (simhash(w) ^ int(index.fps[i])).bit_count() > 11 for s, w in zip(sims, windows, strict=True))
    assert len(want) > 100 and beyond >= 3
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_slices_of_items_that_share_text(spark):
    """Twins, alike or with a first word of their own: edited leaks are found, alike in any slices."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    common = [rng.choice(words) for _ in range(49)]
    items = [(i, " ".join([f"own{i}" if i > 24 else "one", *common])) for i in range(50)] + [(60, " ".join(rng.choice(words) for _ in range(40)))]
    docs = [(0, " ".join(["one", *common[:-1], "changed"])), (1, " ".join(["x", "own29", *common[:-1], "y"])), (2, items[-1][1] + " z"), (3, " ".join(common[:30]))]
    want = brute(docs, items)
    assert {(0, i) for i in range(25)} <= want.keys() and (1, 29) in want and (2, 60) in want and not {k for k in want if k[0] == 3}
    frame, bench = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    for per_slice in (1000, 17):
        got = {(r.doc_id, r.item_id): r.similarity for r in leaks(frame, bench, per_slice=per_slice).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
