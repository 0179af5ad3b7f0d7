import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from parcelbook.llm.suffix_dedup import SPAN, _repeats_exactly, heads, remove_repeats, repeats, sorted_heads


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - SPAN + 1):
            s = b[j : j + SPAN]
            if i is not None:
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - SPAN + 1):
            if i is not None and least[b[j : j + SPAN]] < i:
                gone[j : j + SPAN] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    line = " ".join(word() for _ in range(14))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)] + ["ab" * 60, "x" * 300, line]
    rows = []
    for i in range(70):
        t = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, 20)
            t.insert(rng.randint(0, len(t)), p[at : at + rng.randint(40, 200)])
        if i % 3 == 0:
            t.insert(rng.randint(0, len(t)), line)
        rows.append((i * 3 - 50, " ".join(t)))
    rows += [(900 + i, rows[5][1]) for i in range(6)] + [(1000, None), (1001, ""), (1002, "q" * 49), (None, rows[5][1]), (1003, "z" * 300_000), (1004, "z" * 51 + "y" * 200)]
    rows += [rows[12], (1005, passages[0] * 3)]
    return rows


@pytest.mark.parametrize(("batches", "crowd"), [(1, 100_000), (4, 3)])
def test_matches_brute_force(spark, batches, crowd):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, head string").repartition(6)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, batches, crowd).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_strings_have_equal_heads():
    rng = np.random.default_rng(3)
    a = rng.integers(97, 100, 600).astype(np.uint8)
    b = np.concatenate((rng.integers(97, 100, 77).astype(np.uint8), a[100:400]))
    buf, ends = np.concatenate((a, b)), np.array([len(a), len(a) + len(b)])
    text, start, n, head = heads(buf, ends)
    assert n.sum() == len(a) + len(b) - 2 * (SPAN - 1)
    by = {}
    for s, k, h in zip(start.tolist(), n.tolist(), head.tolist(), strict=True):
        for i in range(s, s + k):
            by[i] = h
    assert all(by[100 + i] == by[len(a) + 77 + i] for i in range(300 - SPAN + 1))


def test_exact_way_agrees():
    rng = random.Random(1)
    contents = [bytes(rng.choice(b"ab") for _ in range(3)) * 30 for _ in range(30)]
    key, doc = np.zeros(30, np.uint64), np.arange(30)[::-1].copy()
    cover = lambda x: {(r, i) for r, a, b in zip(*x, strict=True) for i in range(a, b)}
    assert cover(repeats(key, doc, contents)) == cover(_repeats_exactly(key, doc, contents))


def test_texts_are_shuffled_once(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(400))) for i in range(60)]
    rows += [(100 + i, t + "!") for i, t in rows]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in found.orderBy("doc_id").collect()] == [0] * 60 + [400] * 60
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_heads_of_a_large_batch_take_little_memory():
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 8192).astype(np.uint8).tobytes() for _ in range(1024)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1024), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "body"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in sorted_heads(Docs(), 4)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 80e6, peak
