import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelbook.llm import near_groups
from parcelbook.llm.common import fold, word_hashes
from parcelbook.llm.decontaminate import index_of, leaks_in
from parcelbook.llm.near_groups import REACH, similarity, similar_groups, sketch, table_keys
from parcelbook.llm.store import save
from parcelbook.llm.toxicity import probability, train, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, root string"


def corpus():
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(30 + i)) for i in range(6)]
    texts = [prose(rng.randint(20, 150)) for _ in range(150)]
    for i in range(0, 150, 7):
        texts[i] += " vile nasty awful"
    for i in range(3, 60, 10):
        t = texts[i].split()
        t[len(t) // 2] = "edited"
        texts.append(" ".join(t) if len(t) > 70 else texts[i])
    for i in range(6):
        texts.append(prose(20) + " " + items[i][1] + " " + prose(20))
    texts += ["", None, prose(30_000), texts[1], texts[2] + " "]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1, "r") for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(10), None, None, None, None, None)]
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(150)]
    return rows, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, labels = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def brute(spark, folder):
    """Kept (doc_id, text) after the first four stages, by loops over all rows and pairs."""
    rows, items, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", fold(F.col("doc_id"), 5) != 0)
    dense = weights.dense()
    kept = [(r[0], r[1]) for r in rows if probability(words_of((r[1] or "").encode()), dense, dense != 0, weights.bias) < 0.5]
    last = {}
    for i, t in kept:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", -1))
    kept = sorted({(i, t) for i, t in kept if i is not None and last[t or ""] == i}) + [x for x in kept if x[0] is None]
    root = {i: i for i, _ in kept if i is not None}
    changed = True
    close = [(i, j) for i, t in kept for j, u in kept if None not in (i, j) and i < j and similarity((t or "").encode(), (u or "").encode()) >= 0.8]
    while changed:
        changed = False
        for i, j in close:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    kept = [(i, t) for i, t in kept if i is None or root[i] == i]
    index = index_of([(i, t.encode()) for i, t in items])
    return [(i, t) for i, t in kept if not (t or "").split() or not leaks_in(word_hashes(t.encode().lower().split()), index, 0.8)], len(close)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, close = brute(spark, folder)
    assert close >= 3 and len(want) < docs.count() - 25
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert mixed.count() == len(want) and {"rate", "copies", "domain"} <= set(mixed.columns)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_groups_of_many_edited_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 900)}" for _ in range(300)]
    rows = [(i, " ".join([*base[: 10 * i], f"new{i}", *base[10 * i + 1 :]])) for i in range(25)]
    rows += [(100 + i, " ".join(rng.sample(base, 200))) for i in range(10)] + [(200, None), (201, ""), (202, "one two")]
    got = {r.doc: r.root for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(25), 0)


def test_groups_compare_every_candidate(spark, monkeypatch):
    """Families around the threshold: the groups are those of all pairs that share a key, not of the nearest alone."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for family in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 160))]
        for _ in range(3 if family else 60):
            t = list(base)
            for at in rng.sample(range(len(t)), max(1, round(len(t) * rng.uniform(0.006, 0.02)))):
                t[at] = rng.choice(words)
            texts.append(" ".join(t[rng.randint(0, len(t) // 14) :]))
    texts = [texts[i] for i in rng.sample(range(len(texts)), len(texts))]
    marks = [sketch(t.encode().split(), 5) for t in texts]
    lo, hi = (np.array([m[j] for m in marks], np.uint64) for j in (0, 1))
    keys = {}
    for r, k in zip(*(x.tolist() for x in table_keys(lo, hi)), strict=True):
        keys.setdefault(k, []).append(r)
    bits = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(marks[i], marks[j], strict=True))
    offered = {(i, j) for held in keys.values() for i in held for j in held if i < j and bits(i, j) <= REACH}
    alike = {(i, j) for i, j in offered if similarity(texts[i].encode(), texts[j].encode()) >= 0.8}
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    want = {i: root[i] for pair in alike for i in pair}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc: r.root for r in similar_groups(docs).collect()}
    assert len(offered) > len(alike) > 100 and got == want
    # every key looked at one by one, and many small files of sets
    monkeypatch.setattr(near_groups, "SMALL", 1)
    monkeypatch.setattr(near_groups, "SET_ROWS", 2000)
    assert {r.doc: r.root for r in similar_groups(docs).collect()} == want


def test_links_of_a_large_key_join_its_groups(tmp_path):
    rng = random.Random(3)
    rows = []
    for family in range(4):
        base = [rng.getrandbits(60) for _ in range(100)]
        rows += [sorted({*base[i % 7 :], *[rng.getrandbits(60) for _ in range(i % 5)]}) for i in range(30)]
    rows = [np.array(r, np.uint64) for r in rng.sample(rows, len(rows))]
    save(f"{tmp_path}/0-0.end", np.cumsum([len(r) for r in rows], dtype=np.int64))
    save(f"{tmp_path}/0-0.set", np.concatenate(rows))
    sketches = np.array([sum(1 << b for b in rng.sample(range(64), 6)) for _ in rows], np.uint64)
    links = list(near_groups.joined(np.arange(len(rows)), sketches, sketches, near_groups.Sets(str(tmp_path)), 0.8))
    alike = lambda a, b: len({*rows[a].tolist()} & {*rows[b].tolist()}) >= 0.8 * len({*rows[a].tolist()} | {*rows[b].tolist()})
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 2 * (int(sketches[i]) ^ int(sketches[j])).bit_count() <= REACH and alike(i, j)]

    def groups(edges):
        root = list(range(len(rows)))
        for _ in rows:
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert groups(links) == groups(pairs) and len(links) == len(rows) - len(set(groups(pairs)))
