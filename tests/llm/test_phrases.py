import random
import re
from collections import Counter

import numpy as np
import pytest

from parcelbook.llm import phrases
from parcelbook.llm.double_array import build, descend, digits_of
from parcelbook.llm.phrases import collocations


def brute(rows, support, keep=2000, covered=50):
    """Collocations by dictionaries and whole numbers."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        own = f.setdefault(lang, Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in good.items():
            longer = [b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= covered * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, p.decode(), a, left, right, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n long, word string")


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_match_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "ünï", "É", "x", "of", "the", "\x00odd", "a\xa0b"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = [(None, "en"), ("", "en"), ("  \t .,;", None), ("the", "xx"), ("x " * 30_000, "en")]
    for i in range(300):
        text = "".join(rng.choice(words[: 4 + i % 7]) + rng.choice(seps) for _ in range(rng.randrange(1, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    rows += [("Quick brown fox jumps", "en")] * 12 + [("brown fox", "en")] * 3
    want = brute(rows, 10)
    df = table(spark, rows).repartition(5)
    assert got(collocations(df)) == want
    assert ("en", "quick brown fox") in {(r[0], r[2]) for r in want} and "quick brown" not in {r[2] for r in want if r[0] == "en"}
    assert got(collocations(df, keep=3)) == [r for r in want if r[1] <= 3]


def test_small_chunks_shards_and_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CANDIDATES_PER_SHARD", 3)
    monkeypatch.setattr(phrases, "WORDS_PER_SHARD", 2)
    monkeypatch.setattr(phrases, "PART", 16)
    rows = [("one two three. Two three four, one two", "en"), ("two three four one two three", None)] * 11
    assert got(collocations(table(spark, rows))) == brute(rows, 10)


def test_empty_tables_and_no_frequent_word(spark):
    assert got(collocations(table(spark, []))) == []
    assert got(collocations(table(spark, [("a b c", "en"), (None, None)]))) == []
    assert got(collocations(table(spark, [("a. b. a", "en")] * 20))) == []


def test_products_beyond_64_bits_are_exact(spark):
    a, left, right = 9_876_543_210, 98_765_432_109, 12_345_678_901
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.selectExpr(phrases.cut_score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize(("n", "span", "depth"), [(1, 5, 2), (3000, 50, 2), (5000, 70_000, 2), (4000, 200, 3)])
def test_trie_holds_exactly_its_rows(n, span, depth):
    rng = np.random.default_rng(n)
    rows = np.unique(rng.integers(1, span, (n, depth)), axis=0)
    digits = digits_of(np.array([[span]]), 0).shape[1]
    trie = build(digits_of(rows, digits))
    assert (descend(trie, digits_of(rows, digits)) == np.arange(len(rows))).all()
    held = set(map(tuple, rows.tolist()))
    other = rng.integers(1, span, (5000, depth))
    assert ((descend(trie, digits_of(other, digits)) >= 0) == [tuple(x) in held for x in other.tolist()]).all()
