import math
import random

import numpy as np
from pyspark.sql import functions as F

from parcelbook.llm.language_id import PIECE, assemble, entropies, kneser_ney, languages, letters

SYLLABLES = {"aa": "ka ti mo re su", "bb": "th er in on ed", "cc": "é ö ü lle ße"}


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words) + ".", lang, "s"))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    edge = [(900, None, None, "s"), (901, "", "aa", "s"), (902, "12 34 !!", "bb", "s"), (903, "ka ti " * 150_000, None, "s"), (904, "日本", "aa", "s"), (5, rows[5][1], rows[5][2], "s")]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string, score string")
    got = languages(docs, chars=4000).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 40 and all(rows[r.doc_id][2] == r.lang_pred for r in held)
    assert [pred[i] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_probabilities_sum_to_one_and_score_as_by_hand():
    x = letters("abba cab abba".encode())
    levels = kneser_ney([x], 3)
    symbols = {g[0] for g in levels[0]}

    def p(g):
        if not g:
            return 1 / (len(levels[0]) + 1)
        hit = levels[len(g) - 1].get(g)
        if hit:
            return 10 ** hit[0]
        ctx = g[:-1]
        w = 10 ** levels[len(ctx) - 1].get(ctx, (0, 0.0))[1] if ctx else 0.75 * len(levels[0]) / sum(1 for _ in levels[1])
        return w * p(g[1:])

    for ctx in [(97,), (97, 98), (98, 98)]:
        seen = sum(10 ** v[0] for g, v in levels[len(ctx)].items() if g[:-1] == ctx)
        rest = sum(p((*ctx, s)) for s in symbols if (*ctx, s) not in levels[len(ctx)])
        assert 0.9 < seen + rest <= 1 + 1e-9
    m = assemble({"x": [x]}, 3)
    y = letters(b"cabba")
    total, n = entropies(y, m)
    s = tuple(int(v) for v in y)
    want = sum(math.log10(p(s[max(0, i - 2) : i + 1])) for i in range(1, len(s)))
    assert n == len(s) - 1 and abs(total[0] - want) < 1e-4


def test_long_text_in_pieces():
    m = assemble({"x": [letters(b"ka ti ka ti")], "y": [letters(b"on on on")]}, 3)
    text = b"kati " * (PIECE // 4)
    total, n = entropies(letters(text), m)
    part, k = entropies(letters(text[: 5 * 1000]), m)
    assert n == len(text) and k == 5000 and np.allclose(total / n, part / k, atol=1e-3)
