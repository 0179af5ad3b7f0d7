import random

import numpy as np

from parcelbook.llm.toxicity import BITS, PIECE, distinct_features, features, toxicity, words_of


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        bad = i % 5 == 1
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty"]))
        docs.append((i, " ".join(text), "x", 0.5))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (1002, "vile " + "w1 " * 200_000, "x", 0.5), (1, docs[1][1], "x", 0.5)]
    got = toxicity(spark.createDataFrame(docs, "doc_id long, text string, body string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(truth[r.doc_id] == r.predicted for r in held) / len(held) > 0.97
    assert {r.doc_id: r.predicted for r in rows}[1000] == 0


def test_no_labels_and_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    assert [r.predicted for r in toxicity(docs, empty).collect()] == [0, 0]
    assert toxicity(docs.limit(0), empty).count() == 0


def test_pieces_of_a_long_text_give_the_same_features():
    words = [b"%d" % (i % 7919) for i in range(PIECE + 100)]
    n = sum(len(x) for x in features(words))
    assert n == 2 * len(words) + (len(words) - 1) + (len(words) - 2)


def test_features_given_once_are_the_same_numbers():
    words = [b"%s%d" % (b"beginning" * (i % 3), i % 50) for i in range(PIECE + 100)]
    whole, once = np.concatenate([*features(words)]), np.concatenate([*features(words, once=True)])
    assert len(once) < len(whole) and np.array_equal(np.unique(once), np.unique(whole))


def test_texts_taken_together_have_the_features_of_each():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abÉé'.-") for _ in range(rng.choice([1, 2, 5, 9, 20, 40])))
    texts = [" ".join(word() for _ in range(n)).encode() for n in (40, 0, 1, 2, 300, PIECE + 3, 3)] + [b"", b" .. -- ", b"One. (one) ONE\x0bone,\x00\x1c\xff"]
    texts += [b" ".join(b"Z" * n for n in range(1, 70))]
    active = np.random.default_rng(5).random(1 << BITS) < 0.3
    for some in (texts, texts[::-1], [b""], [b"a"], []):
        for mask in (None, active):
            n, text, number = distinct_features(some, mask)
            for i, body in enumerate(some):
                want = np.unique(np.concatenate([*features(words_of(body)), np.zeros(0, np.int64)]))
                assert n[i] == len(words_of(body))
                assert np.array_equal(number[text == i], want if mask is None else want[active[want]])
