import random

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType, StructType

from parcelbook.llm import toxicity
from parcelbook.llm.mixing import fit_rates, mix_to_targets, posteriors, rates


def dense(n, p, target, ridge):
    w = n / n.sum()
    r = np.ones(len(n))
    for _ in range(200_000):
        new = np.maximum(0, r - (p @ ((w * r) @ p - target) + ridge * (r - 1)))
        if np.abs(new - r).max() < 1e-13:
            break
        r = new
    return r


def test_rates_match_a_dense_solution(spark):
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 90, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    target = np.array([0.9, 0.1, 0.0])
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(4)
    residuals, step = fit_rates(rows, target, ridge=0.05, rounds=200, tolerance=1e-10)
    got, _ = rates(p, residuals, step, 0.05)
    assert np.allclose(got, dense(n, p, target, 0.05), atol=1e-4) and (got >= 0).all() and (got == 0).any()


def test_expected_totals_meet_targets(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        kind = "a" if i % 4 else "b"
        docs.append((i, " ".join(f"{kind}{rng.randint(0, 20)}" for _ in range(rng.randint(5, 60))), 1.0, 2))
        if i % 2:
            labels.append((i, kind))
    docs += [(900, None, 1.0, 2), (901, "", 1.0, 2), (902, "b1 " * 300, 1.0, 2), (3, docs[3][1], 1.0, 2)]
    labels += [(i, "b" if i % 4 == 0 else "a") for i in range(0, 300, 6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, rate double, copies int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, domain string")
    got = mix_to_targets(frame, known, {"a": 0.3, "b": 0.7}, rounds=25).collect()
    assert len(got) == len(docs) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    right = [r for r in got if r.doc_id < 300]
    assert sum(r.domain == ("a" if r.doc_id % 4 else "b") for r in right) / len(right) > 0.95
    total = sum(r.n_tokens for r in got)
    share = sum(r.n_tokens * r.rate for r in got if r.domain == "b") / total
    assert abs(share - 0.7) < 0.05
    none = mix_to_targets(frame, known.limit(0), {"a": 0.5, "b": 0.5}, rounds=5).collect()
    assert {round(r.posterior, 6) for r in none} == {0.5}
    assert mix_to_targets(frame.limit(0), known, {"a": 0.5, "b": 0.5}).count() == 0


def test_short_words_are_not_hashed_one_by_one(monkeypatch):
    class Docs:
        schema = StructType().add("doc_id", LongType())

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr("parcelbook.llm.mixing.octets", lambda docs: docs)
    done = []
    monkeypatch.setattr(toxicity, "word_hashes", lambda words, hashes=toxicity.word_hashes: done.extend(words) or hashes(words))
    model = toxicity.Weights(np.arange(1 << toxicity.BITS), np.ones(1 << toxicity.BITS, np.float32), 0.0)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array([b"one two, three", None, b"four " + b"x" * 40])], ["doc_id", "body"])
    (got,) = posteriors(Docs(), {"a": model, "b": model})(iter([batch]))
    assert got.column("n_tokens").to_pylist() == [3, 0, 2] and got.column("p").to_pylist() == [[0.5, 0.5]] * 3
    assert done == [b"x" * 40]
