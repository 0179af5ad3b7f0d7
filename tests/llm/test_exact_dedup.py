import hashlib

from pyspark.sql import functions as F

from parcelbook.llm.exact_dedup import absorb, deduplicate
from parcelbook.session import scratch_path


def brute(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "x" * 200_000), (7, "x" * 200_000), (8, "é"), (8, "é"), (None, "b"), (9, "b"), (None, "c")]


def test_matches_brute_force_with_nulls_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, digest string, kept int")
    assert sorted(map(tuple, deduplicate(docs).collect()), key=str) == brute(ROWS)


def test_texts_behind_one_digest_stay_apart(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = deduplicate(docs, digest=F.length("text").cast("string"), files_per_batch=1)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_state_goes_on_between_calls_and_never_expires(spark):
    state = scratch_path(spark, "state")
    schema = "doc_id long, digest string"
    absorb(spark.createDataFrame([(1, "a"), (2, "b")], schema), state).collect()
    got = absorb(spark.createDataFrame([(3, "a"), (0, "a")], schema), state)
    assert [tuple(r) for r in got.collect()] == [("a", 3, 3)]


def test_empty(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
