"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, fold, mix, octets, table, word_hashes

BITS = 20
SAMPLE = 16_000
PIECE = 1 << 16
STEM = 8
MARKS = string.punctuation.encode()
TEXTS = 1 << 18
LONG = 32
#: Of each byte: 0 between words, 1 a mark, 2 other.
KINDS = np.array([0 if bytes([i]).isspace() else 1 if i in MARKS else 2 for i in range(256)], np.int8)
#: Factors of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass(frozen=True)
class Weights:
    """Nonzero coordinates only: at most 2**BITS, whatever the size of the corpus."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.value
        return out


def features(words: list[bytes], once: bool = False) -> Iterator[np.ndarray]:
    """Hashed words, their first bytes, word pairs and pairs with one word between, in pieces of a long text.

    With ``once`` the first bytes that words of a piece share are given once, which is less
    work for callers that take distinct numbers.
    """
    for at in range(0, len(words), PIECE):
        h = word_hashes(words[at : at + PIECE + 2])
        own = len(h) if at + PIECE + 2 >= len(words) else PIECE
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        skip = h[:-2] * np.uint64(0xD1B54A32D192ED03) + h[2:]
        heads = {w[:STEM] for w in words[at : at + own]} if once else [w[:STEM] for w in words[at : at + own]]
        stem = word_hashes(heads) + np.uint64(STEM)
        for x in (h[:own], mix(stem), mix(pair[:own]), mix(skip[:own])):
            yield (x >> np.uint64(64 - BITS)).astype(np.int64)


def words_of(body: bytes) -> list[bytes]:
    return [w for w in (x.strip(MARKS) for x in body.lower().split()) if w]


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buf, text, begin, size): folded bytes of the texts and where the words of ``words_of`` stand in them."""
    buf = np.frombuffer(b" ".join([b"", *texts, b" " * LONG]).lower(), np.uint8)
    kind = KINDS[buf]
    edges = [np.flatnonzero(np.diff(kind > low)) + 1 for low in (0, 1)]
    begin, stop = edges[1][::2], edges[1][1::2]  # runs without spaces and marks; a word goes from its first to its last
    word = np.searchsorted(edges[0][::2], begin, side="right")
    fresh = np.flatnonzero(np.diff(word, prepend=-1))
    last = np.append(fresh[1:], len(word))[: len(fresh)] - 1
    begin, stop = begin[fresh], stop[last]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return buf, np.searchsorted(ends, begin - 1, side="right"), begin, stop - begin


def place_hashes(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``word_hashes`` of words that stand in ``buf``, which has LONG more bytes; all at once unless LONG or longer."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    h = size.astype(np.uint64) + P5
    for k in range(0, LONG - 8, 8):
        i = np.flatnonzero(size >= k + 8)
        h[i] = turn(h[i] ^ (turn(lanes[begin[i] + k] * P2, 31) * P1), 27) * P1 + P4
    at = begin + (size & ~7)
    i = np.flatnonzero(size & 4)
    h[i] = turn(h[i] ^ ((lanes[at[i]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at += size & 4
    for k in range(3):
        i = np.flatnonzero((size & 3) > k)
        h[i] = turn(h[i] ^ (buf[at[i] + k] * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    i = np.flatnonzero(size >= LONG)
    h[i] = word_hashes([buf[a : a + n].tobytes() for a, n in zip(begin[i].tolist(), size[i].tolist(), strict=True)])
    return h


def distinct_features(texts: list[bytes], active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, text, number): words of each text, and its distinct ``features``, rising, if they are ``active``."""
    buf, owner, begin, size = word_places(texts)
    hashes = place_hashes(buf, begin, size)
    cut = np.uint64(64 - BITS)
    keys = [np.zeros(0, np.int64)]
    for at in range(0, len(hashes), PIECE):
        h, t, own = hashes[at : at + PIECE + 2], owner[at : at + PIECE + 2], min(PIECE, len(hashes) - at)
        stem = h[:own].copy()
        i = np.flatnonzero(size[at : at + own] > STEM)
        stem[i] = place_hashes(buf, begin[at + i], np.full(len(i), STEM))
        found = [(t[:own], h[:own]), (t[:own], mix(stem + np.uint64(STEM)))]
        for gap, factor in ((1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xD1B54A32D192ED03))):
            same = np.flatnonzero(t[:-gap][:own] == t[gap:][:own])
            found.append((t[same], mix(h[same] * factor + h[same + gap])))
        found = [(who, (x >> cut).astype(np.int64)) for who, x in found]
        if active is not None:
            found = [(who[keep], x[keep]) for who, x in found for keep in [np.flatnonzero(active[x])]]
        keys.append(np.unique(np.concatenate([(who << BITS) | x for who, x in found])))
    key = np.unique(np.concatenate(keys)) if len(keys) > 2 else keys[-1]
    return np.bincount(owner, minlength=len(texts)), key >> BITS, key & ((1 << BITS) - 1)


def portions(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Texts of a batch in lists of about TEXTS bytes."""
    texts, held = [], 0
    for body in bodies(batch):
        texts.append(body)
        held += len(body)
        if held >= TEXTS:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def fit(vectors: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, epochs: int = 8) -> Weights:
    """FTRL-proximal: each coordinate has its own rate, and those below ``l1`` stay at zero."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rate = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    for _ in range(epochs):
        for idx, y in zip(vectors, labels, strict=True):
            zi, root = z[idx], np.sqrt(n[idx])
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30)))
            g = p - y
            grown = np.sqrt(n[idx] + g * g)
            z[idx] = zi + g - (grown - root) / alpha * w
            n[idx] += g * g
            bias -= 0.01 * g
    root = np.sqrt(n)
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + root) / alpha + l2), 0.0)
    keep = np.flatnonzero(w)
    return Weights(keep, w[keep].astype(np.float32), bias)


def vectors_of(docs: DataFrame, label: str) -> DataFrame:
    """(label, idx): distinct feature numbers of each text, at most 2**BITS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts in portions(batch):
                _, text, number = distinct_features(texts)
                out += np.split(number.astype(np.int32), np.searchsorted(text, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column(label), pa.array(out, pa.list_(pa.int32()))], ["label", "idx"])

    return octets(docs, label).select(F.col(label).cast("int").alias(label), "body").mapInArrow(run, "label int, idx array<int>")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, size: int) -> DataFrame:
    """At most ``size`` labelled texts, drawn by a hash of the id; a doc labelled twice takes the larger label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label)).where(allowed)
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select("doc_id", "text").join(drawn, "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None, size: int = SAMPLE) -> Weights:
    """Fit on a bounded sample of ``size`` labelled rows, in one task; its text is hashed in parallel."""
    allowed = F.lit(True) if allowed is None else allowed

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.asarray(v, np.int32), y) for pdf in groups for v, y in zip(pdf["idx"], pdf["label"], strict=True)]
        rows.sort(key=lambda r: (int(mix(r[0].astype(np.uint64)).sum()), r[1]))  # the same order however the rows arrived
        found = fit([v for v, _ in rows], np.array([y for _, y in rows], float))
        yield pd.DataFrame({"idx": [found.index.astype(np.int64)], "value": [found.value.astype(np.float64)], "bias": [found.bias]})

    sample = vectors_of(labelled_sample(docs, labels, label, allowed, size), label)
    got = sample.repartition(1).mapInPandas(run, "idx array<long>, value array<double>, bias double").collect()
    if not got:
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0)
    return Weights(np.array(got[0].idx, np.int64), np.array(got[0].value, np.float32), got[0].bias)


def score_texts(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score): probability of label 1 for every whole text; an empty one has the prior's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        active = dense != 0
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, body in enumerate(bodies(batch)):
                out[i] = probability(words_of(body), dense, active, weights.bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return octets(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def probability(words: list[bytes], dense: np.ndarray, active: np.ndarray, bias: float) -> float:
    hit = [x[active[x]] for x in features(words, once=True)]
    idx = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
    return float(1 / (1 + np.exp(-np.clip(bias + float(dense[idx].sum()), -30, 30))))


def without_toxic(docs: DataFrame, weights: Weights) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        active = dense != 0
        for batch in batches:
            texts = batch.column("text")
            keep = [probability(words_of((texts[i].as_py() or "").encode()), dense, active, weights.bias) < 0.5 for i in range(len(texts))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text of ``docs``.

    Learns ``labels.toxic`` of rows whose fold of 5 is not 0, from at most ``size`` of
    them. Null and empty texts have the prior's score; without labels every score is
    near 0. Repeated rows are scored alike, other columns are ignored.
    """
    weights = train(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, size)
    scored = score_texts(docs, weights)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every row of ``documents``."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
