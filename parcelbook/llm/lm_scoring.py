"""Perplexity by an interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, fold, mix, octets, table, word_hashes
from parcelbook.llm.store import mapped, pack, runs, save, unpack
from parcelbook.session import scratch_path

#: Ids of words have 48 bits; the two marks are outside the range of words.
WORD = np.uint64((1 << 48) - 1)
END, BEGIN = np.uint64(0), np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(7)
CHUNK = 4_000_000
PIECE = 1_000_000
BYTES_PER_SHARD = 64_000_000
WORD_COLUMNS = ("word", "count", "before", "total", "n1", "n2", "n3")


def tokens(body: bytes) -> np.ndarray:
    """Ids of the words, then the end; word ids start at 2."""
    h = word_hashes(body.lower().split()) & WORD
    return np.concatenate((np.maximum(h, np.uint64(2)), [END]))


def pairs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    last = tokens(body)
    return np.concatenate(([BEGIN], last[:-1])), last


def pair_shard(before: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    """Continuations of one word go to eight shards, so that a frequent word fills none."""
    return (mix(before * np.uint64(8) + (last & SPREAD)) % np.uint64(shards)).astype(np.int32)


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (mix(word) % np.uint64(shards)).astype(np.int32)


def pair_key(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(before * STEP + last)


def count_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, block): distinct pairs of each chunk of a task with their counts."""

    def emit(before: list[np.ndarray], last: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        b, w = np.concatenate(before), np.concatenate(last)
        shard = pair_shard(b, w, shards)
        order = np.lexsort((w, b, shard))
        start = runs(order, shard, b, w)
        n = np.diff(np.append(start, len(order))).astype(np.uint32)
        first = order[start]
        s, b, w = shard[first], b[first], w[first]
        cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = b[lo:hi]
            run = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            block = pack(own[run], np.diff(np.append(run, hi - lo)).astype(np.uint32), w[lo:hi], n[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([int(s[lo])], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last, held = [], [], 0
        for batch in batches:
            for body in bodies(batch):
                b, w = pairs(body)
                before.append(b)
                last.append(w)
                held += len(w)
                if held >= CHUNK:
                    yield from emit(before, last)
                    before, last, held = [], [], 0
        if held:
            yield from emit(before, last)

    return octets(docs).mapInArrow(run, "shard int, block binary")


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def merge_pairs(counted: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write each shard of pairs; (shard, block, c1..c4) of what its words add to their statistics."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in pdf["block"]]
        before = np.concatenate([np.repeat(u, n) for u, n, _, _ in parts])
        last = np.concatenate([w for _, _, w, _ in parts])
        count = np.concatenate([c for *_, c in parts]).astype(np.int64)
        key = pair_key(before, last)
        order = np.argsort(key)
        start = runs(order, key)
        total = np.add.reduceat(count[order], start)
        first = order[start]
        shard = int(pdf["shard"].iloc[0])
        save(f"{folder}/pair-{shard}.key", key[first])
        save(f"{folder}/pair-{shard}.count", total.astype(np.uint32))
        one = np.ones(len(first), np.int64)
        zero = np.zeros(len(first), np.int64)
        word = np.concatenate((last[first], before[first]))
        stats = [np.concatenate(x) for x in ((total, zero), (one, zero), (zero, total), (zero, one * (total == 1)), (zero, one * (total == 2)), (zero, one * (total > 2)))]
        at = np.lexsort((word, word_shard(word, shards)))
        begin = runs(at, word)
        words = word[at][begin]
        sums = [np.add.reduceat(x[at], begin).astype(np.uint64) for x in stats]
        target = word_shard(words, shards)
        cut = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
        c = _counts_of_counts(total)
        rows = [(int(target[lo]), pack(words[lo:hi], *[x[lo:hi] for x in sums]), *(c if lo == 0 else (0, 0, 0, 0))) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame(rows, columns=["shard", "block", "c1", "c2", "c3", "c4"])

    return counted.groupBy("shard").applyInPandas(run, "shard int, block binary, c1 long, c2 long, c3 long, c4 long")


def merge_words(parts: DataFrame, folder: str) -> DataFrame:
    """Write each shard of words; one row of sums for each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = [unpack(b) for b in pdf["block"]]
        word = np.concatenate([a[0] for a in arrays])
        order = np.argsort(word)
        start = runs(order, word)
        sums = [np.add.reduceat(np.concatenate([a[i] for a in arrays])[order], start) for i in range(1, 7)]
        shard = int(pdf["shard"].iloc[0])
        save(f"{folder}/word-{shard}.word", word[order][start])
        for name, x in zip(WORD_COLUMNS[1:], sums, strict=True):
            save(f"{folder}/word-{shard}.{name}", x)
        seen, before = sums[0], sums[1]
        pair_counts = [int(pdf[c].sum()) for c in ("c1", "c2", "c3", "c4")]
        return pd.DataFrame([(int(seen.sum()), int((seen > 0).sum()), int(before.sum()), *_counts_of_counts(before), int((before > 2).sum()), *pair_counts)], columns=SUMS)

    return parts.groupBy("shard").applyInPandas(run, ", ".join(f"{c} long" for c in SUMS))


SUMS = ["tokens", "words", "pairs", "w1", "w2", "w3", "w4", "w3plus", "c1", "c2", "c3", "c4"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; a half where a count of counts is missing."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0, *(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))])


@dataclass(frozen=True)
class Model:
    """A folder of sorted arrays and a few sums; tasks map the arrays, so a model may exceed their memory."""

    folder: str
    shards: int
    tokens: int
    words: int
    pairs: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    word_rest: float

    def word_rows(self, word: np.ndarray, files: dict) -> dict[str, np.ndarray]:
        """Statistics of sorted distinct words; zeros for those not seen."""
        out = {name: np.zeros(len(word), np.uint64) for name in WORD_COLUMNS[1:]}
        shard = word_shard(word, self.shards)
        for s in np.unique(shard).tolist():
            held = self._file(files, f"word-{s}.word")
            mine = np.flatnonzero(shard == s)
            if len(held):
                at = np.minimum(np.searchsorted(held, word[mine]), len(held) - 1)
                hit = held[at] == word[mine]
                for name in out:
                    out[name][mine[hit]] = self._file(files, f"word-{s}.{name}")[at[hit]]
        return out

    def pair_counts(self, before: np.ndarray, last: np.ndarray, files: dict) -> np.ndarray:
        key, shard = pair_key(before, last), pair_shard(before, last, self.shards)
        order = np.lexsort((key, shard))
        out = np.zeros(len(key), np.uint32)
        cut = np.append(runs(order, shard), len(order))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            mine = order[lo:hi]
            s = int(shard[mine[0]])
            held = self._file(files, f"pair-{s}.key")
            if len(held):
                at = np.minimum(np.searchsorted(held, key[mine]), len(held) - 1)
                hit = held[at] == key[mine]
                out[mine[hit]] = self._file(files, f"pair-{s}.count")[at[hit]]
        return out

    def _file(self, files: dict, name: str) -> np.ndarray:
        if name not in files:
            kind = np.uint32 if name.startswith("pair") and name.endswith("count") else np.uint64
            try:
                files[name] = mapped(f"{self.folder}/{name}", kind)
            except FileNotFoundError:  # no word or pair fell into this shard
                files[name] = np.zeros(0, kind)
        return files[name]

    def score(self, before: np.ndarray, last: np.ndarray, files: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, base log10 probability, known) of each token after the one before it."""
        word, at = np.unique(np.concatenate((last, before)), return_inverse=True)
        rows = self.word_rows(word, files)
        w, u = at[: len(last)], at[len(last) :]
        seen = rows["count"].astype(float)
        n = rows["before"].astype(float)
        uniform = 1 / (self.words + 1)
        p = np.full(len(word), uniform)
        if self.pairs:
            p = (n - self.word_discount[np.minimum(n, 3).astype(int)]) / self.pairs + self.word_rest * uniform
        total = rows["total"].astype(float)
        left = sum(self.pair_discount[k] * rows[f"n{k}"].astype(float) for k in (1, 2, 3))
        c = self.pair_counts(before, last, files).astype(float)
        known = total[u] > 0
        t = np.where(known, total[u], 1)
        q = np.where(known, (c - self.pair_discount[np.minimum(c, 3).astype(int)]) / t + left[u] / t * p[w], p[w])
        base = np.log10((seen + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        return np.log10(q), base[w], seen[w] > 0


def train(docs: DataFrame, allowed: Column, bytes_per_shard: int = BYTES_PER_SHARD) -> Model:
    """Count pairs of words over all allowed documents and write the model to the shared folder."""
    spark = docs.sparkSession
    own = docs.where(allowed)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bytes_per_shard))
    folder = scratch_path(spark, "bigrams")
    sums = merge_words(merge_pairs(count_pairs(own, shards), folder, shards), folder)
    r = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).first()
    word_discount = discounts(r.w1, r.w2, r.w3, r.w4)
    rest = (word_discount[1] * r.w1 + word_discount[2] * r.w2 + word_discount[3] * r.w3plus) / r.pairs if r.pairs else 1.0
    return Model(folder, shards, r.tokens, r.words, r.pairs, discounts(r.c1, r.c2, r.c3, r.c4), word_discount, rest)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, np.ndarray] = {}
        for batch in batches:
            sums = np.zeros((batch.num_rows, 4))
            before, last, doc, held = [], [], [], 0

            def flush() -> None:
                if not last:
                    return
                d = np.concatenate(doc)
                own, base, known = model.score(np.concatenate(before), np.concatenate(last), files)
                start = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                for j, x in enumerate((np.ones(len(d)), known.astype(float), base, own)):
                    sums[d[start], j] += np.add.reduceat(x, start)

            for i, body in enumerate(bodies(batch)):
                b, w = pairs(body)
                for at in range(0, len(w), PIECE):
                    part = w[at : at + PIECE]
                    before.append(b[at : at + PIECE])
                    last.append(part)
                    doc.append(np.full(len(part), i))
                    held += len(part)
                    if held >= PIECE:
                        flush()
                        before, last, doc, held = [], [], [], 0
            flush()
            counts = [pa.array(sums[:, j].astype(np.int64)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sums[:, 2]), pa.array(sums[:, 3])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return octets(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity(docs: DataFrame, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    The model learns from every row whose fold of 10 is not 0, repeated rows included;
    null texts are one end. Without training rows every token has probability 1 / (V + 1).
    """
    model = train(docs, fold(F.col("doc_id"), 10) != 0, bytes_per_shard)
    scored = score_texts(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every row of ``documents``."""
    return perplexity(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict[str, str] = {}
