"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, fold, mix, octets, table

ORDER = 4
SAMPLE_CHARS = 2_000_000
MOST = 1000
PIECE = 1 << 19
SPACE = 32
DISCOUNT = 0.75
BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Lower-case letter for each code point, a space for everything else; letters by Unicode category."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(body: bytes) -> np.ndarray:
    """Letters of a text with single spaces for what is between them, and one at each end."""
    points = np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    x = np.concatenate(([SPACE], _letters()[points], [SPACE])).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != SPACE) | (x[:-1] != SPACE)
    x = x[keep]
    return x if len(x) > 1 else np.zeros(0, np.uint64)


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` letters; the order is part of it."""
    h = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for j in range(n):
        h = h * BASE + x[j : j + len(h)]
    return mix(h)


@dataclass(frozen=True)
class Models:
    """Sorted hashes of n-grams of each order, with a row of log10 probabilities and of back-off weights by language."""

    langs: tuple[str, ...]
    hashes: tuple[np.ndarray, ...]
    logp: tuple[np.ndarray, ...]
    back: tuple[np.ndarray, ...]
    floor: np.ndarray
    scale: float


def find(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash, or -1."""
    if not len(sorted_hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


def _counts(texts: list[np.ndarray], n: int) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for x in texts:
        s = x.tolist()
        for g in zip(*[s[j:] for j in range(n)], strict=False):
            out[g] = out.get(g, 0) + 1
    return out


def kneser_ney(texts: list[np.ndarray], order: int) -> list[dict[tuple, tuple[float, float]]]:
    """For each order {n-gram: (log10 probability, log10 weight of the next lower order after it)}.

    The highest order keeps its counts; lower ones count distinct letters before.
    """
    counts = _counts(texts, order)
    levels = [counts]
    for _ in range(order - 1):
        lower: dict[tuple, int] = {}
        for g in levels[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.insert(0, lower)
    prob: list[dict[tuple, float]] = []
    weight: dict[tuple, float] = {}
    for n, level in enumerate(levels, 1):
        total: dict[tuple, int] = {}
        kinds: dict[tuple, int] = {}
        for g, c in level.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        for ctx in total:
            weight[ctx] = DISCOUNT * kinds[ctx] / total[ctx]
        uniform = 1 / (len(levels[0]) + 1)
        prob.append({g: (c - DISCOUNT) / total[g[:-1]] + weight[g[:-1]] * (prob[-1][g[1:]] if n > 1 else uniform) for g, c in level.items()})
    return [{g: (np.log10(p), np.log10(weight.get(g, 1.0))) for g, p in level.items()} for level in prob]


def assemble(by_lang: dict[str, list[np.ndarray]], order: int = ORDER) -> Models:
    """Models of all languages in common sorted hash arrays.

    An n-gram that only another language has gets this language's back-off value, so one
    search answers for all languages.
    """
    langs = tuple(sorted(by_lang))
    tables = {lang: kneser_ney(by_lang[lang], order) for lang in langs}
    floor = np.array([np.log10(1 / (len(tables[lang][0]) + 1)) + tables[lang][0].get((), (0, 0))[1] for lang in langs])
    hashes, logp, back = [], [], []
    value: dict[tuple, np.ndarray] = {}
    weight: dict[tuple, np.ndarray] = {}
    for n in range(order):
        grams = sorted({g for lang in langs for g in tables[lang][n]})
        p = np.zeros((len(grams), len(langs)))
        b = np.zeros((len(grams), len(langs)))
        for i, g in enumerate(grams):
            for j, lang in enumerate(langs):
                hit = tables[lang][n].get(g)
                if hit:
                    p[i, j], b[i, j] = hit
                else:
                    p[i, j] = weight[g[:-1]][j] + value[g[1:]][j] if n else floor[j]
            value[g], weight[g] = p[i], b[i]
        h = gram_hashes(np.array(grams, np.uint64).reshape(-1), n + 1)[:: n + 1] if grams else np.zeros(0, np.uint64)
        at = np.argsort(h)
        hashes.append(h[at])
        logp.append(p[at].astype(np.float32))
        back.append(b[at].astype(np.float32))
    return Models(langs, tuple(hashes), tuple(logp), tuple(back), floor, 1.0)


def entropies(x: np.ndarray, m: Models) -> tuple[np.ndarray, int]:
    """(sum of log10 probabilities by language, letters scored) over a whole text, in pieces."""
    order = len(m.hashes)
    total, n = np.zeros(len(m.langs)), 0
    for at in range(0, max(1, len(x) - 1), PIECE):
        part = x[max(0, at + 1 - (order - 1)) : at + 1 + PIECE]
        first = min(at + 1, order - 1)
        ends = np.arange(first, len(part))
        n += len(ends)
        debt = np.zeros((len(ends), len(m.langs)))
        left = np.arange(len(ends))
        for k in range(order, 0, -1):
            long_enough = ends[left] >= k - 1
            able = left[long_enough]
            row = find(m.hashes[k - 1], gram_hashes(part, k)[ends[able] - k + 1])
            hit = row >= 0
            total += (debt[able[hit]] + m.logp[k - 1][row[hit]]).sum(axis=0)
            missed = able[~hit]
            if k > 1 and len(missed):
                c = find(m.hashes[k - 2], gram_hashes(part, k - 1)[ends[missed] - k + 1])
                debt[missed] += np.where((c >= 0)[:, None], m.back[k - 2][np.maximum(c, 0)] if len(m.back[k - 2]) else 0, 0)
            left = np.concatenate((left[~long_enough], missed))
            if not len(left):
                break
        total += (debt[left] + m.floor).sum(axis=0)
    return total, n


def sample_of(docs: DataFrame, allowed: Column, chars: int) -> DataFrame:
    """(lang, body): whole labelled texts by a hash of the id, about ``chars`` characters of each language.

    A language's share is drawn by comparing the hash with chars / total, so no group is
    gathered to choose from.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & allowed).select("doc_id", "lang", "text")
    totals = known.groupBy("lang").agg(F.sum(F.length("text")).alias("total")).limit(MOST + 1).collect()
    if len(totals) > MOST:
        raise ValueError(f"more than {MOST} languages")
    share = F.create_map(*[F.lit(x) for r in totals for x in (r.lang, chars / r.total)]) if totals else F.create_map().cast("map<string,double>")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.get(F.map_values(F.map_filter(share, lambda k, _: k == F.col("lang"))), F.lit(0)) * 1_000_000
    return known.where(drawn).select("lang", F.col("text").cast("binary").alias("body"))


def train(docs: DataFrame, allowed: Column, order: int = ORDER, chars: int = SAMPLE_CHARS) -> Models:
    """One task for each language counts its bounded sample; the models are assembled from n-gram tables.

    ``scale`` is calibrated on the sample: the margin per letter between the first and
    the second language, of which one in twenty correct answers has less.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, room = [], 2 * chars
        for body in sorted(pdf["body"], key=lambda b: (len(b), b)):
            x = letters(body)
            room -= len(x)
            if room >= 0 or not texts:
                texts.append(x[: 2 * chars])
        joined = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "letters": [joined.astype(np.int32).tobytes()]})

    got = sample_of(docs, allowed, chars).groupBy("lang").applyInPandas(run, "lang string, letters binary").collect()
    by_lang = {r.lang: [np.frombuffer(r.letters, np.int32).astype(np.uint64)] for r in got}
    made = assemble(by_lang, order)
    margins = []
    for lang, texts in by_lang.items():
        for at in range(0, min(len(texts[0]), 200_000), 200):
            total, n = entropies(texts[0][at : at + 200], made)
            if n and len(total) > 1:
                best = np.sort(total / n)
                if made.langs[int(np.argmax(total))] == lang:
                    margins.append(best[-1] - best[-2])
    scale = float(np.quantile(margins, 0.05)) if margins else 0.05
    return Models(made.langs, made.hashes, made.logp, made.back, made.floor, max(scale, 1e-3))


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text.

    The language with the lowest cross-entropy per letter is chosen; the score rises from
    0 to 1 with its margin over the second, and is 0.5 at the calibrated one, below which
    ``rejected`` holds. Null texts and those without a letter are ``und`` with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for body in bodies(batch):
                x = letters(body)
                if not len(x) or not models.langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total, n = entropies(x, models)
                order = np.argsort(-total, kind="stable")
                margin = (total[order[0]] - total[order[1]]) / n if len(total) > 1 else models.scale
                pred.append(models.langs[order[0]])
                score.append(float(margin / (margin + models.scale)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = octets(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < 0.5)


def languages(docs: DataFrame, order: int = ORDER, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), a row for each row of ``docs``.

    Learns from rows with a language whose fold of 4 is not 2; without any, all are ``und``.
    """
    models = train(docs, fold(F.col("doc_id"), 4) != 2, order, chars)
    return identify(docs, models).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every row of ``documents``."""
    return languages(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
