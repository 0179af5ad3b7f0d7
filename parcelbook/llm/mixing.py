"""Mixing to target weights by soft membership: domain posteriors and projected-gradient rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, octets, stored, table
from parcelbook.llm.toxicity import Weights, distinct_features, portions, train

#: Fixed targets of the query: share of all tokens by domain.
TARGETS = {"high": 0.9, "low": 0.09, "toxic": 0.01}
SAMPLE = 4000
RIDGE = 1e-3
ROUNDS = 60


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def posteriors(docs: DataFrame, models: dict[str, Weights]) -> DataFrame:
    """(doc_id, n_tokens, p): whole texts' words and domain posteriors, in the order of ``models``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.stack([w.dense() for w in models.values()], axis=1)
        active = (dense != 0).any(axis=1)
        bias = np.array([w.bias for w in models.values()])
        for batch in batches:
            n, p = [], []
            for texts in portions(batch):
                words, text, number = distinct_features(texts, active)
                n += words.tolist()
                for weights in np.split(dense[number], np.searchsorted(text, np.arange(1, len(texts)))):
                    logit = np.clip(bias + weights.sum(axis=0), -30, 30)
                    e = np.exp(logit - logit.max())
                    p.append(e / e.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return octets(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, p array<double>")


def rates(p: np.ndarray, residuals: list[np.ndarray], step: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(rate, point of the next gradient) of each document, replayed from the residuals so far.

    A document's rate depends on its own posterior and on the residuals of the rounds
    alone, so no state of the size of the corpus is kept between rounds.
    """
    rate = point = np.ones(len(p))
    momentum = 1.0
    for r in residuals:
        new = np.maximum(0.0, point - step * (p @ r + ridge * (point - 1)))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        point = new + (momentum - 1) / after * (new - rate)
        rate, momentum = new, after
    return rate, point


def fit_rates(rows: DataFrame, target: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS, tolerance: float = 1e-7) -> tuple[list[np.ndarray], float]:
    """Residuals of each round and the step, for rows (n_tokens, p).

    Minimises |sum_i w_i p_i r_i - target|^2 / 2 + ridge * sum_i w_i (r_i - 1)^2 / 2 over
    r >= 0, w_i being a document's share of the tokens. Each round is one distributed sum
    of as many numbers as there are domains.
    """
    d = len(target)
    first = rows.select("n_tokens", *[F.col("p")[i].alias(f"p{i}") for i in range(d)])
    total, *grams = first.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(d) for j in range(d)]).first()
    if not total:
        return [], 1.0
    step = 1 / (float(np.linalg.eigvalsh(np.array(grams, float).reshape(d, d) / total)[-1]) + ridge)
    residuals: list[np.ndarray] = []

    def run(held: list[np.ndarray]):
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    p = np.stack(pdf["p"].to_numpy())
                    rate, point = rates(p, held, step, ridge)
                    w = pdf["n_tokens"].to_numpy() / total
                    yield pd.DataFrame([[*(w * point @ p), float(w @ (point - rate) ** 2)]], columns=[*(f"s{i}" for i in range(d)), "moved"])

        return part

    schema = ", ".join([*(f"s{i} double" for i in range(d)), "moved double"])
    for _ in range(rounds):
        sums = rows.select("n_tokens", "p").mapInPandas(run(list(residuals)), schema).agg(*[F.sum(f"s{i}") for i in range(d)], F.sum("moved")).first()
        new = np.array(sums[:d]) - target
        if residuals and np.abs(new - residuals[-1]).max() < tolerance:
            break
        residuals.append(new)
    return residuals, step


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], allowed: Column | None = None, size: int = SAMPLE, ridge: float = RIDGE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies), a row for each row of ``docs``.

    ``labelled`` has (doc_id, domain); a classifier for each domain learns from at most
    ``size`` labelled rows. ``rate`` is how often the document is to be used so that the
    expected tokens of each domain come close to ``targets`` (shares of all tokens), and
    ``copies`` is the rate rounded up or down by a hash of the id. No row is dropped; a
    rate may be 0. Null and empty texts have no tokens and the prior's posterior; without
    labels posteriors are even. Repeated rows count as often as they stand there.
    """
    names = sorted(targets)
    models = {}
    for name in names:
        marked = labelled.select("doc_id", (F.col("domain") == name).cast("int").alias("own"))
        models[name] = train(docs, marked, "own", allowed, size)
    known = stored(posteriors(docs, models), "posteriors")
    residuals, step = fit_rates(known, np.array([targets[n] for n in names]), ridge, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("p").to_pylist(), float).reshape(batch.num_rows, len(names))
            rate, _ = rates(p, residuals, step, ridge)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), pa.array([names[b] for b in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(rate)],
                ["doc_id", "n_tokens", "domain", "posterior", "rate"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = known.mapInArrow(run, f"doc_id {kind}, n_tokens long, domain string, posterior double, rate double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    return out.withColumn("copies", F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of every row of ``documents`` for TARGETS."""
    return mix_to_targets(table(spark, folder, "documents"), labelled_domains(table(spark, folder, "labels")), TARGETS)


QUERIES: dict[str, Query] = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
