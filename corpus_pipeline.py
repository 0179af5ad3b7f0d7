"""Corpus pipeline: toxicity, exact and near copies, benchmark leaks, mixing weights.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is
written as Parquet and read again before the next. All but the last return the columns
of documents; the last adds rates. Rows with a null id pass the stages that compare
documents; other columns, nulls and empty tables are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import fold, stored, table
from parcelbook.llm.decontaminate import leaks
from parcelbook.llm.exact_dedup import deduplicate
from parcelbook.llm.mixing import TARGETS, labelled_domains, mix_to_targets
from parcelbook.llm.near_groups import one_of_each_group
from parcelbook.llm.toxicity import train, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    weights = train(docs, table(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 5) != 0)
    return without_toxic(docs, weights)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows that repeat id and text, one."""
    kept = stored(deduplicate(docs).where("kept").select(F.col("doc_id").alias("own_id"), "text_sha256").distinct(), "kept")
    digest = F.sha2(F.coalesce(docs.text, F.lit("")).cast("binary"), 256)
    own = docs.join(kept, (docs.doc_id == kept.own_id) & (digest == kept.text_sha256), "left_semi")
    return own.dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id is null"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark nearly whole."""
    found = stored(leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    return docs.join(found, docs.doc_id == found.leaked, "left_anti")


def add_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with domain, rate and copies that bring domain tokens to the targets."""
    mixed = mix_to_targets(docs, labelled_domains(table(spark, sf_dir, "labels")), TARGETS)
    rates = stored(mixed.select(F.col("doc_id").alias("own_id"), "n_tokens", "domain", "posterior", "rate", "copies").dropDuplicates(["own_id"]), "rates")
    return docs.join(rates, docs.doc_id.eqNullSafe(rates.own_id)).drop("own_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", add_rates),
]
#: No stage but exact dedup can be said in SQL; tests compare the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
