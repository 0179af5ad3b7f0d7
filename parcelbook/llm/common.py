"""Helpers shared by the corpus operators: inputs, held-out folds and word hashes."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.session import discard, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def octets(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more.., body): whole texts as UTF-8 bytes, null counting as empty.

    Other columns go, so that none can clash with those an operator adds.
    """
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced table to the shared folder and read it back, so lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished jobs now, so that Spark's cleaner deletes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def tasks_for(rows: int, per_task: int, spark: SparkSession) -> int:
    """Shuffle tasks so that one holds ``per_task`` rows on average, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def word_hashes(words: Collection[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bodies(batch: pa.RecordBatch, column: str = "body") -> Iterator[bytes]:
    """Texts of a batch one by one; the whole batch is never a Python list."""
    data = batch.column(column)
    for i in range(len(data)):
        yield data[i].as_py() or b""
