"""Exact deduplication as a stream over keyed state on disk that never expires."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, stored, table
from parcelbook.session import discard, scratch_path

STATE = "spark.sql.streaming.stateStore."
#: Keyed state on disk; many small stores must not reserve disk ahead.
ON_DISK = {
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE + "rocksdb.allowFAllocate": "false",
    STATE + "rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in ON_DISK}
    for key, value in ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def absorb(marks: DataFrame, state: str, files_per_batch: int = 256) -> DataFrame:
    """Stream (doc_id, digest, n_bytes) rows into the keyed state below ``state``.

    The state holds for each digest the id that stays (the largest), the number of rows
    and where to find the content: that id in the table of documents. It has no
    watermark, so nothing expires, and it lies in RocksDB with its log in the shared
    folder; a later call with the same ``state`` goes on from it. Rows of a digest are
    combined before the shuffle, so a hot digest sends one row from each task.
    Returns the digests this call touched: (digest, keep_id, group_size).
    """
    spark = marks.sparkSession
    inbox, out = f"{state}/inbox", f"{state}/out/{scratch_path(spark, 'run').rsplit('-', 1)[1]}"
    marks.write.mode("append").parquet(inbox)

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with _state_on_disk(spark):
        arriving = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
        kept = arriving.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        run = kept.writeStream.outputMode("update").option("checkpointLocation", f"{state}/log").trigger(availableNow=True).foreachBatch(save).start()
        run.awaitTermination()
    touched = spark.read.schema("digest string, keep_id long, group_size long, batch int").parquet(out)
    return touched.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))


def deduplicate(docs: DataFrame, digest: Column | None = None, files_per_batch: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when identical byte by byte; null counts as empty. Of equal texts the
    largest doc_id stays. Rows that repeat id and text are all marked as kept; a null id
    never stays beside another id and is not kept. ``digest`` may replace SHA-256 as the
    state's key: every digest that was hit twice has its full texts compared, and texts
    that differ behind one digest stay apart.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.sha2(F.col("text").cast("binary"), 256)
    rows = rows.withColumn("text_sha256", key).withColumn("digest", key if digest is None else digest)
    marks = stored(rows.select("doc_id", "digest", "text_sha256"), "marks")
    state = scratch_path(spark, "state")
    groups = stored(absorb(marks.select("doc_id", "digest"), state, files_per_batch), "groups")
    discard(spark, state)
    # full bytes: equal texts meet as one row from each task, before any join deals them by digest
    texts = rows.groupBy("digest", "text").agg(F.max("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_size"), F.first("text_sha256").alias("text_sha256"))
    hit = groups.where("group_size > 1").select("digest")
    apart = stored(texts.select("digest", "text_sha256", "own_id", "own_size").join(hit, "digest", "left_semi"), "texts")
    split = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    own = apart.join(split.select("digest"), "digest", "left_semi")
    keep = F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_id"))
    return (
        marks.join(groups, "digest")
        .join(own, ["digest", "text_sha256"], "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("own_size", "group_size").alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "text_sha256")
    )


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies of every row and whole text of ``documents``."""
    return deduplicate(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               coalesce(doc_id = max(doc_id) over same, false) as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))"""
}
