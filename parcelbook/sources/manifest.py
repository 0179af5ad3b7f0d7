"""Input pins: hashes of files, comparison with pins, snapshot age."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.session import settle

if TYPE_CHECKING:
    from pyarrow import fs

_BLOCK = 1 << 22
#: Files of up to this length are held whole by Spark's reader; eight such tasks fit a heap of 1 GB.
_WHOLE = 1 << 24


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, content, source): the files at or below the paths; source is the listed file or folder."""
    depths: dict[int, list[str]] = {}
    for one in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(one)
        depths.setdefault(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).depth(), []).append(one)
    found = []
    for depth, own in depths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(own)
        source = F.regexp_extract("path", rf"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?(/[^/]+){{{depth}}}", 0)
        found.append(files.select("path", "length", "content", source.alias("source")))
    return reduce(DataFrame.unionByName, found)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in Spark's writing, as Python opens it, and the path there."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _reached(spark: SparkSession, path: str) -> bool:
    """Whether Python opens the store of a path too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        _store(at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().toString())
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256, source, file), read once in fixed blocks.

    Files are dealt to tasks by their length, as the listing has them, and a large one has a
    task of its own. Only paths come from the listing, so a file larger than memory is fine.
    The table is settled: however often it is used, files are read once. Only wanted paths
    should be given, as every listed file is hashed.
    """
    listing = _listed(spark, paths).select("path", "length", "source")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                source, inner = _store(path)
                h = hashlib.sha256()
                with source.open_input_stream(inner) as stream:
                    while block := stream.read(_BLOCK):
                        h.update(block)
                found.append((path, length, h.hexdigest()))
            yield pd.DataFrame(found, columns=["path", "length", "sha256"]).assign(source=batch["source"].to_numpy())

    hashed = listing.mapInPandas(digest, "path string, length long, sha256 string, source string")
    return settle(hashed.withColumn("file", F.element_at(F.split("path", "/"), -1)))


def _by_position(listing: DataFrame) -> DataFrame:
    """(path, sha256, source), each file read by position in fixed blocks up to its end."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                store, inner = _store(path)
                h, at = hashlib.sha256(), 0
                with store.open_input_file(inner) as file:
                    while block := file.read_at(_BLOCK, at):
                        h.update(block)
                        at += len(block)
                found.append(h.hexdigest())
            yield batch.assign(sha256=found)[["path", "sha256", "source"]]

    return listing.select("path", "source").mapInPandas(digest, "path string, sha256 string, source string")


def pins_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sha256, path, source) by Spark's own reader, through any Hadoop store.

    That reader holds a file whole and takes 2 GB at most, so files over 16 MB are read by
    position where Python opens their store too: any length, in constant memory. In a store that
    only Spark opens all files are held whole.
    """
    given = [paths] if isinstance(paths, str) else paths
    reached = [one for one in given if _reached(spark, one)]
    whole, hashed = [], []
    if reached:
        files = _listed(spark, reached)
        whole.append(files.filter(F.col("length") <= _WHOLE))
        hashed.append(_by_position(files.filter(F.col("length") > _WHOLE)))
    if other := [one for one in given if one not in reached]:
        whole.append(_listed(spark, other))
    hashed += [files.select("path", F.sha2("content", 256).alias("sha256"), "source") for files in whole]
    return reduce(DataFrame.unionByName, hashed).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "path", "source")


def by_source(hashes: DataFrame) -> DataFrame:
    """(file, sha256), a row for each listed entry of (path, sha256, source), be it a file or a folder of files.

    A file keeps its hash. A folder's is that of the hashes and names of all its files, the
    names below the folder and in their order; so files of equal name in two folders are
    told apart. Names and hashes of one folder are held together, contents never.
    """
    inside = F.expr("substring(path, length(source) + 1)")
    held = hashes.groupBy("source").agg(F.sort_array(F.collect_set(F.struct(inside.alias("name"), "sha256"))).alias("f"))
    lines = F.array_join(F.transform("f", lambda x: F.concat(x["sha256"], F.lit(" "), x["name"])), "\n")
    alone = (F.size("f") == 1) & (F.col("f")[0]["name"] == "")
    return held.select(F.element_at(F.split("source", "/"), -1).alias("file"), F.when(alone, F.col("f")[0]["sha256"]).otherwise(F.sha2(lines, 256)).alias("sha256"))


def compare_to_pins(hashes: DataFrame, pins: DataFrame) -> DataFrame:
    """Status per file: ok, mismatched, missing (pinned only) or unpinned (found only)."""
    h = hashes.select("file", F.col("sha256").alias("found"))
    p = pins.select("file", F.col("sha256").alias("pinned"))
    return h.join(p, "file", "full").select(
        "file",
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("pinned").isNull(), "unpinned")
        .when(F.col("found") == F.col("pinned"), "ok")
        .otherwise("mismatched")
        .alias("status"),
    )


def snapshot_age(snapshot: Column, today: Column) -> Column:
    """Days since the snapshot; null when missing or not a date."""
    return F.datediff(today, snapshot.try_cast("date"))


def stale_outputs(stamps: DataFrame, hashes: DataFrame) -> DataFrame:
    """Outputs whose stamped input hashes differ from the current ones."""
    joined = stamps.join(
        hashes.select("file", F.col("sha256").alias("_now")), "file", "left"
    )
    return joined.groupBy("output").agg(
        F.count_if(F.col("_now").isNull() | (F.col("_now") != F.col("sha256"))).alias("changed_inputs"),
        F.count("*").alias("inputs"),
    ).withColumn("state", F.when(F.col("changed_inputs") > 0, "stale").otherwise("fresh"))
