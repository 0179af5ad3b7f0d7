"""Parquet scans, table replacement, declared-schema publishing and namespaces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelbook.session import discard


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _swap(spark: SparkSession, staged_name: str, path: str) -> None:
    """Move the table at ``path`` aside and the staged one there; atomic renames on HDFS only."""
    jvm = spark._jvm
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged_name, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move the previous table of {path}")
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if fs.exists(old):
        fs.delete(old, True)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace a Parquet table and return it as read back; a failed job leaves the old one."""
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(staged)
    _swap(df.sparkSession, staged, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


POINTER = "CURRENT"


def publish_version(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> DataFrame:
    """Write a new version of a table and point to it; returns the version as read back.

    A version is a folder of its own below ``path`` that is written whole; then one small
    object, the pointer, is replaced. So a reader sees one version or the other in object
    stores too, where renaming a folder is no single step, and a failed job leaves the old
    one. The last ``keep`` versions stay for readers that have begun; older ones go.
    """
    spark = df.sparkSession
    versions = current_versions(spark, path)
    name = f"v{int(versions[-1].split('-')[0][1:]) + 1 if versions else 1:012d}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/{name}")
    _point(spark, path, name)
    for old in versions[: max(0, len(versions) + 1 - keep)]:
        discard(spark, f"{path.rstrip('/')}/{old}")
    return spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/{name}")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The version a table's pointer names; every later read of the frame stays with it."""
    lines = spark.read.text(f"{path.rstrip('/')}/{POINTER}").collect()
    return spark.read.parquet(f"{path.rstrip('/')}/{lines[0][0]}")


def current_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's versions, the oldest first, whole or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("v"))


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Replace the pointer in one step: a new small object is renamed over the old one."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    spare = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}")
    out = spare.getFileSystem(conf).create(spare, True)
    out.writeBytes(name)
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(spare, target, over)


def schema_drift(df: DataFrame, declared: T.StructType) -> list[str]:
    """Differences between a table and its declared schema, by name and type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in declared}
    return [
        f"{name}: declared {want.get(name, 'absent')}, found {have.get(name, 'absent')}"
        for name in sorted(have.keys() | want.keys())
        if have.get(name) != want.get(name)
    ]


def publish(df: DataFrame, declared: T.StructType, path: str, versioned: bool = False) -> DataFrame:
    """Cast to a declared schema, write next to the target and swap by rename, or as a new version.

    Readers see the old table or the new one; a failed job leaves the old table. In an
    object store only ``versioned`` (``publish_version``) keeps that promise.
    """
    missing = [f.name for f in declared if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for publish: {missing}")
    spark = df.sparkSession
    shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared])
    if versioned:
        return publish_version(shaped, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    shaped.write.mode("error").parquet(staged)
    _swap(spark, staged, path)
    return spark.read.schema(declared).parquet(path)


def attach(spark: SparkSession, namespace: str, tables: dict[str, str], location: str) -> str:
    """One new namespace for a source set, whose name is returned; tables stay where their files are.

    The name is unique to the call, so no table that exists is touched.
    """
    own = f"{namespace}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {own} LOCATION '{location}'")
    for name, path in tables.items():
        spark.sql(f"CREATE TABLE {own}.{name} USING parquet LOCATION '{path}'")
    return own


@contextmanager
def attached(spark: SparkSession, namespaces: dict[str, dict[str, str]], location: str) -> Iterator[dict[str, str]]:
    """Namespaces for the time of a block: name -> the unique name to use in SQL.

    A query made inside may run after the block, as its tables are resolved when it is
    made; the catalog is left as it was, and so are the tables' files.
    """
    own = {name: attach(spark, name, tables, f"{location.rstrip('/')}/{name}") for name, tables in namespaces.items()}
    try:
        yield own
    finally:
        for name in own.values():
            spark.sql(f"DROP SCHEMA {name} CASCADE")


def compose(spark: SparkSession, named: dict[str, DataFrame], sql: str, **args) -> DataFrame:
    """Run SQL over named sub-queries, written ``{name}`` in it; no view of the session is replaced."""
    values = {f"{k}": v for k, v in args.items()}
    return spark.sql(sql, args=values or None, **named)


def constant_rows(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Every row of ``df`` once per literal row, by exploding a constant array."""
    literal: Column = F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]
    )
    return df.withColumn("_row", F.explode(literal)).select(
        *df.columns, *[F.col("_row")[n].alias(n) for n in names]
    )
