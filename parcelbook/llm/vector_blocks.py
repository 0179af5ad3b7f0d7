"""Whole-number vectors in packed blocks, and the grid that deals query blocks by row blocks to tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelbook.llm.common import stored
from parcelbook.llm.store import pack, unpack

#: Numbers in a block, and row blocks in a cell of the grid: they bound what a task holds.
VALUES, BLOCKS = 1 << 18, 16
LOW = -(2**63) + 1


def whole_numbers(vectors: DataFrame, *extra: str) -> DataFrame:
    """(vec_id, extra.., v): floor(256 * x) of each component of the rows that take part.

    Rows with a null id, a null extra column, a null vector or a null or non-finite
    component take none. ``vec_id`` is the key: of rows that share one, the smallest by
    extra columns, then vector, counts. Other columns go, so that none can clash.
    """
    real = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    present = F.col("embedding").isNotNull()
    for name in ("vec_id", *extra):
        present &= F.col(name).isNotNull()
    ints = F.transform(real, lambda x: F.floor(x * 256))
    rows = vectors.where(present).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(*[F.col(c).cast("long").alias(c) for c in extra], ints.alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of equal width; what a shorter list lacks counts as zero."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def compact(a: np.ndarray) -> np.ndarray:
    most = int(max(a.max(initial=0), -a.min(initial=0)))
    return a.astype(next(t for t, top in ((np.int8, 127), (np.int16, 32767), (np.int32, 2**31 - 1), (np.int64, 2**63 - 1)) if most <= top))


def blocks(rows: DataFrame, lists: tuple[str, ...] = (), make: Callable[[np.ndarray], list[np.ndarray]] | None = None) -> DataFrame:
    """(number, payload): rows of ``whole_numbers`` packed, ids in order; written once.

    A payload holds ids, vectors, other columns (each a number a row, or ``lists`` of
    them) and what ``make`` adds to the vectors. No block holds more than VALUES numbers
    of vectors, save one row that is longer.
    """
    others = [c for c in rows.columns if c not in ("vec_id", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            step = max(1, VALUES // max(1, int(length.max())))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids = piece.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                width = max(1, int(piece.column("v").value_lengths().to_numpy(zero_copy_only=False).max()))
                v = matrix(piece.column("v"), width)[order]
                more = []
                for c in others:
                    col = piece.column(c)
                    m = matrix(col, max(1, int(col.value_lengths().to_numpy(zero_copy_only=False).max()))) if c in lists else col.to_numpy()[:, None]
                    more.append(m[order])
                made = make(v) if make else []
                flat = [x for m in (v, *more, *made) for x in (np.array([m.shape[1]], np.int64), compact(m.ravel()) if m.dtype == np.int64 else m.ravel())]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([pack(ids[order], *flat)], pa.binary())], ["part", "seq", "payload"])
                seq += 1

    packed = stored(rows.select("vec_id", "v", *others).mapInArrow(run, "part int, seq int, payload binary"), "blocks")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    return packed.select((F.col("seq").cast("long") * parts + F.col("part")).alias("number"), "payload")


def opened(payload: bytes) -> list[np.ndarray]:
    """[ids, vectors, other columns.., made..] of a block."""
    ids, *flat = unpack(payload)
    return [ids, *[values.reshape(len(ids), int(width[0])) for width, values in zip(flat[::2], flat[1::2], strict=True)]]


def over_grid(queries: DataFrame, rows: DataFrame, visit: Callable[[list[np.ndarray], list[list[np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """``visit`` on every block of queries with every group of row blocks.

    A cell of the grid is a block of queries and at most BLOCKS row blocks on average;
    row blocks go to one cell of each query block, so the pairs themselves are never rows.
    """
    spark = rows.sparkSession
    last = queries.agg(F.max("number")).first()[0]
    n = rows.count()
    cells = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / BLOCKS))))
    left = queries.select(F.col("number").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "payload")
    many = F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))
    right = rows.select(F.explode(many).alias("q"), F.pmod("number", F.lit(cells)).cast("int").alias("cell"), "number", "payload")
    kinds = spark.createDataFrame([], schema).toArrow().schema

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        return visit(opened(a.column("payload")[0].as_py()), [opened(x.as_py()) for x in b.column("payload")]).cast(kinds)

    return left.groupBy("q", "cell").cogroup(right.groupBy("q", "cell")).applyInArrow(run, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all of ``b``; those beyond 64 bits raise."""
    width = min(a.shape[1], b.shape[1])  # what one lacks counts as zero
    a, b = a[:, :width], b[:, :width]
    top = width * int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0))
    if top >= 2**63:
        raise ValueError("inner products of these vectors do not fit in 64 bits")
    kind = np.float64 if top < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of each row, ties to smaller ids; LOW takes no part."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), LOW)
    r, c = np.nonzero((scores >= least[:, None]) & (scores > LOW))
    return best_of(r, scores[r, c], ids[c], k, c)


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and carried value of the first ``k`` entries of each group by score, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return g[place < k], carried[order][place < k]
