"""Hard negatives by a secondary sort: pair scores in packed keys, read as one stream an anchor."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, stored, table
from parcelbook.llm.vector_blocks import LOW, best_of, blocks, first, over_grid, products, whole_numbers

#: (anchor, descending score, positives before negatives, id), all big-endian, so bytes sort as the tuple does.
KEY, KEY_BYTES = ">QQBQ", 25
SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1
FOUND = "anchor long, score long, kind int, id long"


def packed_keys(pairs: DataFrame) -> DataFrame:
    """(key): each pair's anchor, score, kind and id in 25 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            anchor, score, kind, ids = (batch.column(c).to_numpy() for c in ("anchor", "score", "kind", "id"))
            out = np.empty((n, KEY_BYTES), np.uint8)
            flip = np.uint64(SIGN)
            for at, x in ((0, anchor.view(np.uint64) ^ flip), (8, ~(score.view(np.uint64) ^ flip)), (17, ids.view(np.uint64) ^ flip)):
                out[:, at : at + 8] = x.astype(">u8").view(np.uint8).reshape(n, 8)
            out[:, 16] = kind
            offsets = np.arange(n + 1, dtype=np.int32) * KEY_BYTES
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])], ["key"])

    return pairs.select("anchor", "score", "kind", "id").mapInArrow(run, "key binary")


def inside(positive: int, negative: int, low: int, high: int) -> bool:
    """Whether a negative's score lies in the window of a positive's, both in percent."""
    return low * positive <= 100 * negative <= high * positive


def streamed(keys: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Deal keys by anchor, sort within partitions, and read each partition once.

    A positive opens a window; a negative is put out for every open window that holds its
    score and is not full. Only an anchor's windows are held, never its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for key in batch.column("key").to_pylist():
                a, s, kind, ident = struct.unpack(KEY, key)
                if a != anchor:
                    anchor, windows = a, []
                score, ident = (2**64 - 1 - s) - SIGN, ident - SIGN
                if kind == POSITIVE:
                    if len(windows) < positives:
                        windows.append([ident, score, 0])
                    continue
                for w in windows:
                    if w[2] < negatives and inside(w[1], score, low, high):
                        w[2] += 1
                        out.append((a - SIGN, w[0], w[2], ident, w[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, F.substring("key", 1, 8)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: int) -> pa.Table:
    anchor, score, ident = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
    return pa.table({"anchor": anchor, "score": score, "kind": np.full(len(anchor), kind, np.int32), "id": ident})


def mine(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, embedding and a whole-number label; anchors are the ids that
    ``every`` divides, each compared with all rows. Scores are inner products of
    floor(256 * x), ties go to smaller ids. A first pass over the grid finds the anchors'
    positives; a second sends on, for each task and open window, the best ``negatives``
    alone: an anchor's stream is no longer than windows x negatives x tasks, with every row
    that the result can need. Positives of negative score have no window.

    Rows with a null id, label, vector or component, or a non-finite one, take no part;
    rows that share an id count as one (``whole_numbers``); an empty table gives no rows.
    """
    rows = whole_numbers(vectors, "label")
    anchors = stored(whole_numbers(vectors.where(F.col("vec_id") % every == 0), "label"), "anchors")
    table_blocks = blocks(rows)

    def like(a: list[np.ndarray], group: list[list[np.ndarray]]) -> pa.Table:
        parts = []
        for ids, v, label in group:
            s = products(a[1], v)
            s[(a[2] != label.T) | (a[0][:, None] == ids[None])] = LOW
            r, c = first(s, ids, positives)
            parts.append((r, s[r, c], ids[c]))
        r, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        r, at = best_of(r, score, ids, positives, np.arange(len(r)))
        return found([(a[0][r], score[at], ids[at])], POSITIVE)

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = over_grid(blocks(anchors), table_blocks, like, FOUND).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = stored(near.drop("place"), "positives")
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("positive_scores"))
    armed = anchors.join(scores, anchors.vec_id == scores.anchor).select("vec_id", "label", "positive_scores", "v")

    def unlike(a: list[np.ndarray], group: list[list[np.ndarray]]) -> pa.Table:
        parts = []
        for ids, v, label in group:
            s = products(a[1], v)
            other = a[2] != label.T
            picked: list[np.ndarray] = []
            for p in range(a[3].shape[1]):
                own = a[3][:, p].astype(object)
                least, most = (-((-low * own) // 100)).astype(np.int64), (high * own // 100).astype(np.int64)
                held = np.where(other & (s >= least[:, None]) & (s <= most[:, None]), s, LOW)
                r, c = first(held, ids, negatives)
                picked.append(r * len(ids) + c)
            r, c = np.divmod(np.unique(np.concatenate(picked)), len(ids))
            parts.append((a[0][r], s[r, c], ids[c]))
        return found(parts, NEGATIVE)

    far = over_grid(blocks(armed, ("positive_scores",)), table_blocks, unlike, FOUND)
    return streamed(packed_keys(near.unionByName(far)), positives, negatives, low, high)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all; every seventh has the next label."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")), 100)


WHOLE_SQL = """SELECT vec_id{more}, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL{where} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
QUERIES: dict[str, Query] = {"op11_hard_negatives": op11_hard_negatives}
ORACLES: dict[str, str] = {
    "op11_hard_negatives": f"""WITH x AS MATERIALIZED ({WHOLE_SQL.format(more=", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", where=" AND label IS NOT NULL")}),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM x a JOIN x c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    w AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
      FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10"""
}
