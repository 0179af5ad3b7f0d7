"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, drop_stored, octets, stored, table, tasks_for
from parcelbook.llm.components import components

PIECE = 1 << 15
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
RADIUS = 2
GROUP = 1024


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Every run of ``width`` words, space-joined; the whole sequence if it is shorter."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle, repeats included, in pieces of a long text."""
    for at in range(0, max(1, len(words) - width + 1), PIECE):
        part = shingles(words[at : at + PIECE + width - 1], width)
        yield np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), np.uint64, len(part))


def fingerprint(words: list[bytes], width: int) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words, width):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprint of each whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(b.lower().split(), width) for b in bodies(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return octets(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _leaders() -> np.ndarray:
    """Error pattern of at most 3 bits for each of the 2048 syndromes; the code is perfect."""
    unit = _units()
    out = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            out[np.bitwise_xor.reduce(unit[list(bits)])] = sum(1 << b for b in bits)
    return out


def _units() -> np.ndarray:
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r = r << 1 ^ (GENERATOR if r & 1024 else 0)
    return np.array(out)


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """[n, 24] indices of the Golay codewords nearest to each 23-bit word and to its 23 neighbours.

    Two words that differ in at most 2 bits have a common neighbour (or are neighbours),
    so they share an index. A word has one index or six.
    """
    flips = np.concatenate(([0], 1 << np.arange(23)))
    near = segment[:, None] ^ flips[None, :]
    unit, syndrome = _units(), np.zeros(near.shape, np.int64)
    for bit in range(23):
        syndrome ^= np.where(near >> bit & 1, unit[bit], 0)
    return (near ^ _leaders()[syndrome]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): of two or fewer errors some segment has none, and every one at most two.

    So a key joins one exact segment with one codeword index of the next segment; up to
    18 keys for each fingerprint.
    """
    rows, out = [], []
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for a in range(3):
        near = np.sort(codeword_indices(parts[(a + 1) % 3]), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        out.append((a << 40) | (parts[a][r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            r, k = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r].view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a small group as all its pairs within ``radius`` would."""
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
    root = np.arange(len(fp))
    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = i, j
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((i, j))
        root[i] = root[j] = min(x, y)
    chosen = np.array(kept, np.int64).reshape(-1, 2)
    return fp[chosen[:, 0]], fp[chosen[:, 1]]


def links(fps: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp), with the components of all pairs within ``radius`` (2 at most).

    Fingerprints that share a key meet sorted in one task, which compares a group of at
    most ``group`` and returns a forest of its links, never all pairs. Members of larger
    groups go another exact way: each is sent to the 65 words within one bit of it, and
    any two within two bits share such a word, where at most 65 can meet.
    """
    if radius > RADIUS:
        raise ValueError(f"keys guarantee {RADIUS} bits at most")
    rows = stored(keyed(fps), "keys")
    large = rows.groupBy("key").count().where(F.col("count") > group).select("key")
    crowded = rows.join(large, "key", "left_semi").select("fp").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            found = [_forest(f[s:e], radius) for s, e in zip(cut[:-1], cut[1:], strict=True) if e - s > 1]
            a = np.concatenate([x for x, _ in found] + [np.zeros(0, np.uint64)])
            b = np.concatenate([y for _, y in found] + [np.zeros(0, np.uint64)])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate((held_k, batch.column("key").to_numpy()))
            f = np.concatenate((held_f, batch.column("fp").to_numpy().view(np.uint64)))
            if len(k):
                open_at = int(np.searchsorted(k, k[-1]))
                yield done(k[:open_at], f[:open_at])
                held_k, held_f = k[open_at:], f[open_at:]
        if len(held_k):
            yield done(held_k, held_f)

    spark = fps.sparkSession
    small = rows.join(large, "key", "left_anti")
    dealt = small.repartition(tasks_for(rows.count(), 2_000_000, spark), "key").sortWithinPartitions("key", "fp")
    near = dealt.mapInArrow(run, "a long, b long")
    words = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = crowded.select("fp", F.explode(words).alias("word"))
    first = balls.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    within = balls.join(first, "word").where("fp != a").select("a", F.col("fp").alias("b"))
    return stored(near.union(within).distinct(), "near")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, and those
    without words (null, empty) have fingerprint zero and are linked like any other. The
    component is the smallest doc_id reachable; null ids count last. Repeated rows agree.
    """
    spark = docs.sparkSession
    marks = stored(fingerprints(docs, width), "marks")
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = links(first.select("fp"), radius, group)
    roots = components(found)
    placed = first.join(roots, first.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(smallest, "root").select("fp", "component_id")
    drop_stored(found)
    return marks.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every row of ``documents``."""
    return near_duplicates(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
