"""Repeated passages by a logarithmic family of sparse suffix arrays.

A 50-byte string has a head: the 20-byte string in it with the smallest hash. Equal strings
have equal heads, so a suffix array need only hold the suffixes that start at a head. A
batch of documents gets such a sorted array; it is scanned in step with the arrays of the
levels that exist, and levels of about equal size merge. Heads that two documents share
lead to the strings around them, which are then compared byte by byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, drop_stored, mix, octets, release, stored, table
from parcelbook.llm.store import pack, unpack

SPAN = 50
HEAD = 20
BLOCK = 1 << 18
CHUNK = 1 << 21
CROWD = 100_000
BYTES_PER_BUCKET = 64_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
BATCHES = 3
NEW, FLAG, LEVEL = 0, 1, 2


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` bytes, put together from runs of powers of two."""
    part, power = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), int(STEP)
    out, done, n = None, 0, 1
    while n <= k:
        if k & n:
            if out is None:
                out = part
            else:
                size = len(buf) - done - n + 1
                out = part[:size] * np.uint64(pow(int(STEP), done, 1 << 64)) + out[n : n + size]
            done += n
        if n * 2 <= k:
            part = part[:-n] * np.uint64(power) + part[n:]
            power = power * power % (1 << 64)
        n *= 2
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    best = x
    while n * 2 <= w:
        best = np.minimum(best[:-n], best[n:])
        n *= 2
    size = len(x) - w + 1
    return np.minimum(best[:size], best[w - n : w - n + size])


def heads(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, n, head): runs of ``n`` strings of SPAN bytes, from ``start`` on, with the same head.

    ``buf`` holds several texts one after the other and ``ends`` where each ends; starts
    count from the beginning of ``buf``. Strings never cross texts.
    """
    found = []
    for at in range(0, len(buf) - SPAN + 1, BLOCK):
        part = buf[at : at + BLOCK + SPAN - 1]
        low = sliding_min(rolling(part, HEAD), SPAN - HEAD + 1)
        i = np.arange(at, at + len(low))
        text = np.searchsorted(ends, i, side="right")
        inside = i + SPAN <= ends[text]
        change = np.ones(len(low), bool)
        change[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        n = np.diff(np.append(first, len(low)))
        ok = inside[first]
        found.append((text[first[ok]], i[first[ok]], n[ok], low[first[ok]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, first row, joined bytes, ends) of consecutive rows of about CHUNK bytes."""
    for batch in batches:
        texts, held, first = [], 0, 0
        for i, body in enumerate(bodies(batch)):
            texts.append(body)
            held += len(body)
            if held >= CHUNK or i == batch.num_rows - 1:
                yield batch, first, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
                texts, held, first = [], 0, i + 1


def _bucketed(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, np.int64)
    blocks = [pack(*[a[order[lo:hi]] for a in arrays]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]].astype(np.int32)), pa.array([kind] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "kind", "block"])


def sorted_heads(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, block): sorted heads of each chunk of texts, one document for each head.

    A head that two documents of a chunk share is flagged for all of them at once and
    goes on as one entry, so a head that every document has sends one entry a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, buf, ends in _chunks(batches):
            ids = batch.column("doc_id").slice(first, len(ends)).to_numpy()
            text, _, _, head = heads(buf, ends)
            doc = ids[text]
            order = np.lexsort((doc, head))
            h, d = head[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(start, len(h)))
            many = np.repeat(n > 1, n)
            entry = h[start]
            yield _bucketed((entry % np.uint64(buckets)).astype(np.int64), NEW, entry, d[start], (n > 1).astype(np.uint8))
            if many.any():
                yield _bucketed((mix(d[many].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), FLAG, d[many], h[many])

    return docs.mapInArrow(run, "bucket int, kind int, block binary")


def _joined(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of several blocks sorted by head, one for each head and document."""
    parts = [unpack(b) for b in blocks]
    h, d, m = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((d, h))
    return h[order], d[order], m[order].astype(bool)


def _shared(h: np.ndarray, d: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether another document has the head of each entry."""
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(h)))
    if not len(h):
        return np.zeros(0, bool)
    last = start + n - 1
    any_many = np.maximum.reduceat(m, start)
    return np.repeat(any_many | (d[last] != d[start]), n)


class SuffixIndex:
    """Levels of sorted heads in the shared folder; batches of documents are added one after the other.

    ``add`` returns nothing; ``flagged`` has (doc, head) of every head that two documents
    added so far share, for the earlier and the later document alike. Documents of
    different batches need different ids.
    """

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[float, DataFrame]] = []
        self.parts: list[DataFrame] = []

    def add(self, docs: DataFrame, size: float, keep: bool = True) -> None:
        """``docs`` has doc_id (long, not null) and body; ``size`` is its size in any unit."""
        merged, total = [], size
        while keep and self.levels and self.levels[-1][0] <= 1.5 * total:
            merged.append(self.levels.pop())
            total += merged[-1][0]
        old = [(t, True) for _, t in merged] + [(t, False) for _, t in self.levels]
        rows = sorted_heads(docs, self.buckets).withColumn("level", F.lit(-1))
        for i, (level, _) in enumerate(old):
            rows = rows.union(level.select("bucket", "kind", "block", F.lit(i).alias("level")))
        merging = [True for _, own in old if own]

        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            bucket = int(pdf["bucket"].iloc[0])
            out = [(bucket, FLAG, b) for b in pdf.loc[pdf["kind"] == FLAG, "block"]]
            new = pdf.loc[(pdf["kind"] == NEW), "block"]
            held = []
            if len(new):
                h, d, m = _joined(list(new))
                hit = _shared(h, d, m)
            else:
                h, d, m, hit = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
            for level, block in zip(pdf["level"], pdf["block"], strict=True):
                if level < 0:
                    continue
                lh, ld, lm = unpack(block)
                if level < len(merging):
                    held.append(block)
                at = np.minimum(np.searchsorted(lh, h), len(lh) - 1)
                same = lh[at] == h
                hit |= same
                met = np.unique(at[same])
                alone = met[lm[met] == 0]
                out.append((bucket, FLAG, pack(ld[alone], lh[alone])))
            own = hit & ~m
            out.append((bucket, FLAG, pack(d[own], h[own])))
            if keep and (len(h) or held):
                h, d, m = _joined([*held, pack(h, d, m.astype(np.uint8))])
                m |= _shared(h, d, m)
                first = np.concatenate(([True], h[1:] != h[:-1]))
                out.append((bucket, LEVEL, pack(h[first], d[first], m[first].astype(np.uint8))))
            return pd.DataFrame(out, columns=["bucket", "kind", "block"])

        made = stored(rows.groupBy("bucket").applyInPandas(scan, "bucket int, kind int, block binary"), "heads")
        flags = stored(made.where(F.col("kind") == FLAG), "flags")
        self.parts.append(flags)
        if keep:
            self.levels.append((total, stored(made.where(F.col("kind") == LEVEL), "level")))
        for _, level in merged:
            drop_stored(level)
        drop_stored(made)
        release(self.spark)

    def flagged(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in bodies(batch, "block"):
                    d, h = unpack(block)
                    yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(h.view(np.int64))], ["doc", "head"])

        rows = reduce(DataFrame.union, self.parts).select("block")
        return rows.mapInArrow(run, "doc long, head long")

    def close(self) -> None:
        for level in [t for _, t in self.levels] + self.parts:
            drop_stored(level)


def _slices(rows: DataFrame) -> DataFrame:
    """(key, doc, start, stop, content): strings around shared heads, each distinct content once a chunk.

    A content that a smaller document of the chunk has too is settled at once and goes on
    without bytes. Around a crowded head every string goes under its own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, buf, ends in _chunks(batches):
            ids = batch.column("doc_id").slice(first, len(ends)).to_numpy()
            begins = np.concatenate(([0], ends[:-1]))
            text, start, n, head = heads(buf, ends)
            crowded = np.zeros(len(text), bool)
            wanted = np.zeros(len(text), bool)
            for name, mark in (("heads", wanted), ("crowded", crowded)):
                lists = batch.column(name).slice(first, len(ends))
                owner = np.repeat(np.arange(len(ends)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if len(owner) else np.zeros(0, np.uint64)
                pool = np.sort(mix(flat + owner.astype(np.uint64) * STEP))
                if len(pool):
                    mine = mix(head + text.astype(np.uint64) * STEP)
                    at = np.minimum(np.searchsorted(pool, mine), len(pool) - 1)
                    mark |= pool[at] == mine
            use = np.flatnonzero(wanted | crowded)
            text, start, n, head, crowded = text[use], start[use], n[use], head[use], crowded[use]
            if crowded.any():  # one row for each string
                each = np.where(crowded, n, 1)
                row = np.repeat(np.arange(len(n)), each)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                text, start, head = text[row], start[row] + shift, head[row]
                n, crowded = np.where(crowded[row], 1, n[row]), crowded[row]
            doc = ids[text]
            data = buf.tobytes()
            least: dict[tuple[int, bytes], int] = {}
            contents = []
            for h, s, k, d in zip(head.tolist(), start.tolist(), n.tolist(), doc.tolist(), strict=True):
                c = data[s : s + k + SPAN - 1]
                contents.append(c)
                if least.setdefault((h, c), d) > d:
                    least[h, c] = d
            settled = np.array([least[h, c] < d for h, c, d in zip(head.tolist(), contents, doc.tolist(), strict=True)], bool)
            key = np.where(crowded, 0, head)
            for i in np.flatnonzero(crowded).tolist():
                key[i] = int.from_bytes(hashlib.blake2b(contents[i], digest_size=8).digest(), "little")
            key = np.where(settled, mix(doc.astype(np.uint64) + start.astype(np.uint64) * STEP), key).astype(np.uint64)
            rel = start - begins[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(rel), pa.array(rel + n + SPAN - 1), pa.array([None if s else c for s, c in zip(settled.tolist(), contents, strict=True)], pa.binary())],
                ["key", "doc", "start", "stop", "content"],
            )

    return rows.mapInArrow(run, "key long, doc long, start long, stop long, content binary")


def repeats(key: np.ndarray, doc: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): bytes of each content covered by a SPAN-byte string that a smaller document has under the same key."""
    order = np.lexsort((doc, key))
    lengths = np.array([len(contents[i]) for i in order], np.int64)
    buf = np.frombuffer(b"".join([contents[i] for i in order]), np.uint8)
    offset = np.cumsum(lengths) - lengths
    n = lengths - SPAN + 1
    row = np.repeat(np.arange(len(order)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = offset[row] + place
    whole = np.concatenate([rolling(buf[a : a + BLOCK + SPAN - 1], SPAN) for a in range(0, len(buf) - SPAN + 1, BLOCK)])
    k, d = key[order][row], doc[order][row]
    mark = mix(whole[at] + k * STEP)
    by = np.argsort(mark, kind="stable")  # rows are in order of documents, so the first of a run is the smallest
    start = np.concatenate(([True], mark[by][1:] != mark[by][:-1]))
    first = by[np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))]
    hit = np.flatnonzero(d[by] > d[first])
    mine, other = by[hit], first[hit]
    views = np.lib.stride_tricks.sliding_window_view(buf, SPAN)
    covered = np.zeros(len(row), bool)
    for a in range(0, len(hit), 1 << 18):
        x, y = mine[a : a + (1 << 18)], other[a : a + (1 << 18)]
        if not ((views[at[x]] == views[at[y]]).all() and (k[x] == k[y]).all()):
            return _repeats_exactly(key, doc, contents)
        covered[x] = True
    edge = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
    fresh = np.concatenate(([True], row[1:] != row[:-1], [True]))
    cut = np.flatnonzero(fresh)
    begin = np.unique(np.concatenate((np.flatnonzero(edge == 1), cut[:-1][covered[cut[:-1]]])))
    stop = np.unique(np.concatenate((np.flatnonzero(edge == -1), cut[1:][covered[cut[1:] - 1]])))
    return order[row[begin]], place[begin], place[stop - 1] + SPAN


def _repeats_exactly(key: np.ndarray, doc: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with whole strings as keys, for when two of them have one hash."""
    least: dict[tuple[int, bytes], int] = {}
    rows = list(zip(key.tolist(), doc.tolist(), contents, strict=True))
    for k, d, c in rows:
        for i in range(len(c) - SPAN + 1):
            s = c[i : i + SPAN]
            least[k, s] = min(d, least.get((k, s), d))
    out = [(r, i, i + SPAN) for r, (k, d, c) in enumerate(rows) for i in range(len(c) - SPAN + 1) if least[k, c[i : i + SPAN]] < d]
    return tuple(np.array([x[j] for x in out], np.int64) for j in range(3))


def _settled(rows: DataFrame) -> DataFrame:
    """(doc, start, stop) of bytes to remove; rows of a key meet in one task, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            known = t.column("content").is_null().to_numpy()
            pick = [t.column(c).to_numpy() for c in ("doc", "start", "stop")]
            out = [[x[known] for x in pick]]
            open_rows = np.flatnonzero(~known)
            if len(open_rows):
                key, doc = t.column("key").to_numpy()[open_rows].view(np.uint64), pick[0][open_rows]
                r, a, b = repeats(key, doc, t.column("content").take(pa.array(open_rows)).to_pylist())
                begin = pick[1][open_rows]
                out.append([doc[r], begin[r] + a, begin[r] + b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["doc", "start", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "doc long, start long, stop long")


def apply_spans(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(remaining bytes, maximal removed runs)."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    return b"".join(kept), [tuple(r) for r in runs]


def whole_copies(texts: DataFrame) -> DataFrame:
    """(doc, n_bytes) of texts that a smaller document has too; they go as a whole and are not compared further."""
    marks = stored(texts.select("doc_id", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= SPAN), "digests")
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(marks.join(first, "digest").where("doc_id > first").select(F.col("doc_id").alias("doc"), "n_bytes").distinct(), "copies")


def _known(docs: DataFrame) -> DataFrame:
    """(doc_id, body) of rows with an id, as long.

    An id that is long already keeps its name in Spark's plan: with a cast there, the two
    joins below would each shuffle the texts, as Spark takes their exchanges for different.
    """
    long = docs.schema["doc_id"].dataType.simpleString() == "bigint"
    return octets(docs).select("doc_id" if long else F.col("doc_id").cast("long").alias("doc_id"), "body").where("doc_id is not null")


def removed_spans(docs: DataFrame, batches: int = BATCHES, crowd: int = CROWD, bytes_per_bucket: int = BYTES_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(dealt, spans): texts with an id dealt by it, and (doc, spans) of what is to go from each.

    Added in ``batches`` of rising ids; the result does not depend on their number.
    """
    spark = docs.sparkSession
    known = _known(docs)
    cuts, size = known.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10_000), F.sum(F.octet_length("body"))).first()
    size = size or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bytes_per_bucket))
    edges = [None, *sorted(set(cuts or []))[: batches - 1], None]
    index = SuffixIndex(spark, buckets)
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = known if lo is None else known.where(F.col("doc_id") > lo)
        index.add(part if hi is None else part.where(F.col("doc_id") <= hi), size / batches, keep=i < len(edges) - 2)
    for level in index.levels:
        drop_stored(level[1])
    index.levels.clear()
    pairs = index.flagged()
    crowds = stored(pairs.groupBy("head").count().where(F.col("count") > crowd).select("head"), "crowds")
    if crowds.isEmpty():
        marked = pairs.withColumn("full", F.lit(False))
    else:
        marked = pairs.join(crowds.withColumn("full", F.lit(True)), "head", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    wanted = marked.groupBy("doc").agg(F.collect_set(F.when(~F.col("full"), F.col("head"))).alias("heads"), F.collect_set(F.when(F.col("full"), F.col("head"))).alias("crowded"))
    copies = whole_copies(known)
    wanted = stored(wanted.join(copies, "doc", "left_anti"), "wanted")
    index.close()
    release(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bytes_per_bucket))
    dealt = known.repartition(tasks, "doc_id")
    around = _slices(dealt.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "body", "heads", "crowded"))
    found = _settled(around.repartition(tasks, "key").sortWithinPartitions("key"))
    found = found.union(copies.select("doc", F.lit(0).cast("long"), "n_bytes"))
    return dealt, found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, crowd: int = CROWD, bytes_per_bucket: int = BYTES_PER_BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans), a row for each row of ``docs``.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id.
    Null texts are empty. A null id is neither smaller nor larger than another: its text
    stays whole and removes nothing. Rows that repeat an id are one document.
    """
    dealt, spans = removed_spans(docs, batches, crowd, bytes_per_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, (body, found) in enumerate(zip(bodies(batch), batch.column("spans"), strict=True)):
                kept, runs = apply_spans(body, [(s["start"], min(s["stop"], len(body))) for s in found.as_py() or []])
                rows.append((len(body), len(body) - len(kept), len(runs), kept, runs))
                held += len(body)
                if held >= CHUNK or i == batch.num_rows - 1:
                    cols = list(zip(*rows, strict=True))
                    ids = batch.column("doc_id").slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([list(map(list, v)) for v in c] if k is kinds[4] else list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
                    rows, held, first = [], 0, i + 1

    whole = dealt.join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "body", "spans")
    alone = octets(docs.where("doc_id is null")).select(F.col("doc_id").cast("long").alias("doc_id"), "body", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return whole.union(alone).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of ``documents`` that a document with a smaller id has."""
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES = {
    "op1_suffix_dedup": f"""
        with d as (select row_number() over () as k, doc_id, encode(coalesce(text, '')) as b from documents),
        starts as (select k, doc_id, b, unnest(range(1, octet_length(b) - {SPAN - 2})) as i from d),
        strings as (select k, doc_id, i, array_slice(b, i, i + {SPAN - 1}) as s from starts),
        least as (select s, min(doc_id) as first from strings group by s),
        hits as (select distinct k, i from strings join least using (s) where first < doc_id),
        bytes as (select k, unnest(range(1, octet_length(b) + 1)) as i, b from d),
        marked as (select k, i, hex(array_slice(b, i, i)) as x, max(case when hits.k is null then 0 else 1 end) over (partition by k order by i rows between {SPAN - 1} preceding and current row) as gone
          from bytes left join hits using (k, i)),
        edges as (select *, gone = 1 and coalesce(lag(gone) over (partition by k order by i), 0) = 0 as opens from marked),
        sums as (select k, count(*) as n, sum(gone) as r, count(*) filter (where opens) as o, string_agg(x, '' order by i) filter (where gone = 0) as rest from edges group by k)
        select doc_id, coalesce(n, 0)::bigint as n_bytes, coalesce(r, 0)::bigint as n_removed, coalesce(o, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, ''))) as kept_sha256 from d left join sums using (k)"""
}
