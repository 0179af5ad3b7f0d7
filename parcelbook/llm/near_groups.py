"""Near-duplicate groups by shingle similarity: Golay keys over a 128-bit SimHash, then an exact check."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelbook.llm.common import bodies, drop_stored, mix, octets, stored, tasks_for
from parcelbook.llm.components import components
from parcelbook.llm.simhash import codeword_indices, shingle_hashes, shingles
from parcelbook.llm.store import mapped, ranged, save
from parcelbook.session import discard, scratch_path

WIDTH = 5
SIMILARITY = 0.8
TABLES = 16
EXACT_BITS = 9
REACH = 32
ROWS = 512
PAIRS = 20_000
#: Hashes in a file of shingle sets; keys of more rows are looked at one by one.
SET_ROWS, SMALL = 4_000_000, 32


def sketch(words: list[bytes], width: int) -> tuple[int, int]:
    """Two fingerprints of the shingles by independent hashes."""
    return sketch_of(shingle_hashes(words, width))


def sketch_of(hashes: Iterable[np.ndarray]) -> tuple[int, int]:
    ones, n = np.zeros(128, np.int64), 0
    for h in hashes:
        for at, x in ((0, h), (64, mix(h + np.uint64(1)))):
            ones[at : at + 64] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    raw = np.packbits(ones * 2 > n).tobytes()
    return int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:], "big")


def sketches(docs: DataFrame, width: int, folder: str) -> DataFrame:
    """(doc, lo, hi, slot) of texts with an id and at least one word; their shingle sets go to ``folder``.

    A file holds the sorted shingle hashes of some thousand texts behind one another. Its
    name is the task attempt that wrote it and a number, and so is the slot's upper part,
    so a task that is run again leaves the slots of its first run right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, chunk, held = TaskContext.get().taskAttemptId(), 0, 0
        sets: list[np.ndarray] = []
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            at = f"{folder}/{attempt}-{chunk}"
            save(f"{at}.end", np.cumsum([len(x) for x in sets], dtype=np.int64))
            save(f"{at}.set", np.concatenate(sets))
            first = (attempt << 32) | (chunk << 20)
            kinds = {"doc": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "slot": pa.int64()}
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            columns = zip(*[(d, signed(lo), signed(hi), first + i) for i, (d, lo, hi) in enumerate(rows)], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), bodies(batch), strict=True):
                if words := body.lower().split():
                    hashes = list(shingle_hashes(words, width))
                    rows.append((doc, *sketch_of(hashes)))
                    sets.append(np.unique(np.concatenate(hashes)))
                    held += len(sets[-1])
                if held >= SET_ROWS:
                    yield flush()
                    chunk, sets, rows, held = chunk + 1, [], [], 0
        if rows:
            yield flush()

    known = octets(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "body")
    return known.mapInArrow(run, "doc long, lo long, hi long, slot long").dropDuplicates(["doc"])


class Sets:
    """Shingle sets by slot; only what is asked for is read, mapped or by range."""

    def __init__(self, folder: str) -> None:
        self.folder, self.files, self.held = folder, {}, {}

    def _file(self, slot: int) -> tuple:
        name = f"{slot >> 32}-{(slot >> 20) & 4095}"
        if name not in self.files:
            self.files[name] = (mapped(f"{self.folder}/{name}.end", np.int64), ranged(f"{self.folder}/{name}.set", np.uint64))
        return self.files[name]

    def size(self, slot: int) -> int:
        end, i = self._file(slot)[0], slot & 0xFFFFF
        return int(end[i] - (end[i - 1] if i else 0))

    def get(self, slot: int) -> set:
        if slot not in self.held:
            if len(self.held) >= 20_000:
                self.held.clear()
            (end, read), i = self._file(slot), slot & 0xFFFFF
            self.held[slot] = set(read(int(end[i - 1]) if i else 0, int(end[i])).tolist())
        return self.held[slot]

    def alike(self, a: int, b: int, least: float) -> bool:
        """Whether two sets have a Jaccard similarity of ``least``."""
        m, n = self.size(a), self.size(b)
        if min(m, n) < least * max(m, n):
            return False
        both = len(self.get(a) & self.get(b))
        return both >= least * (m + n - both)


def table_keys(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): in each table one 23-bit segment by its codeword indices and a few other bits as they are.

    The segment may have two errors, the other bits none. At a similarity of 0.8 about one
    bit in seven differs, so a table finds a pair with probability 0.07, and 0.2 at 0.9;
    copies that are edited in several places are found through other tables or copies.
    """
    bits = np.concatenate([np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) for x in (lo, hi)], axis=1).astype(np.int64)
    rows, keys = [], []
    for t in range(TABLES):
        first = t % 5 * 23
        segment = bits[:, first : first + 23] @ (1 << np.arange(23))
        other = (first + 23 + EXACT_BITS * (t // 5) + np.arange(EXACT_BITS)) % 128
        exact = bits[:, other] @ (1 << np.arange(EXACT_BITS))
        near = np.sort(codeword_indices(segment), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append((t << 40) | (exact[r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(marks: DataFrame) -> DataFrame:
    """(key, doc, slot, lo, hi) of ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lo, hi = (part.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi"))
                r, k = table_keys(lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(k), *(part.column(c).take(pa.array(r)) for c in ("doc", "slot")), pa.array(lo[r].view(np.int64)), pa.array(hi[r].view(np.int64))], ["key", "doc", "slot", "lo", "hi"])

    return marks.select("doc", "slot", "lo", "hi").mapInArrow(run, "key long, doc long, slot long, lo long, hi long")


def close_pairs(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of one key within REACH, i before j, for all keys at once: rows one apart, then two apart and so on."""
    at = np.arange(len(key))
    for step in range(1, len(key)):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = np.bitwise_count(lo[at] ^ lo[at + step]).astype(np.int32) + np.bitwise_count(hi[at] ^ hi[at + step]) <= REACH
        yield at[near], at[near] + step


def joined(slot: np.ndarray, lo: np.ndarray, hi: np.ndarray, sets: Sets, least: float) -> Iterator[tuple[int, int]]:
    """(i, j): links that join the rows of one large key into its groups, no more than rows.

    Pairs within REACH are looked at by their bits, the nearest first; one whose rows are
    already in one group needs no look at the texts, any other has its sets compared.
    """
    root = np.arange(len(slot))
    for at in range(0, len(slot), ROWS):
        own = np.arange(at, min(at + ROWS, len(slot)))
        d = np.bitwise_count(lo[own, None] ^ lo[None, : own[-1]]).astype(np.uint8) + np.bitwise_count(hi[own, None] ^ hi[None, : own[-1]])
        d[np.arange(own[-1])[None, :] >= own[:, None]] = 255
        r, j = np.nonzero(d <= REACH)
        order = np.argsort(d[r, j], kind="stable")
        i, j = own[r[order]], j[order]
        for lo_ in range(0, len(i), PAIRS):
            a, b = i[lo_ : lo_ + PAIRS], j[lo_ : lo_ + PAIRS]
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                if root[x] != root[y] and sets.alike(int(slot[x]), int(slot[y]), least):
                    root[root == root[x]] = root[y]
                    yield y, x


def joins(roots: dict[int, int], a: int, b: int) -> bool:
    """Whether the link joins two groups of those a task has seen, and then joins them."""

    def find(x: int) -> int:
        while (up := roots.setdefault(x, x)) != x:
            roots[x] = roots[up]
            x = up
        return x

    a, b = find(a), find(b)
    roots[max(a, b)] = min(a, b)
    return a != b


def links_by_key(marks: DataFrame, tasks: int, folder: str, least: float) -> DataFrame:
    """(a, b): documents of one key within REACH whose shingle sets are similar enough.

    Sets are compared where the key is, so a pair that fails is never a row, and a task
    gives no more links than it has seen documents that have one: a link inside a group
    that its links already join is left out. Keys of up to SMALL rows are looked at many
    in one go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sets = Sets(folder)
        roots: dict[int, int] = {}  # of documents that have a link

        def done(t: pa.Table) -> pa.RecordBatch:
            k, doc, slot, lo, hi = (t.column(c).to_numpy() for c in ("key", "doc", "slot", "lo", "hi"))
            lo, hi = lo.view(np.uint64), hi.view(np.uint64)
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            size = np.diff(cut)
            few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
            found: set[tuple[int, int]] = set()
            pairs = [(few[i], few[j]) for i, j in close_pairs(k[few], lo[few], hi[few])]
            if pairs:
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                # a pair that shares many keys is compared once
                once = np.unique(np.stack((doc[i], doc[j]), axis=1), axis=0, return_index=True)[1]
                found.update((int(doc[x]), int(doc[y])) for x, y in zip(i[once].tolist(), j[once].tolist(), strict=True) if sets.alike(int(slot[x]), int(slot[y]), least))
            for s in np.flatnonzero(size > SMALL):
                at = slice(cut[s], cut[s + 1])
                found.update((int(doc[at][x]), int(doc[at][y])) for x, y in joined(slot[at], lo[at], hi[at], sets, least))
            columns = list(zip(*[p for p in sorted(found) if joins(roots, *p)], strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                key = batch.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    return keyed(marks).repartition(tasks, "key").sortWithinPartitions("key", "doc").mapInArrow(run, "a long, b long").distinct()


def similarity(a: bytes, b: bytes, width: int = WIDTH) -> float:
    """Jaccard similarity of the sets of word shingles."""
    x, y = (set(shingles(t.lower().split(), width)) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 0.0


def verified(docs: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs (a, b) whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(x, y, width) >= least for x, y in zip(bodies(batch, "x"), bodies(batch, "y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = octets(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "body")
    dealt = texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    one = pairs.join(dealt, F.col("a") == F.col("doc")).select("a", "b", F.col("body").alias("x"))
    both = one.join(dealt, F.col("b") == F.col("doc")).select("a", "b", "x", F.col("body").alias("y"))
    return both.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(doc, root) of every document that has a near-duplicate; root is the group's smallest id.

    A group is joined by pairs whose sets of ``width``-word shingles have a Jaccard
    similarity of at least ``least``; compared are all pairs that share a key and whose
    sketches lie within REACH, save those that are in one group already. Sets stand as
    64-bit hashes in the shared folder. Of equal sketches the first stands for those that
    are like it. Rows without an id or without words are in no group; of rows that repeat
    an id one counts.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "shingles")
    marks = stored(sketches(docs, width, folder), "sketch")
    first = stored(marks.groupBy("lo", "hi").agg(F.min(F.struct("doc", "slot")).alias("f")).select("lo", "hi", "f.*"), "sketches")
    same = marks.join(first.select("lo", "hi", F.col("doc").alias("a")), ["lo", "hi"]).where("doc > a").select("a", F.col("doc").alias("b"))
    copies = stored(verified(docs, same, width, least), "copies")
    # A document that is unlike the first of its sketch stands for itself.
    unlike = same.join(copies, ["a", "b"], "left_anti").select(F.col("b").alias("doc"))
    columns = ["doc", "slot", "lo", "hi"]
    alone = stored(first.select(columns).union(marks.join(unlike, "doc", "left_semi").select(columns)), "alone")
    tasks = tasks_for(alone.count(), 20_000, spark)
    links = stored(links_by_key(alone, tasks, folder, least), "links")
    groups = components(copies.union(links))
    for held in (marks, first, copies, alone, links):
        drop_stored(held)
    discard(spark, folder)
    return groups.select(F.col("node").alias("doc"), "root")


def one_of_each_group(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that have a near-duplicate with a smaller id in their group."""
    gone = stored(similar_groups(docs, width, least).where("doc != root").select("doc"), "gone")
    return docs.join(gone, docs.doc_id == gone.doc, "left_anti")
