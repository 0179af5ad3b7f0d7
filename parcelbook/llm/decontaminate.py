"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, a bound for windows beyond, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, drop_stored, mix, octets, stored, table, word_hashes

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 16
SLICE = 20_000
PIECE = 1 << 17
MAYBE = 20
ROUNDING = 1e-9
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; of all of them if there are fewer."""
    width = min(width, len(h))
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        out = out * STEP + h[j : j + len(out)]
    return mix(out) if width else out


def simhash(h: np.ndarray) -> int:
    """64-bit fingerprint of a multiset of word hashes."""
    ones = np.unpackbits(mix(h).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


@dataclass(frozen=True)
class Index:
    """At most SLICE items: their shingles with weights, fingerprints and block tables."""

    ids: list
    sizes: np.ndarray
    fps: np.ndarray
    grams: list[dict[int, int]]
    known: np.ndarray
    owners: list[list[int]]
    maybe: np.ndarray
    weights: dict[int, float]


def index_of(items: list[tuple[object, bytes]], weights: dict[int, float] | None = None) -> Index:
    """A shingle weighs 1 / (number of items that have it): what items share says less about a leak.

    ``weights`` are those of the whole benchmark, where 1 may be left out; without them
    ``items`` are the whole benchmark.
    """
    hashed = [(i, word_hashes(t.lower().split())) for i, t in items]
    hashed = [(i, h) for i, h in hashed if len(h)]
    grams = [_counted(shingles(h)) for _, h in hashed]
    if weights is None:
        seen: dict[int, int] = {}
        for g in grams:
            for s in g:
                seen[s] = seen.get(s, 0) + 1
        weights = {s: 1 / n for s, n in seen.items()}
    weights = {s: weights.get(s, 1.0) for g in grams for s in g}
    sizes = np.array([len(h) for _, h in hashed], np.int64)
    known = np.array(sorted({s for g in grams for s in g}), np.uint64)
    owned: dict[int, list[int]] = {}
    for row, g in enumerate(grams):
        for x in g:
            owned.setdefault(x, []).append(row)
    owners = [owned[x] for x in known.tolist()]
    maybe = np.zeros(1 << MAYBE, bool)
    maybe[known >> np.uint64(64 - MAYBE)] = True
    return Index([i for i, _ in hashed], sizes, np.array([simhash(h) for _, h in hashed], np.uint64), grams, known, owners, maybe, weights)


def has_known(grams: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(place, row of ``known``) of shingles that some item has; most others are told by their first bits."""
    at = np.flatnonzero(index.maybe[grams >> np.uint64(64 - MAYBE)])
    if not len(at):
        return at, at
    found = np.minimum(np.searchsorted(index.known, grams[at]), len(index.known) - 1)
    same = index.known[found] == grams[at]
    return at[same], found[same]


def _counted(s: np.ndarray) -> dict[int, int]:
    values, counts = np.unique(s, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


def similarity(window: dict[int, int], item: dict[int, int], weights: dict[int, float]) -> float:
    """Weighted Jaccard similarity of two multisets of shingles.

    A shingle that the item lacks weighs as much as the item's own on average, so neither
    other items nor the slice they are in change the similarity.
    """
    both = sum(weights[s] * min(n, window.get(s, 0)) for s, n in item.items())
    either = sum(weights[s] * max(n, window.get(s, 0)) for s, n in item.items())
    if not either:
        return 0.0
    mean = sum(weights[s] * n for s, n in item.items()) / sum(item.values())
    return both / (either + mean * sum(n for s, n in window.items() if s not in item))


def _block_bounds() -> list[tuple[int, int]]:
    edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [(edges[b], edges[b + 1] - edges[b]) for b in range(BLOCKS)]


def candidates(fps: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of fps, row of items) within RADIUS bits.

    With more blocks than errors some block is the same, so block tables miss no pair.
    """
    found = np.zeros(0, np.int64)
    for at, bits in _block_bounds():
        mask = np.uint64((1 << bits) - 1)
        mine, theirs = (fps >> np.uint64(at)) & mask, (items >> np.uint64(at)) & mask
        order = np.argsort(theirs, kind="stable")
        lo, hi = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
        n = hi - lo
        a = np.repeat(np.arange(len(fps)), n)
        b = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        near = np.bitwise_count(fps[a] ^ items[b]) <= RADIUS
        found = np.union1d(found, a[near] * len(items) + b[near])
    return found // max(1, len(items)), found % max(1, len(items))


def leaks_in(h: np.ndarray, index: Index, least: float) -> dict[int, tuple[float, int]]:
    """{row of the index: (similarity, first word)} of the best window for each leaked item; the first of equals.

    Windows whose fingerprint is within RADIUS bits of the item's are compared first. The
    weight of the item's shingles in a window over that of the whole item bounds their
    similarity from above, so every other window is compared too unless its bound is below
    ``least`` or the best so far: what the fingerprints miss is not lost.
    """
    best: dict[int, tuple[float, int]] = {}
    for width, rows in _by_width(index).items():
        hit, known = has_known(shingles(h, width) if len(h) >= width else np.zeros(0, np.uint64), index)
        for size, held in _holders(hit, known, rows, index, least).items():
            reach = size - width + 1
            items = np.array(sorted(held), np.int64)
            places = np.unique(np.concatenate([held[i][0] for i in held]))
            starts = np.unique((places[:, None] - np.arange(reach)[None, :]).ravel()) if len(places) * reach < 1 << 22 else np.arange(len(h))
            starts = np.unique(np.clip(starts, 0, max(0, len(h) - size)))
            for at in range(0, len(starts), 1 << 14):
                part = starts[at : at + (1 << 14)]
                bounds = {i: _bounds(part, reach, *held[i]) for i in items.tolist()}
                if max(float(b.max()) for b in bounds.values()) < least - ROUNDING:
                    continue
                lo, hi = int(part[0]), min(len(h), int(part[-1]) + size)
                fps = _window_fps(h[lo:hi], part - lo, min(size, hi - lo))
                near: dict[int, list[int]] = {}
                for w, i in zip(*candidates(fps, index.fps[items]), strict=True):
                    near.setdefault(int(items[i]), []).append(int(w))
                for item, bound in bounds.items():
                    beyond = np.ones(len(part), bool)
                    beyond[near.get(item, [])] = False
                    may = np.flatnonzero(bound >= least - ROUNDING)
                    for w in may[np.lexsort((part[may], -bound[may], beyond[may]))].tolist():
                        top, first = best.get(item, (0.0, 0))
                        if bound[w] < top - ROUNDING:
                            continue
                        start = int(part[w])
                        sim = similarity(_counted(shingles(h[start : start + size])), index.grams[item], index.weights)
                        if sim >= least and (sim > top or sim == top and start < first):
                            best[item] = (sim, start)
    return best


def _holders(hit: np.ndarray, known: np.ndarray, rows: set[int], index: Index, least: float) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """{size: {item: (places, shares)}} of items that the whole text might hold.

    ``places`` are those of the item's shingles in the text, ``shares`` their running weight
    as a part of the item's, from 0.
    """
    placed: dict[int, list[int]] = {}
    for at, k in enumerate(known.tolist()):
        for i in index.owners[k]:
            if i in rows:
                placed.setdefault(i, []).append(at)
    out: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for i, at in placed.items():
        whole = sum(index.weights[s] * n for s, n in index.grams[i].items())
        run = np.cumsum([0.0, *(index.weights[s] for s in index.known[known[at]].tolist())]) / whole
        if run[-1] >= least - ROUNDING:
            out.setdefault(int(index.sizes[i]), {})[i] = (hit[at], run)
    return out


def _bounds(starts: np.ndarray, reach: int, places: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Greatest similarity that the item could have with the window at each start."""
    return run[np.searchsorted(places, starts + reach)] - run[np.searchsorted(places, starts)]


def _by_width(index: Index) -> dict[int, set[int]]:
    widths = np.minimum(index.sizes, WIDTH)
    return {int(w): set(np.flatnonzero(widths == w).tolist()) for w in np.unique(widths)}


def _window_fps(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` words at ``starts``, by differences of running bit counts."""
    out = np.zeros(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(starts) > size + PIECE)
    for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts + 1, [len(starts)])), strict=True):
        s = starts[a:b]
        for at in range(0, len(s), 1 << 12):
            p = s[at : at + (1 << 12)]
            used = np.unique((p[:, None] + np.arange(size)[None, :]).ravel())
            bits = np.unpackbits(mix(h[used]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
            first = np.searchsorted(used, p)
            ones = run[first + size] - run[first]
            packed = np.packbits(ones * 2 > size, axis=1)
            out[a + at : a + at + len(p)] = packed.copy().view(">u8").ravel().astype(np.uint64)
    return out


def _scan(docs: DataFrame, index: Index, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items, sims, starts = [], [], [], []
            for i, body in enumerate(bodies(batch)):
                words = body.lower().split()
                if not words:
                    continue
                for item, (sim, start) in sorted(leaks_in(word_hashes(words), index, least).items()):
                    ids.append(i)
                    items.append(index.ids[item])
                    sims.append(sim)
                    starts.append(start)
            taken = batch.column("doc_id").take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(items, pa.int64()), pa.array(sims, pa.float64()), pa.array(starts, pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])

    return octets(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, first_word long")


def shared_shingles(items: DataFrame) -> DataFrame:
    """(slice, shingle, n) of each shingle that ``n`` > 1 items of all slices have, for the slices that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(word_hashes(b.lower().split()))) for b in bodies(batch)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            grams = np.concatenate([np.zeros(0, np.uint64), *found])
            yield pa.RecordBatch.from_arrays([batch.column("slice").take(pa.array(at, pa.int64())), pa.array(grams.view(np.int64))], ["slice", "shingle"])

    held = items.select("slice", F.col("text").cast("binary").alias("body")).mapInArrow(run, "slice long, shingle long")
    by_slice = held.groupBy("slice", "shingle").agg(F.count("*").alias("own"))
    many = by_slice.groupBy("shingle").agg(F.sum("own").alias("n")).where("n > 1")
    return stored(by_slice.join(many, "shingle").select("slice", "shingle", "n"), "shared")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, per_slice: int = SLICE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): every item of the benchmark that a text holds nearly whole.

    Windows of an item's size are compared with it; ``similarity`` is the weighted Jaccard
    similarity of their five-word shingles (fewer words: of the whole), at least ``least``.
    Items go to the tasks in slices of about ``per_slice``, so what a task holds is
    bounded and a larger benchmark takes more passes; weights are counted over the whole
    benchmark, so slices change no result. Null and empty texts and items leak nothing;
    items with a null id are ignored; rows that repeat a doc_id give rows alike.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text"))
    slices = -(-items.count() // per_slice)
    out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, first_word long")
    if not slices:
        return out
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)))
    shared = shared_shingles(items)
    for s in range(slices):
        own = F.col("slice") == s
        held = [(r.item_id, r.text.encode()) for r in items.where(own).orderBy("item_id").collect()]
        weights = {r.shingle % (1 << 64): 1 / r.n for r in shared.where(own).select("shingle", "n").collect()}
        out = out.union(_scan(docs, index_of(held, weights), least))
    drop_stored(shared)
    return out


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items of ``benchmark`` in every whole text of ``documents``."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
