"""Phrase collocations: level-wise candidates in double-array tries, all text positions advanced at once."""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, bodies, drop_stored, mix, octets, stored, table
from parcelbook.llm.double_array import build, descend, digits_of
from parcelbook.llm.store import mapped, pack, save, unpack
from parcelbook.session import scratch_path

#: Bytes that end a piece, and the blank that separates words besides the space.
FOLD = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
PART, CHUNK, HELD = 1 << 20, 2_000_000, 400_000
#: Buckets of the candidate filter: a power of two near twice the positions, and no more than this.
MOST_BITS, SLICE_BITS = 26, 18
WORDS_PER_SHARD, CANDIDATES_PER_SHARD = 500_000, 500_000
STEP, LOW32 = np.uint64(0x9E3779B97F4A7C15), 0xFFFFFFFF


def parts(body: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a line feed where a piece ends, and empty strings; cut at blanks, so that long texts are no one list."""
    s = body.lower().translate(FOLD).replace(b"\n", b" \n ")
    at = 0
    while at < len(s):
        cut = s.find(b" ", at + PART)
        end = len(s) if cut < 0 else cut
        yield s[at:end].split(b" ")
        at = end


def spoken(docs: DataFrame) -> DataFrame:
    """(lang, body); a null language is ``und``."""
    return octets(docs, "lang").select(F.coalesce("lang", F.lit("und")).alias("lang"), "body")


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts; each task adds up its words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                own.pop(b"", None)
                own.pop(b"\n", None)
                words = pa.array(list(own), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), bodies(batch), strict=True):
                for words in parts(body):
                    held[lang].update(words)
            if sum(map(len, held.values())) >= HELD:
                yield from emit()
        yield from emit()

    return spoken(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ vocabulary


def word_key(word: bytes, lang: bytes) -> bytes:
    return word + b" " + lang


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words in sorted hash arrays by shard; a word's code is its place, from 1. Tasks map the arrays."""

    folder: str
    offsets: np.ndarray
    size: int

    def codes(self, keys: list[bytes], files: dict) -> np.ndarray:
        """Code of each key, 0 for those that are not frequent; words of one hash are told apart by their bytes."""
        h = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))
        shard = ((h >> np.uint64(48)) % np.uint64(len(self.offsets))).astype(np.int64)
        out = np.zeros(len(keys), np.int32)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(len(self.offsets) + 1))
        for s in np.unique(shard).tolist():
            if s not in files:
                try:
                    files[s] = [mapped(f"{self.folder}/{name}-{s}", kind) for name, kind in (("hash", np.uint64), ("end", np.int64), ("text", np.uint8))]
                except FileNotFoundError:  # no word fell into this shard
                    files[s] = [np.zeros(0, np.uint64)] * 3
            held, end, text = files[s]
            mine = order[cut[s] : cut[s + 1]]
            if not len(held):
                continue
            at = np.searchsorted(held, h[mine])
            for j in np.flatnonzero(held[np.minimum(at, len(held) - 1)] == h[mine]).tolist():
                i, place = mine[j], int(at[j])
                while place < len(held) and held[place] == h[i]:
                    if text[end[place - 1] if place else 0 : end[place]].tobytes() == keys[i]:
                        out[i] = self.offsets[s] + place + 1
                        break
                    place += 1
        return out


def vocabulary(frequent: DataFrame, n: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and its table (code, lang, word, n)."""
    spark = frequent.sparkSession
    folder = scratch_path(spark, "words")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / WORDS_PER_SHARD))
    h = F.xxhash64(F.concat_ws(" ", "word", "lang"))
    dealt = frequent.withColumn("h", h).withColumn("shard", (F.shiftrightunsigned("h", 48) % shards).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        hashes = t.column("h").to_numpy().view(np.uint64)
        # by hash, then key: the same codes when a task is run again
        keys = [word_key(w.encode(), lang.encode()) for w, lang in zip(t.column("word").to_pylist(), t.column("lang").to_pylist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=lambda i: (hashes[i], keys[i])), np.int64)
        s = t.column("shard")[0].as_py()
        save(f"{folder}/hash-{s}", hashes[order])
        save(f"{folder}/end-{s}", np.cumsum([len(keys[i]) for i in order], dtype=np.int64))
        save(f"{folder}/text-{s}", np.frombuffer(b"".join(keys[i] for i in order), np.uint8))
        t = t.take(pa.array(order)).select(["shard", "lang", "word", "n"])
        return t.append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    placed = stored(dealt.groupBy("shard").applyInArrow(run, "shard int, lang string, word string, n long, place long"), "vocabulary")
    size = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    offsets = np.concatenate(([0], np.cumsum([size.get(s, 0) for s in range(shards)])[:-1]))
    starts = F.get(F.lit(offsets.tolist()), F.col("shard"))
    return Vocabulary(folder, offsets, n), placed.select((starts + F.col("place") + 1).cast("long").alias("code"), "lang", "word", "n")


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(n, block): codes of whole texts; 0 stands where a piece or a text ends or a word is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        local: dict[str, defaultdict] = {}
        held: list[tuple[str, np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            code = {}
            for lang, own in local.items():
                tail = lang.encode()
                code[lang] = np.concatenate((np.array([-1, 0], np.int32), words.codes([word_key(w, tail) for w in itertools.islice(own, 2, None)], files)))
            x = np.concatenate([code[lang][own] for lang, own in held])
            x = x[x >= 0]
            x = x[(x > 0) | np.concatenate(([False], x[:-1] > 0))]
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([pack(x)], pa.binary())], ["n", "block"])

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), bodies(batch), strict=True):
                if lang not in local:
                    own = defaultdict(itertools.count().__next__)
                    own[b""], own[b"\n"]  # noqa: B018  the first two places: nothing, and an end
                    local[lang] = own
                for found in parts(body):
                    held.append((lang, np.fromiter(map(local[lang].__getitem__, found), np.int32, len(found))))
                    size += len(found)
                held.append((lang, np.ones(1, np.int32)))
                if size >= CHUNK:
                    yield emit()
                    local, held, size = {}, [], 0
        if held:
            yield emit()

    return stored(spoken(docs).mapInArrow(run, "n long, block binary"), "codes")


# ------------------------------------------------------------------- one level


def grams(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, words): phrases whose first and last parts, a word shorter, are both frequent.

    A code is negative where the phrase of ``depth`` - 1 words that starts there is not frequent.
    """
    at = np.flatnonzero((codes[: 1 - depth] > 0) & (codes[1 : len(codes) + 2 - depth] > 0)) if len(codes) >= depth else np.zeros(0, np.int64)
    return at, np.abs(np.stack([codes[at + j] for j in range(depth)], axis=1).astype(np.int64))


def digest(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        h = mix(h * STEP + words[:, j].astype(np.uint64))
    return h


def summed(sent: DataFrame, finish: Callable[[int, np.ndarray], pa.RecordBatch], length: Callable[[int], int], schema: str) -> DataFrame:
    """Add up (part, block of places and counts) by part and finish each sum; one sum is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                if part != now:
                    if now is not None:
                        yield finish(now, total)
                    now, total = part, np.zeros(length(part), np.int64)
                place, n = unpack(block.as_py())
                total[place] += n
        if now is not None:
            yield finish(now, total)

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def sends(part: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One (part, block) for each part: how often each place occurs in it."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    rows: list[tuple[int, bytes]] = []
    for lo, hi in itertools.pairwise(cut.tolist()):
        mine = order[lo:hi]
        n = np.bincount(place[mine])
        hit = np.flatnonzero(n)
        rows.append((int(part[mine[0]]), pack(hit.astype(np.int32), n[hit].astype(np.int32))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])


def over(codes: DataFrame, visit: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                yield from visit(unpack(block.as_py())[0])

    return codes.select("block").mapInArrow(run, schema)


def filled(codes: DataFrame, depth: int, bits: int, support: int) -> str:
    """Folder of bitmaps: which hash buckets hold ``support`` phrases or more, so that every frequent phrase is in one."""
    folder = scratch_path(codes.sparkSession, "buckets")

    def visit(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (digest(grams(x, depth)[1]) >> np.uint64(64 - bits)).astype(np.int64)
        yield from sends(bucket >> SLICE_BITS, bucket & ((1 << SLICE_BITS) - 1))

    def finish(part: int, total: np.ndarray) -> pa.RecordBatch:
        save(f"{folder}/bits-{part}", np.packbits(total >= support))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    summed(over(codes, visit, "part int, block binary"), finish, lambda _: 1 << SLICE_BITS, "part int").count()
    return folder


def propose(codes: DataFrame, depth: int, bits: int, folder: str) -> DataFrame:
    """(w0, w1, ..): the phrases that can be frequent, each once."""
    held: list[np.ndarray] = []

    def visit(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not held:  # at most 2^26 bits
            for part in range(1 << (bits - SLICE_BITS)):
                try:
                    held.append(np.array(mapped(f"{folder}/bits-{part}", np.uint8)))
                except FileNotFoundError:  # no phrase fell into this slice
                    held.append(np.zeros((1 << SLICE_BITS) // 8, np.uint8))
            held[:] = [np.concatenate(held)]
        words = grams(x, depth)[1]
        bucket = (digest(words) >> np.uint64(64 - bits)).astype(np.int64)
        words = words[(held[0][bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1]
        if len(words):
            words = np.unique(words, axis=0) if depth > 2 else pairs_once(words)
            yield pa.RecordBatch.from_arrays([pa.array(words[:, j].astype(np.int32)) for j in range(depth)], [f"w{j}" for j in range(depth)])

    return stored(over(codes, visit, ", ".join(f"w{j} int" for j in range(depth))).distinct(), "candidates")


def pairs_once(words: np.ndarray) -> np.ndarray:
    one = np.unique((words[:, 0] << 32) | words[:, 1])
    return np.stack((one >> 32, one & LOW32), axis=1)


@dataclass(frozen=True)
class Tries:
    """Double-array tries of one level's candidates by shard of the first two words; tasks map them."""

    folder: str
    shards: int
    depth: int
    digits: int

    def shard(self, words: np.ndarray) -> np.ndarray:
        return (digest(words[:, :2]) % np.uint64(self.shards)).astype(np.int32)

    def _file(self, files: dict, name: str, kind: type) -> np.ndarray:
        if name not in files:
            files[name] = mapped(f"{self.folder}/{name}", kind)
        return files[name]

    def accepted(self, words: np.ndarray, files: dict) -> tuple[np.ndarray, np.ndarray]:
        """(shard, candidate) of each phrase, candidate -1 for none: all phrases of a shard go down its trie together."""
        shard = self.shard(words)
        out = np.full(len(words), -1, np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            mine = order[cut[s] : cut[s + 1]]
            try:
                trie = self._file(files, f"trie-{s}", np.int32).reshape(3, -1)
            except FileNotFoundError:  # no candidate in this shard
                continue
            out[mine] = descend(trie, digits_of(words[mine], self.digits))
        return shard, out

    def often(self, shard: np.ndarray, candidate: np.ndarray, files: dict) -> np.ndarray:
        """Whether each candidate was counted to be frequent."""
        out = np.zeros(len(shard), bool)
        for s in np.unique(shard[candidate >= 0]).tolist():
            mine = np.flatnonzero((shard == s) & (candidate >= 0))
            out[mine] = self._file(files, f"often-{s}", np.uint8)[candidate[mine]] > 0
        return out


def plant(candidates: DataFrame, n: int, depth: int, digits: int) -> Tries:
    """Build the tries, a shard a task, and write them to the shared folder."""
    spark = candidates.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / CANDIDATES_PER_SHARD))
    tries = Tries(scratch_path(spark, "tries"), shards, depth, digits)
    names = [f"w{j}" for j in range(depth)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(tries.shard(words)), *batch.columns], ["shard", *names])

    def run(t: pa.Table) -> pa.Table:
        words = np.stack([t.column(c).to_numpy() for c in names], axis=1)
        words = words[np.lexsort(words.T[::-1])]
        s = t.column("shard")[0].as_py()
        save(f"{tries.folder}/words-{s}", words.astype(np.int32))
        save(f"{tries.folder}/trie-{s}", build(digits_of(words.astype(np.int64), digits)))
        return pa.table({"shard": pa.array([s], pa.int32())})

    kinds = ", ".join(f"{c} int" for c in names)
    candidates.mapInArrow(deal, f"shard int, {kinds}").groupBy("shard").applyInArrow(run, "shard int").count()
    return tries


def count_phrases(codes: DataFrame, tries: Tries, support: int) -> DataFrame:
    """(w0, w1, .., n): candidates that occur ``support`` times or more."""
    depth = tries.depth

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            for block in batch.column("block"):
                shard, hit = tries.accepted(grams(unpack(block.as_py())[0], depth)[1], files)
                yield from sends(shard[hit >= 0], hit[hit >= 0])

    def words_of(s: int) -> np.ndarray:
        return mapped(f"{tries.folder}/words-{s}", np.int32).reshape(-1, depth)

    def finish(s: int, total: np.ndarray) -> pa.RecordBatch:
        good = total >= support
        save(f"{tries.folder}/often-{s}", good.astype(np.uint8))
        words = words_of(s)[good]
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(words[:, j])) for j in range(depth)], pa.array(total[good])], [*[f"w{j}" for j in range(depth)], "n"])

    sent = codes.select("block").mapInArrow(tally, "part int, block binary")
    return stored(summed(sent, finish, lambda s: len(words_of(s)), ", ".join(f"w{j} int" for j in range(depth)) + ", n long"), "phrases")


def mark(codes: DataFrame, tries: Tries) -> DataFrame:
    """The codes, negative where no frequent phrase of the counted level starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            for block in batch.column("block"):
                x = unpack(block.as_py())[0]
                at, words = grams(x, tries.depth)
                good = at[tries.often(*tries.accepted(words, files), files)]
                out = -np.abs(x)
                out[good] = np.abs(x[good])
                yield pa.RecordBatch.from_arrays([pa.array([len(good)], pa.int64()), pa.array([pack(out)], pa.binary())], ["n", "block"])

    return stored(codes.select("block").mapInArrow(run, "n long, block binary"), "codes")


# ---------------------------------------------------------------------- scores


def cut_score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return f"(cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})"


def least_cut(frame: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """a, l, r and score of the lowest-scoring cut, ties to the earliest."""
    options = [F.struct(F.expr(cut_score("a", left, right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)]
    return frame.withColumn("cut", F.array_min(F.array(*options))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, support: int = 10, keep: int = 2000, covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 and 3 words.

    Words are counted in all texts; a phrase is a candidate if its first and last parts, a
    word shorter, are frequent and its hash bucket holds ``support`` phrases. Candidates
    stand in double-array tries in the shared folder, one shard a file of bounded size, and
    all positions of a chunk of text go down a shard's trie together; counts of accepting
    states are added up by shard. Phrases of two words that a frequent longer one covers by
    ``covered`` percent or more are dropped.

    A null text has no words, a null language is ``und``; repeated rows count each time; an
    empty table or one without a frequent phrase gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    counts = stored(count_words(docs), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= support)
    size = frequent.count()
    words, known = vocabulary(frequent, size)
    codes = encode(docs, words)
    digits = digits_of(np.array([[max(1, size)]]), 0).shape[1]
    tables = []
    for depth in (2, 3):
        positions = codes.agg(F.sum("n")).first()[0] or 0
        bits = min(MOST_BITS, max(SLICE_BITS, (2 * positions).bit_length()))
        found = propose(codes, depth, bits, filled(codes, depth, bits, support))
        tries = plant(found, found.count(), depth, digits)
        tables.append(count_phrases(codes, tries, support))
        drop_stored(found)
        if depth == 2:
            marked = mark(codes, tries)
            drop_stored(codes)
            codes = marked
    drop_stored(codes)
    two, three = tables

    def word(j: int) -> DataFrame:
        return known.select(F.col("code").cast("int").alias(f"w{j}"), F.col("word").alias(f"t{j}"), F.col("n").alias(f"n{j}"), *[F.col("lang")] * (j == 0))

    cover = three.select(F.explode(F.array(F.struct("w0", "w1"), F.struct(F.col("w1").alias("w0"), F.col("w2").alias("w1")))).alias("p"), "n").groupBy("p.w0", "p.w1").agg(F.max("n").alias("most"))
    alone = two.join(cover, ["w0", "w1"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("n"), F.lit(True)))
    pairs = alone.withColumnRenamed("n", "a").join(word(0), "w0").join(word(1), "w1").withColumn("phrase", F.concat_ws(" ", "t0", "t1"))
    first = two.select("w0", "w1", F.col("n").alias("n01"))
    last = two.select(F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("n").alias("n12"))
    triples = three.withColumnRenamed("n", "a").join(first, ["w0", "w1"]).join(last, ["w1", "w2"]).join(word(0), "w0").join(word(1), "w1").join(word(2), "w2").withColumn("phrase", F.concat_ws(" ", "t0", "t1", "t2"))
    scored = least_cut(pairs, [("n0", "n1")]).unionByName(least_cut(triples, [("n0", "n12"), ("n01", "n2")]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best collocations of each language of ``documents``."""
    return collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"op12_phrase_collocations": op12_phrase_collocations}
ORACLES: dict[str, str] = {
    "op12_phrase_collocations": r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
    f1 AS MATERIALIZED (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(w) AS x FROM p) GROUP BY 1, 2), n AS (SELECT lang, sum(c)::BIGINT AS n FROM f1 GROUP BY 1),
    f2 AS MATERIALIZED (SELECT lang, g[1] AS x, g[2] AS y, count(*) AS c FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM p) GROUP BY 1, 2, 3 HAVING c >= 10),
    f3 AS MATERIALIZED (SELECT lang, g[1] AS x, g[2] AS y, g[3] AS z, count(*) AS c FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM p) GROUP BY 1, 2, 3, 4 HAVING c >= 10),
    m AS (SELECT lang, x, y, max(c) AS c FROM (SELECT lang, x, y, c FROM f3 UNION ALL SELECT lang, y, z, c FROM f3) GROUP BY 1, 2, 3),
    k2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.c AS a, a.c AS l, b.c AS r, (1000000::HUGEINT * f2.c * f2.c) // (a.c::HUGEINT * b.c) AS score FROM f2 JOIN f1 a ON a.lang = f2.lang AND a.x = f2.x JOIN f1 b ON b.lang = f2.lang AND b.x = f2.y LEFT JOIN m ON m.lang = f2.lang AND m.x = f2.x AND m.y = f2.y WHERE m.c IS NULL OR 100 * m.c < 50 * f2.c),
    j3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.c AS a, u.c AS l1, v.c AS r1, h.c AS l2, q.c AS r2, (1000000::HUGEINT * f3.c * f3.c) // (u.c::HUGEINT * v.c) AS s1, (1000000::HUGEINT * f3.c * f3.c) // (h.c::HUGEINT * q.c) AS s2
      FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f2 v ON v.lang = f3.lang AND v.x = f3.y AND v.y = f3.z JOIN f2 h ON h.lang = f3.lang AND h.x = f3.x AND h.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
    k AS (SELECT * FROM k2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM j3),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
}
