"""Exact order statistics by narrowing brackets, without a sort or shuffle of the column.

A bracket is a range of values that holds a wanted running weight. Each round counts the
rows of every bracket in a bounded histogram, keeps the bin in which the position falls
and goes on with the rows of that bin alone, by the smallest and largest value really in
it. What is shuffled are histograms; when the rows left in all brackets are few, their
values are counted and the position is read off. Few groups are assumed; ``few_groups``
says whether that holds, and the caller has another way for many.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Brackets at most; bins of one round over all brackets; rows that end the narrowing.
BRACKETS, BINS, LAST_ROWS = 2048, 1 << 12, 5_000
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Bracket:
    """Values from ``low`` to ``high``, with the weight of all below and the next value above."""

    low: object
    high: object
    below: object
    rows: int
    above: object = None


@dataclass(frozen=True)
class Found:
    """The smallest value whose running weight reaches a position, that weight, and the next value."""

    value: object
    cum: object
    following: object


def _linear(x: Column, low: Column, high: Column, bins: int) -> Column:
    return F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * bins)


def _logarithmic(x: Column, low: Column, high: Column, bins: int) -> Column:
    scale = lambda c: F.signum(c) * F.log1p(F.abs(c))
    return F.floor((scale(x) - scale(low)) / F.nullif(scale(high) - scale(low), F.lit(0.0)) * bins)


def few_groups(df: DataFrame, by: list[str], value: str, weight: Column, positions: list[Column]) -> list | None:
    """Per group its total weight, range, rows and wanted positions (``_p0``..); None where brackets do not fit.

    They fit numbers that are finite, in as many groups and positions as BRACKETS allows.
    """
    if not isinstance(df.schema[value].dataType, _PLAIN):
        return None
    flat = [p.alias(f"_p{i}") for i, p in enumerate(positions)]
    odd = F.count_if(F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")))
    facts = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(weight).alias("total"), F.count("*").alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"), odd.alias("_odd"))
    most = BRACKETS // max(1, len(flat))
    groups = facts.select("*", *flat).limit(most + 1).collect()
    if not by and not groups[0]["_rows"]:
        return None
    return None if len(groups) > most or any(g["_odd"] for g in groups) else groups


def _in_brackets(df: DataFrame, by: list[str], value: str, weight: Column, open_: dict[tuple, Bracket]) -> DataFrame:
    """(_b, _v, _w, _lo, _hi): rows of the brackets with the bracket's number and range.

    Brackets of one group do not overlap. Their table has BRACKETS entries at most, so it
    is sent to every task.
    """
    kind = df.schema[value].dataType
    picked = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), weight.alias("_w"))
    if by:
        names = [f"_g{i}" for i in range(len(by))]
        fields = [*[T.StructField(n, df.schema[c].dataType) for n, c in zip(names, by, strict=True)], T.StructField("_b", T.IntegerType()), T.StructField("_lo", kind), T.StructField("_hi", kind)]
        table = df.sparkSession.createDataFrame([(*group, i, b.low, b.high) for i, ((group, _, _), b) in enumerate(open_.items())], T.StructType(fields))
        same = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(n)) for n, c in zip(names, by, strict=True)])
        return picked.join(F.broadcast(table), same & F.col("_v").between(F.col("_lo"), F.col("_hi"))).select("_b", "_v", "_w", "_lo", "_hi")
    own = F.lit(None)
    for i, b in enumerate(open_.values()):
        low, high = F.lit(b.low).cast(kind), F.lit(b.high).cast(kind)
        own = F.when(F.col("_v").between(low, high), F.struct(F.lit(i).alias("_b"), low.alias("_lo"), high.alias("_hi"))).otherwise(own)
    return picked.withColumn("_e", own).filter("_e is not null").select("_e._b", "_v", "_w", "_e._lo", "_e._hi")


def select(df: DataFrame, by: list[str], value: str, weight: Column, positions: list[Column]) -> list[tuple[object, list[Found]]] | None:
    """(group's facts, what stands at each position) for every group, or None (``few_groups``).

    A position is an expression of the group's ``total``. Brackets that several positions
    share are counted once.
    """
    groups = few_groups(df, by, value, weight, positions)
    if not groups:
        return groups
    held: dict[tuple, Bracket] = {}
    target: dict[tuple, object] = {}
    for g in groups:
        for i in range(len(positions)):
            key = (tuple(g[c] for c in by), i)
            held[key], target[key] = Bracket(g["_low"], g["_high"], 0, g["_rows"]), g[f"_p{i}"]
    turn, before = 0, [0]
    while True:
        open_ = {(key[0], b.low, b.high): b for key, b in held.items() if b.low != b.high}
        rows = sum(b.rows for b in open_.values())
        if rows <= LAST_ROWS:
            break
        if turn > 1 and rows >= before[-2]:  # values that differ beyond what a double tells apart
            return None
        before.append(rows)
        bins = max(8, BINS // len(open_))
        own = _in_brackets(df, by, value, weight, open_)
        x, lo, hi = (F.col(c).cast("double") for c in ("_v", "_lo", "_hi"))
        place = (_linear if turn % 2 else _logarithmic)(x, lo, hi, bins)
        counted = own.groupBy("_b", F.coalesce(place, F.lit(0)).alias("bin")).agg(F.sum("_w").alias("w"), F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        lines: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["_b"], r["bin"])):
            lines.setdefault(r["_b"], []).append(r)
        number = {k: i for i, k in enumerate(open_)}
        for key, b in held.items():
            if b.low == b.high:
                continue
            below, found = b.below, lines[number[key[0], b.low, b.high]]
            for j, r in enumerate(found):
                if below + r["w"] >= target[key] or j == len(found) - 1:
                    above = found[j + 1]["lo"] if j + 1 < len(found) else b.above
                    held[key] = replace(b, low=r["lo"], high=r["hi"], below=below, rows=r["n"], above=above)
                    break
                below += r["w"]
        turn += 1
    # the weight of a single value is counted like those of the last rows
    last = {(key[0], b.low, b.high): b for key, b in held.items()}
    counts = _in_brackets(df, by, value, weight, last).groupBy("_b", "_v").agg(F.sum("_w").alias("w"))
    lines = {}
    for r in sorted(counts.collect(), key=lambda r: (r["_b"], r["_v"])):
        lines.setdefault(r["_b"], []).append(r)
    number = {k: i for i, k in enumerate(last)}
    out = {}
    for key, b in held.items():
        cum, found = b.below, lines[number[key[0], b.low, b.high]]
        for j, r in enumerate(found):
            cum += r["w"]
            if cum >= target[key] or j == len(found) - 1:
                out[key] = Found(r["_v"], cum, found[j + 1]["_v"] if j + 1 < len(found) else b.above)
                break
    return [(g, [out[tuple(g[c] for c in by), i] for i in range(len(positions))]) for g in groups]
