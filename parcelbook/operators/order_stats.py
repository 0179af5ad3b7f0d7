"""Ranks, quantiles and weighted medians that never need a whole group in one task.

Everything rests on one primitive: the running weight of each distinct value inside
its group. Values are first counted (map-side combine), so ties collapse before any
shuffle. The counts are dealt out in ranges of (group, value); running weights are
computed inside each range and shifted by the totals of the ranges below it. The
same steps run at every size and for every type that has an order. Quantiles of numbers
in few groups take the shorter way of ``selection``.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelbook.operators import selection
from parcelbook.session import settle


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; right keys are dropped."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per group and distinct value with its weight and row count."""
    w = F.sum(weight) if weight else F.count("*")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(w.alias("weight"), F.count("*").alias("rows"))
    )


def in_ranges(df: DataFrame, order: list[str | Column], pieces: int | None = None) -> DataFrame:
    """Settled rows with ``_range``: rows of a lower range come before those of a higher one."""
    dealt = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return settle(dealt.withColumn("_range", F.spark_partition_id()))


def running_weight(counts: DataFrame, by: list[str], value: str, weight: str = "weight", pieces: int | None = None) -> DataFrame:
    """Adds ``cum`` (weight up to and including the value) and ``total``.

    ``pieces`` sets the number of ranges; by default it follows the shuffle settings.
    """
    ranged = in_ranges(counts, [*by, value], pieces)
    # a group has at most one row for each range, so these windows are small whatever the group
    per_range = ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_in_range"))
    whole = Window.partitionBy(*by)
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_range.select(*by, "_range", F.coalesce(F.sum("_in_range").over(below), F.lit(0)).alias("_below"), F.sum("_in_range").over(whole).alias("total"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumn("_cum", F.sum(weight).over(inside))
    return null_safe_join(within, shift, [*by, "_range"]).withColumn("cum", F.col("_cum") + F.col("_below")).drop("_range", "_cum", "_below")


def places(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Place of every row in one total order (1-based), without a sort in one task."""
    ranged = in_ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*order)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    shift = sizes.select("_range", F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_below"))
    return ranged.withColumn("_in", F.row_number().over(inside)).join(shift, "_range").withColumn(out, F.col("_in") + F.col("_below")).drop("_range", "_in", "_below")


def rank_values(
    df: DataFrame, by: list[str], value: str, out: str, method: str = "average", pieces: int | None = None
) -> DataFrame:
    """Rank of every row's value inside its group (1-based); null values get null.

    ``average`` shares the mean position among ties, ``first`` gives the lowest.
    """
    counts = value_counts(df, by, value)
    run = running_weight(counts, by, value, pieces=pieces)
    before = F.col("cum") - F.col("weight")
    rank: Column = before + 1.0
    if method == "average":
        rank = rank + (F.col("weight") - 1) / 2.0
    table = run.select(*by, value, rank.cast("double").alias(out))
    return null_safe_join(df, table, [*by, value], "left")


def rank_in_bounded_group(by: list[str], value: str, method: str = "average") -> Column:
    """The same rank as one window, for groups bounded by construction."""
    r = F.rank().over(Window.partitionBy(*by).orderBy(value)).cast("double")
    if method == "average":
        r = r + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), r)


# ---------------------------------------------------------------- quantile rules


def _covering(position: Column, value: str) -> Column:
    """Smallest value whose running weight reaches a 1-based position."""
    return F.min(F.when(F.col("cum") >= position, F.col(value)))


def rule(name: str, q: float = 0.5) -> list[Column]:
    """Position(s) whose mean is the quantile, as expressions of ``total``.

    averaging  middle, or mean of the two middles
    discrete   first value reaching half (or q) of the weight
    upper      zero-based index n // 2
    lower      zero-based index (n - 1) // 2
    quarter    zero-based index n // 4
    three      zero-based index 3n // 4
    index      zero-based index min(n - 1, int(n q))
    """
    n = F.col("total")
    if name == "averaging":
        return [F.floor((n + 1) / 2), F.floor((n + 2) / 2)]
    if name == "discrete":
        return [n * F.lit(q)]
    if name == "upper":
        return [F.floor(n / 2) + 1]
    if name == "lower":
        return [F.floor((n - 1) / 2) + 1]
    if name == "quarter":
        return [F.floor(n / 4) + 1]
    if name == "three":
        return [F.floor(3 * n / 4) + 1]
    if name == "index":
        return [F.least(n - 1, F.floor(n * F.lit(q))) + 1]
    raise ValueError(f"unknown quantile rule {name}")


def _table(df: DataFrame, by: list[str], source: DataFrame, weight: str | None, rows: list[tuple], outs: list[str]) -> DataFrame:
    """The groups' results as a table; there are as few of them as there are brackets."""
    total = source.agg(F.sum(weight)).schema[0].dataType if weight else T.LongType()
    if rows and isinstance(rows[0][len(by)], float):
        total = T.DoubleType()
    fields = [*[df.schema[c] for c in by], T.StructField("total", total), *[T.StructField(o, T.DoubleType()) for o in outs]]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    wanted: dict[str, list[Column]],
    weight: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Several quantiles per group from one running weight; ``total`` is kept.

    With a weight every unit counts as a repetition of the value, but nothing is
    repeated: positions are looked up in the running weight. Non-positive weights
    carry nothing. Numbers in few groups are found by narrowing brackets, which shuffles
    histograms only; otherwise the distinct values are ranged. Both ways are exact.
    """
    source = df.filter(F.col(weight) > 0) if weight else df
    if pieces is None:
        flat = [p for positions in wanted.values() for p in positions]
        found = selection.select(source, by, value, F.col(weight) if weight else F.lit(1).cast("long"), flat)
        if found is not None:
            rows = []
            for facts, at in found:
                places, outs = iter(at), []
                for positions in wanted.values():
                    outs.append(sum(float(next(places).value) for _ in positions) / len(positions))
                rows.append((*[facts[c] for c in by], facts["total"], *outs))
            return _table(df, by, source, weight, rows, list(wanted))
    run = running_weight(value_counts(source, by, value, weight), by, value, pieces=pieces)
    aggs = []
    for out, positions in wanted.items():
        total = _covering(positions[0], value).cast("double")
        for p in positions[1:]:
            total = total + _covering(p, value)
        aggs.append((total / len(positions)).alias(out))
    return run.groupBy(*by).agg(F.max("total").alias("total"), *aggs)


def weighted_cuts(
    df: DataFrame,
    by: list[str],
    value: str,
    weight: str,
    fractions: dict[str, float],
    pieces: int | None = None,
) -> DataFrame:
    """First value whose running weight exceeds q of the total.

    If a value reaches q of the total exactly, the cut is the midpoint with the next
    distinct value. Works on value-level weights, so one step lookahead is enough:
    the next value is the smallest one whose running weight exceeds the target. Weights
    are summed as decimals, so an exact hit does not depend on how rows were dealt.
    """
    source = df.filter(F.col(weight) > 0).withColumn(weight, F.col(weight).cast("decimal(24,8)"))
    if pieces is None:
        found = selection.select(source, by, value, F.col(weight), [F.col("total") * F.lit(Decimal(str(q))) for q in fractions.values()])
        if found is not None:
            rows = []
            for facts, at in found:
                outs = []
                for q, f in zip(fractions.values(), at, strict=True):
                    exact = f.cum == facts["total"] * Decimal(str(q)) and f.following is not None
                    outs.append((float(f.value) + float(f.following)) / 2.0 if exact else float(f.value))
                rows.append((*[facts[c] for c in by], float(facts["total"]), *outs))
            return _table(df, by, source, None, rows, list(fractions)).withColumn("total", F.col("total").cast("double"))
    run = running_weight(value_counts(source, by, value, weight), by, value, pieces=pieces)
    aggs = []
    for out, q in fractions.items():
        target = F.col("total") * F.lit(Decimal(str(q)))
        over = F.min(F.when(F.col("cum") > target, F.col(value)))
        exact = F.max(F.when(F.col("cum") == target, F.col(value)))
        last = F.max(value)
        aggs.append(
            F.when(exact.isNotNull() & over.isNotNull(), (exact + over) / 2.0)
            .otherwise(F.coalesce(over, last))
            .cast("double")
            .alias(out)
        )
    return run.groupBy(*by).agg(F.max("total").cast("double").alias("total"), *aggs)


def group_by_cuts(value: Column, cuts: list[float]) -> Column:
    """1-based group of a value; a value equal to a cut stays in the lower group."""
    out = F.lit(1)
    for c in cuts:
        out = out + F.when(value > c, 1).otherwise(0)
    return out


def terciles(df: DataFrame, by: list[str], value: str, tie: str, out: str) -> DataFrame:
    """Outer groups of ``n // 3`` rows, the middle one takes the remainder.

    ``tie`` is a unique number that orders equal values: the position of a row is the
    count of smaller values plus its place among equals.
    """
    run = running_weight(value_counts(df, by, value), by, value)
    table = run.select(
        *by, value, (F.col("cum") - F.col("weight")).alias("_before"), F.col("total").alias("_n")
    )
    rows = df.filter(F.col(value).isNotNull()).withColumn("weight", F.lit(1))
    equals = running_weight(rows, [*by, value], tie).withColumnRenamed("cum", "_among")
    placed = null_safe_join(equals.drop("weight", "total"), table, [*by, value]).withColumn(
        "_pos", F.col("_before") + F.col("_among")
    )
    third = F.floor(F.col("_n") / 3)
    return placed.withColumn(
        out,
        F.when(F.col("_pos") <= third, "lowest")
        .when(F.col("_pos") > F.col("_n") - third, "highest")
        .otherwise("middle"),
    ).drop("_before", "_n", "_pos", "_among")
