"""Unit-by-period operators.

A unit's history is bounded by the calendar, so windows ordered by period inside a
unit are safe; facts must be aggregated to unit and period before they come here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(unit: list[str], period: str, value: str, step: int = 1, strict: bool = True) -> Column:
    """Previous row's value; strict means exactly ``step`` periods earlier."""
    w = Window.partitionBy(*unit).orderBy(period)
    lagged = F.lag(value).over(w)
    if not strict:
        return lagged
    return F.when(F.col(period) - F.lag(period).over(w) == step, lagged)


def change(
    unit: list[str], period: str, value: str, form: str = "pct", strict: bool = True
) -> Column:
    """Change against the previous period: diff, pp (x100), pct or ratio."""
    p = previous(unit, period, value, strict=strict)
    v = F.col(value)
    if form == "diff":
        return v - p
    if form == "pp":
        return (v - p) * 100
    if form == "pct":
        return (v - p) / F.nullif(p.cast("double"), F.lit(0.0)) * 100
    if form == "ratio":
        return v / F.nullif(p.cast("double"), F.lit(0.0))
    raise ValueError(f"unknown change form {form}")


def calendar_lags(
    df: DataFrame, unit: list[str], slot: str, value: str, lags: list[int]
) -> DataFrame:
    """Value ``k`` slots earlier on the shared calendar; null where the slot is absent.

    ``slot`` is an integer index of the calendar. One window over the unit's own
    slots with a range frame finds the exact slot without a self-join.
    """
    out = df
    w = Window.partitionBy(*unit).orderBy(slot)
    for k in lags:
        out = out.withColumn(f"lag{k}", F.max(value).over(w.rangeBetween(-k, -k)))
    return out


def calendar_index(df: DataFrame, slot: str, out: str) -> DataFrame:
    """Dense index of the slots that occur anywhere (the calendar itself is tiny)."""
    slots = df.select(slot).distinct().agg(F.array_sort(F.collect_list(slot))).scalar()
    return df.withColumn(out, F.array_position(slots, F.col(slot)).cast("int"))


def spine(
    df: DataFrame, units: DataFrame, unit: list[str], period: str, first: Column, last: Column
) -> DataFrame:
    """Every period of ``[first, last]`` for every unit; gaps stay null.

    Reversed bounds give no rows.
    """
    years = F.when(first <= last, F.sequence(first, last))
    grid = units.select(*unit, F.explode(years).alias(period))
    return grid.join(df, [*unit, period], "left")


def common_support(df: DataFrame, unit: str, period: str, value: str, a: str, b: str) -> DataFrame:
    """Both units side by side with a state per period; the difference only where both exist."""
    wide = df.filter(F.col(unit).isin(a, b)).groupBy(period).agg(
        F.max(F.when(F.col(unit) == a, F.col(value))).alias("a"),
        F.max(F.when(F.col(unit) == b, F.col(value))).alias("b"),
    )
    state = (
        F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both")
        .when(F.col("a").isNotNull(), "only_a")
        .when(F.col("b").isNotNull(), "only_b")
        .otherwise("none")
    )
    return wide.withColumn("state", state).withColumn("difference", F.col("a") - F.col("b"))


def splice(period: Column, cut: int, before: Column, after: Column, names: tuple[str, str]) -> tuple[Column, Column]:
    """One series before the cut year, the other from it; with the source of each row."""
    early = period < cut
    return (
        F.when(early, before).otherwise(after),
        F.when(early & before.isNotNull(), names[0]).when(~early & after.isNotNull(), names[1]),
    )


def seam(df: DataFrame, unit: str, period: str, overlap: int, a: str, b: str) -> DataFrame:
    """Worst percent difference of two sources in their overlap period."""
    d = 100.0 * (F.col(b) - F.col(a)) / F.nullif(F.col(a).cast("double"), F.lit(0.0))
    rows = df.filter(F.col(period) == overlap).withColumn("_d", d).filter(F.col("_d").isNotNull())
    return rows.agg(
        F.max_by(unit, F.struct(F.abs("_d"), F.col(unit))).alias("worst_unit"),
        F.max_by("_d", F.struct(F.abs("_d"), F.col(unit))).alias("worst_pct"),
        F.count("*").alias("units"),
    )


def gaps(df: DataFrame, unit: list[str], index: str) -> DataFrame:
    """Periods that do not follow their predecessor by one."""
    w = Window.partitionBy(*unit).orderBy(index)
    return df.withColumn("previous_index", F.lag(index).over(w)).filter(
        F.col(index) - F.col("previous_index") != 1
    )


def latest_row(df: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """Latest row per key as an aggregate (partial results combine before the shuffle)."""
    return df.groupBy(*key).agg(
        F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values]
    )


def peak(df: DataFrame, key: list[str], period: str, value: str) -> DataFrame:
    """Period of the largest value per key (earliest on a tie) and that value."""
    best = F.struct(F.col(value), -F.col(period))
    return df.filter(F.col(value).isNotNull()).groupBy(*key).agg(
        F.max_by(period, best).alias(period), F.max(value).alias(value)
    )


def deflate(df: DataFrame, period: str, value: Column, index: DataFrame, level: str, base: int) -> Column:
    """Value x index(base) / index(period) with the index joined by the caller as ``level``."""
    at_base = index.filter(F.col(period) == base).agg(F.max(level)).scalar()
    return value * at_base / F.nullif(F.col(level).cast("double"), F.lit(0.0))
