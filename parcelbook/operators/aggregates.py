"""Aggregates whose null, duplicate and completeness rules are part of the result."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def all_or_nothing(value: Column, blocked: Column | None = None) -> Column:
    """Sum only if every child has a value and none is blocked."""
    ok = F.count(value) == F.count(F.lit(1))
    if blocked is not None:
        ok = ok & ~F.coalesce(F.bool_or(blocked), F.lit(False))
    return F.when(ok, F.sum(value))


def only_if_single(match: Column, value: Column) -> Column:
    """The value of the only matching row; nothing when there are several."""
    return F.when(F.count_if(match) == 1, F.max(F.when(match, value)))


def published_mean(value: Column) -> tuple[Column, Column]:
    """(mean of published periods, how many were published)."""
    return F.avg(value), F.count(value)


def complete_periods(
    df: DataFrame, keys: list[str], value: str, needed: int, how: str = "sum"
) -> DataFrame:
    """Aggregate of groups that hold all their sub-periods: sum for flows, mean for rates."""
    agg = F.sum(value) if how == "sum" else F.avg(value)
    return (
        df.groupBy(*keys)
        .agg(agg.alias(value), F.count(value).alias("periods"))
        .filter(F.col("periods") == needed)
    )


def closing_value(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Last published month of each group and its value (December when present)."""
    seen = df.filter(F.col(value).isNotNull())
    return seen.groupBy(*keys).agg(
        F.max_by(value, month).alias(value), F.max(month).alias("month_used")
    )


def with_local_aggregates(
    df: DataFrame,
    unit: str,
    keys: list[str],
    values: list[str],
    total_label: str,
    merged: dict[str, list[str]],
) -> DataFrame:
    """Append a total row and merged units; a value is null unless all members carry it."""
    out = df.select(unit, *keys, *values)
    total = df.groupBy(*keys).agg(*[all_or_nothing(F.col(v)).alias(v) for v in values])
    out = out.unionByName(total.withColumn(unit, F.lit(total_label)))
    for label, members in merged.items():
        part = (
            df.filter(F.col(unit).isin(members))
            .groupBy(*keys)
            .agg(
                F.count_distinct(unit).alias("_members"),
                *[all_or_nothing(F.col(v)).alias(f"_{v}") for v in values],
            )
        )
        complete = F.col("_members") == len(members)
        out = out.unionByName(
            part.select(
                F.lit(label).alias(unit),
                *keys,
                *[F.when(complete, F.col(f"_{v}")).alias(v) for v in values],
            )
        )
    return out


def recombined_ratio(value: Column, weight: Column) -> Column:
    """Mean of several units weighted by their counts."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0))


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the grand total; the total is one scalar, not a one-partition window."""
    total = df.agg(F.sum(value).cast("double")).scalar()
    return df.withColumn(out, F.col(value) / F.nullif(total, F.lit(0.0)))


def guarded_corr(x: str, y: str, least: int = 2) -> Column:
    """Pearson correlation; null below ``least`` pairs or without variation.

    Written with covariance and deviations because ``corr`` raises on zero variance.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    enough = (F.count_if(both) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(enough, F.try_divide(F.covar_pop(a, b), spread))


def cross_tab(df: DataFrame, row: str, col: str, labels: list[str], weight: str | None = None) -> DataFrame:
    """Counts per row and column label with both percentage directions."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    wide = df.groupBy(row).pivot(col, labels).agg(w).na.fill(0)
    row_total = sum((F.col(f"`{c}`") for c in labels), F.lit(0))
    wide = wide.withColumn("row_total", row_total)
    totals = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in labels])
    out = wide
    for c in labels:
        column_total = totals.select(F.col(f"`{c}`").cast("double")).scalar()
        out = out.withColumn(
            f"{c}_row_pct", 100.0 * F.col(f"`{c}`") / F.nullif(F.col("row_total"), F.lit(0))
        ).withColumn(f"{c}_col_pct", 100.0 * F.col(f"`{c}`") / F.nullif(column_total, F.lit(0.0)))
    return out


def leave_one_out(df: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Totals without each row's own value, as ``<name>_rest``."""
    by = by or []
    if by:
        totals = df.groupBy(*by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        out = df.join(totals, by)
        for v in values:
            out = out.withColumn(f"{v}_rest", F.col(f"_{v}") - F.col(v)).drop(f"_{v}")
        return out
    out = df
    for v in values:
        out = out.withColumn(f"{v}_rest", df.agg(F.sum(v)).scalar() - F.col(v))
    return out


def distinct_text(value: Column, sep: str = ", ") -> Column:
    """Ordered list of a bounded set of labels (statuses, years)."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def coverage_cells(
    observed: DataFrame, units: DataFrame, unit: str, slots: Column, slot: str, value: str
) -> DataFrame:
    """Expected, observed and missing cells per unit on the grid unit x slot.

    ``slots`` is an array of the calendar; it is exploded next to each unit, so the
    grid is built without a join between units and periods.
    """
    grid = units.select(unit, F.explode(slots).alias(slot))
    cells = grid.join(observed.select(unit, slot, value), [unit, slot], "left")
    return cells.groupBy(unit).agg(
        F.count("*").alias("cells_expected"),
        F.count(value).alias("cells_observed"),
        (F.count("*") - F.count(value)).alias("cells_missing"),
        F.sum(value).alias(value),
    )


def concentration(df: DataFrame, by: list[str], value: str, key: str, k: int = 5) -> DataFrame:
    """Share of the k largest positive values in all positive values.

    The k largest are kept with a bounded per-group heap (``max_by``-style top-k on
    ranked rows): rows are first cut to the k largest of each input partition.
    """
    positive = df.filter(F.col(value) > 0)
    top = largest(positive, by, value, key, k).groupBy(*by).agg(F.sum(value).alias("top_sum"))
    total = df.groupBy(*by).agg(
        F.sum(F.when(F.col(value) > 0, F.col(value))).alias("positive_sum"),
        F.count_if(F.col(value) < 0).alias("negative_units"),
    )
    joined = total.join(top, by, "left") if by else total.withColumn(
        "top_sum", top.select("top_sum").scalar()
    )
    return joined.withColumn(
        "top_share", F.col("top_sum") / F.nullif(F.col("positive_sum"), F.lit(0.0))
    )


def concentration_members(df: DataFrame, by: list[str], value: str, key: str, k: int = 5) -> DataFrame:
    """(by, key, value, role): the k largest positive units by name, and every negative one."""
    top = largest(df.filter(F.col(value) > 0), by, value, key, k).select(*by, key, value, F.lit("top").alias("role"))
    return top.unionByName(df.filter(F.col(value) < 0).select(*by, key, value, F.lit("negative").alias("role")))


def largest(df: DataFrame, by: list[str], value: str, key: str, k: int, salt: int = 64) -> DataFrame:
    """Top k rows per group in two rounds, so no task sorts a whole hot group.

    Round one ranks inside (group, salt of the key); round two ranks at most
    ``k * salt`` survivors per group.
    """
    order = [F.col(value).desc_nulls_last(), F.col(key).asc()]
    salted = df.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(salt)))
    first = salted.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))
    ).filter(F.col("_n") <= k)
    return (
        first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        .filter(F.col("_n") <= k)
        .drop("_s")
        .withColumnRenamed("_n", "position")
    )


def vector_sum(array: Column | str, over: WindowSpec | None = None) -> Column:
    """Place-wise sum of arrays of equal length as one aggregate, however long they are."""
    summary = Summarizer.metrics("sum").summary(array_to_vector(F.col(array) if isinstance(array, str) else array))
    return vector_to_array((summary.over(over) if over is not None else summary)["sum"])
