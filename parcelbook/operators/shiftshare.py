"""Shift-share shocks from (unit, origin, year) stocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_years(stocks: DataFrame, unit: str, origin: str, year: str, value: str, t0: int, t1: int) -> DataFrame:
    """Base and end stock per unit and origin; an absent cell is 0."""
    return (
        stocks.filter(F.col(year).isin(t0, t1))
        .groupBy(unit, origin)
        .agg(
            F.sum(F.when(F.col(year) == t0, F.col(value)).otherwise(0.0)).alias("base"),
            F.sum(F.when(F.col(year) == t1, F.col(value)).otherwise(0.0)).alias("end"),
        )
    )


def national_growth(wide: DataFrame, origin: str, leave_out_unit: bool) -> DataFrame:
    """Growth by origin; leaving a unit out is total minus own, so each row is its own unit's view."""
    totals = wide.groupBy(origin).agg(F.sum("base").alias("_b"), F.sum("end").alias("_e"))
    if not leave_out_unit:
        g = (F.col("_e") - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0.0))
        return totals.select(origin, F.coalesce(g, F.lit(0.0)).alias("growth"))
    b, e = F.col("_b") - F.col("base"), F.col("_e") - F.col("end")
    return (
        wide.join(totals, origin)
        .withColumn("growth", F.coalesce((e - b) / F.nullif(b, F.lit(0.0)), F.lit(0.0)))
        .drop("_b", "_e")
    )


def base_shares(wide: DataFrame, unit: str) -> DataFrame:
    """Share of each origin in the unit's base stock (0 when the unit has none)."""
    totals = wide.groupBy(unit).agg(F.sum("base").alias("_t"))
    return (
        wide.join(totals, unit)
        .withColumn("share", F.coalesce(F.col("base") / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0)))
        .drop("_t")
    )


def predicted_shock(stocks: DataFrame, unit: str, origin: str, year: str, value: str, t0: int, t1: int, leave_out_unit: bool = True) -> DataFrame:
    """Sum over origins of base share x growth, and the same with base levels.

    An origin absent from a unit in both years has share 0 and adds nothing, so the
    unit x origin grid is not completed.
    """
    wide = base_shares(two_years(stocks, unit, origin, year, value, t0, t1), unit)
    if leave_out_unit:
        grown = national_growth(wide, origin, True)
    else:
        grown = wide.join(national_growth(wide, origin, False), origin)
    return grown.groupBy(unit).agg(
        F.sum(F.col("share") * F.col("growth")).alias("shock"),
        F.sum(F.col("base") * F.col("growth")).alias("predicted_change"),
        F.sum("base").alias("base_stock"),
    )
