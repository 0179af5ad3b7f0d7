"""Wide sheets to long rows and long measures back onto one key grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelbook.operators.order_stats import null_safe_join


def melt_measure_year(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``measure_YY`` columns -> (measure, yr, value) of populated cells."""
    long = df.unpivot(keys, columns, "_k", "value").filter(F.col("value").isNotNull())
    return long.select(
        *keys,
        F.regexp_extract("_k", r"^(.*)_(\d{2})$", 1).alias("measure"),
        (F.lit(2000) + F.regexp_extract("_k", r"^(.*)_(\d{2})$", 2).cast("int")).alias("yr"),
        "value",
    )


def carry_section(
    df: DataFrame, sheet: list[str], row_no: str, header: str, out: str, block: int = 1_000_000
) -> DataFrame:
    """Rows inherit the last section header above them on the same sheet.

    Row numbers are cut into blocks, so a long sheet is shared by many tasks: the last
    header of each block is carried into the following blocks, then filled inside.
    """
    rows = df.withColumn("_block", F.floor(F.col(row_no) / block))
    seen = F.col(header).isNotNull()
    ends = rows.groupBy(*sheet, "_block").agg(
        F.max_by(header, F.when(seen, F.col(row_no))).alias("_end")
    )
    above = Window.partitionBy(*sheet).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*sheet, "_block", F.last("_end", ignorenulls=True).over(above).alias("_carry"))
    inside = Window.partitionBy(*sheet, "_block").orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_in", F.last(header, ignorenulls=True).over(inside))
    return (
        null_safe_join(filled, carried, [*sheet, "_block"])
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_in", "_carry", "_block")
    )


def on_key_grid(
    measures: dict[str, DataFrame], keys: list[str], label: str, value: str
) -> DataFrame:
    """Union of all keys with every measure attached, plus a label-conflict flag."""
    stacked = None
    for name, df in measures.items():
        part = df.select(*keys, label, F.col(value).cast("double").alias("_v"), F.lit(name).alias("_m"))
        stacked = part if stacked is None else stacked.unionByName(part)
    names = list(measures)
    return stacked.groupBy(*keys).agg(
        F.min(label).alias(label),
        (F.min(label) != F.max(label)).alias("label_conflict"),
        *[F.max(F.when(F.col("_m") == n, F.col("_v"))).alias(n) for n in names],
    )
