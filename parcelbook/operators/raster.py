"""Raster cells as rows (tile, row, col, value).

A tile has a fixed pixel size, so windows along one row or column of a tile are short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: metres per degree of latitude and of longitude at the equator
M_PER_DEG_LAT = 110574.0
M_PER_DEG_LON = 111320.0


def block_mean(cells: DataFrame, tile: str, row: str, col: str, value: str, factor: int = 3) -> DataFrame:
    """Mean of whole factor x factor blocks; ragged edge blocks are dropped."""
    r, c = F.floor(F.col(row) / factor), F.floor(F.col(col) / factor)
    return (
        cells.groupBy(tile, r.alias(row), c.alias(col))
        .agg(F.avg(value).alias(value), F.count("*").alias("_n"))
        .filter(F.col("_n") == factor * factor)
        .drop("_n")
    )


def row_latitude(top: Column, cell_deg: float, row: Column) -> Column:
    """Latitude of the centre of a raster row."""
    return top - cell_deg * (row + 0.5)


def cell_width(lat: Column, cell_deg: float) -> Column:
    """East-west metres of a cell at a latitude."""
    return cell_deg * M_PER_DEG_LON * F.cos(lat * (math.pi / 180))


def cell_area(lat: Column, cell_deg: float) -> Column:
    return cell_width(lat, cell_deg) * (cell_deg * M_PER_DEG_LAT)


def neighbour_slope(
    cells: DataFrame, tile: str, row: str, col: str, value: str, lat: Column, cell_deg: float, out: str
) -> DataFrame:
    """Largest rise over run to the four neighbours in percent; tile edges have fewer."""
    across = Window.partitionBy(tile, row).orderBy(col)
    down = Window.partitionBy(tile, col).orderBy(row)

    def rise(w, order: str, step: int) -> Column:
        # range frame: only the cell exactly one step away counts
        other = F.max(value).over(w.rangeBetween(step, step))
        return F.abs(other - F.col(value))

    dx, dy = cell_width(lat, cell_deg), F.lit(cell_deg * M_PER_DEG_LAT)
    best = F.greatest(
        F.coalesce(rise(across, col, -1) / dx, F.lit(0.0)),
        F.coalesce(rise(across, col, 1) / dx, F.lit(0.0)),
        F.coalesce(rise(down, row, -1) / dy, F.lit(0.0)),
        F.coalesce(rise(down, row, 1) / dy, F.lit(0.0)),
    )
    return cells.withColumn(out, 100.0 * best)


def zonal_shares(cells: DataFrame, zone: str, steep: Column, water: Column, weight: Column, published_km2: DataFrame | None = None) -> DataFrame:
    """Area-weighted shares of steep, water and either, per zone; optional area error."""
    w = cells.withColumns({"_w": weight, "_s": steep, "_a": water})

    def share(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("_w")).otherwise(0.0)) / F.nullif(F.sum("_w"), F.lit(0.0))

    out = w.groupBy(zone).agg(
        (F.sum("_w") / 1e6).alias("land_km2"),
        share(F.col("_s") | F.col("_a")).alias("undevelopable_share"),
        share(F.col("_s")).alias("steep_share"),
        share(F.col("_a")).alias("water_share"),
        F.count("*").alias("cells"),
    )
    if published_km2 is None:
        return out
    joined = out.join(published_km2, zone, "left")
    return joined.withColumn(
        "area_err_pct",
        100.0 * F.abs(F.col("land_km2") - F.col("published_km2")) / F.nullif(F.col("published_km2"), F.lit(0.0)),
    )
