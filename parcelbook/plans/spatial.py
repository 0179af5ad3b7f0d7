"""Polygons, points and raster cells derived from the tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.operators import datum as D
from parcelbook.operators import geometry as G
from parcelbook.operators import raster as RA
from parcelbook.plans.registry import query
from parcelbook.session import spread
from parcelbook.sources.tables import load

Spark = SparkSession


def _k() -> Column:
    return F.col("p_partkey") % 100


def _footprint() -> Column:
    """One polygon per part: a rectangle with a hole, placed by its key."""
    x0, y0 = _k() * 20.0, F.col("p_size") * 30.0
    w, h = 4.0 + F.col("p_size") % 5, 6.0 + _k() % 3
    outer = G.rect(x0, y0, x0 + w, y0 + h)
    hole = G.rect(x0 + 1, y0 + 1, x0 + 2, y0 + 3)
    return F.array(F.array(outer, hole))


FOOT = "(p_partkey % 100) * 20.0 AS x0, p_size * 30.0 AS y0, 4.0 + p_size % 5 AS w, 6.0 + (p_partkey % 100) % 3 AS h"


@query("x01_ring_validity", "SELECT p_partkey, p_size % 4 IN (1, 2) AS valid FROM part")
def x01(spark: Spark, d: str) -> DataFrame:
    x, y = _k() * 1.0, F.col("p_size") * 1.0
    good = G.rect(x, y, x + 2, y + 2)
    m = F.col("p_size") % 4
    ring = (
        F.when(m == 0, F.slice(good, 1, 4))  # not closed
        .when(m == 3, F.transform(good, lambda p: F.array(p[0], F.lit(float("nan")))))  # not finite
        .otherwise(good)
    )
    return load(spark, d, "part").select("p_partkey", G.ring_ok(ring).alias("valid"))


@query(
    "x02_ring_measure",
    f"SELECT p_partkey, round((w * h)::DOUBLE, 6) AS area, round((x0 + w / 2)::DOUBLE, 6) AS cx, round((y0 + h / 2)::DOUBLE, 6) AS cy FROM (SELECT p_partkey, {FOOT} FROM part)",
)
def x02(spark: Spark, d: str) -> DataFrame:
    parts = load(spark, d, "part").select("p_partkey", G.ring_measure(_footprint()[0][0]).alias("m"))
    return parts.select("p_partkey", "m.area", "m.cx", "m.cy")


@query(
    "x03_polygon_measure",
    f"""SELECT p_partkey, round((w * h - 2)::DOUBLE, 6) AS area, round(((w * h * (x0 + w / 2) - 2 * (x0 + 1.5)) / (w * h - 2))::DOUBLE, 6) AS cx, round(((w * h * (y0 + h / 2) - 2 * (y0 + 2)) / (w * h - 2))::DOUBLE, 6) AS cy FROM (SELECT p_partkey, {FOOT} FROM part)""",
)
def x03(spark: Spark, d: str) -> DataFrame:
    parts = load(spark, d, "part").select("p_partkey", G.polygon_measure(_footprint()).alias("m"))
    return parts.select("p_partkey", "m.area", "m.cx", "m.cy")


@query(
    "x03_topology",
    """SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 'self_crossing' WHEN 2 THEN 'hole_outside' WHEN 3 THEN 'overlap' WHEN 5 THEN 'hole_overlap' WHEN 6 THEN 'self_crossing,overlap' WHEN 7 THEN NULL ELSE '' END AS states FROM part""",
)
def x03b(spark: Spark, d: str) -> DataFrame:
    """Polygons that cross themselves, whose holes lie outside or share area, or that overlap; shared edges are sound."""
    x, y = _k() * 20.0, F.col("p_size") * 30.0
    kind = F.col("p_size") % 8

    def box(x0: float, y0: float, x1: float, y1: float):
        return G.rect(x + x0, y + y0, x + x1, y + y1)

    bow = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (8, 8), (8, 0), (0, 8), (0, 0))])
    shell, hole = box(0, 0, 8, 8), box(1, 1, 3, 3)
    polygons = (
        F.when(kind == 0, F.array(F.array(shell, hole), F.array(box(8, 0, 12, 8))))
        .when(kind == 1, F.array(F.array(bow)))
        .when(kind == 2, F.array(F.array(shell, box(6, 6, 9, 9))))
        .when(kind == 3, F.array(F.array(shell), F.array(box(4, 0, 12, 8))))
        .when(kind == 4, F.array(F.array(shell, hole), F.array(hole)))
        .when(kind == 5, F.array(F.array(shell, hole, box(2, 2, 4, 4))))
        .when(kind == 6, F.array(F.array(bow), F.array(box(1, 3, 3, 5))))
        .otherwise(F.array(F.array(F.slice(shell, 1, 4))))
    )
    parts = spread(load(spark, d, "part")).select("p_partkey", polygons.alias("g"))
    return parts.select("p_partkey", F.array_join(G.topology(F.col("g")), ",").alias("states"))


@query("x04_bounding_box", f"SELECT p_partkey, x0::DOUBLE AS xmin, y0::DOUBLE AS ymin, (x0 + w)::DOUBLE AS xmax, (y0 + h)::DOUBLE AS ymax FROM (SELECT p_partkey, {FOOT} FROM part)")
def x04(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", G.bbox(_footprint()).alias("b")).select("p_partkey", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query(
    "x05_point_location",
    """WITH p AS (SELECT c_custkey, CAST(c_custkey % 13 AS DOUBLE) / 2 AS x, CAST((c_custkey // 13) % 13 AS DOUBLE) / 2 AS y FROM customer)
    SELECT c_custkey, CASE WHEN x > 5 OR y > 5 THEN 0 WHEN x IN (0, 5) OR y IN (0, 5) THEN 2 ELSE 1 END AS outer_side, x <= 5 AND y <= 5 AND NOT (x > 1 AND x < 3 AND y > 1 AND y < 3) AS covered FROM p""",
)
def x05(spark: Spark, d: str) -> DataFrame:
    # lattice points against a square with a square hole: inside, edges, corners, hole
    x, y = F.col("x"), F.col("y")
    outer = G.rect(F.lit(0), F.lit(0), F.lit(5), F.lit(5))
    hole = G.rect(F.lit(1), F.lit(1), F.lit(3), F.lit(3))
    k = F.col("c_custkey")
    pts = load(spark, d, "customer").select("c_custkey", ((k % 13) / 2.0).alias("x"), (F.floor(k / 13) % 13 / 2.0).cast("double").alias("y"))
    return pts.select("c_custkey", G.ring_location(x, y, outer).alias("outer_side"), G.covers(x, y, F.array(F.array(outer, hole))).alias("covered"))


def _areas(spark: Spark, d: str) -> DataFrame:
    """One square per nation on a 5 x 5 board; neighbours share edges, one square overlaps the next.

    The last one reaches far out, over more cells than a grid of one size would take.
    """
    n = F.col("n_nationkey")
    x0, y0 = (n % 5) * 10.0, F.floor(n / 5) * 10.0
    x1 = x0 + F.when(n == 7, 14.0).when(n == 24, 9000.0).otherwise(10.0)
    return load(spark, d, "nation").select(F.col("n_name").alias("area"), F.array(F.array(G.rect(x0, y0, x1, y0 + 10))).alias("polygons"))


AREAS = "ar AS (SELECT n_name AS area, (n_nationkey % 5) * 10.0 AS x0, (n_nationkey // 5) * 10.0 AS y0, (n_nationkey % 5) * 10.0 + CASE n_nationkey WHEN 7 THEN 14 WHEN 24 THEN 9000 ELSE 10 END AS x1 FROM nation)"
POINTS = "pt AS (SELECT c_custkey, (c_custkey * 7 % 1099) / 20.0::DOUBLE AS x, (c_custkey * 13 % 1051) / 20.0::DOUBLE AS y FROM customer)"


def _points(spark: Spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", (k * 7 % 1099 / 20.0).alias("x"), (k * 13 % 1051 / 20.0).alias("y"))


@query("j18_point_in_polygon", f"WITH {AREAS}, {POINTS} SELECT c_custkey, area FROM pt JOIN ar ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y0 + 10")
def j18(spark: Spark, d: str) -> DataFrame:
    return G.point_hits(_points(spark, d), _areas(spark, d), "c_custkey", "x", "y", "area", "polygons", 5.0)


@query(
    "x06_area_assignment",
    f"""WITH {AREAS}, {POINTS}, h AS (SELECT c_custkey, count(area) AS hits, max(area) AS a FROM pt LEFT JOIN ar ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y0 + 10 GROUP BY 1)
    SELECT c_custkey, hits, CASE WHEN hits = 1 THEN a END AS area, CASE WHEN hits = 1 THEN 'matched' WHEN hits > 1 THEN 'ambiguous' ELSE 'outside' END AS match_status FROM h""",
)
def x06(spark: Spark, d: str) -> DataFrame:
    out = G.assign_points(_points(spark, d), _areas(spark, d), "c_custkey", "x", "y", "area", "polygons", 5.0)
    return out.select("c_custkey", "hits", "area", "match_status")


@query(
    "x07_representative_point",
    """SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN (CASE WHEN p_size % 2 = 0 THEN (p_partkey % 100) + 5.0 ELSE (p_partkey % 100) + 1.0 END)::DOUBLE END AS px, CASE WHEN p_size % 7 > 0 THEN (CASE WHEN p_size % 2 = 0 THEN p_size + 4.0 ELSE p_size + 4.5 END)::DOUBLE END AS py,
    CASE WHEN p_size % 7 = 0 THEN 'broken' WHEN p_size % 2 = 0 THEN 'centroid' ELSE 'scanline' END AS point_status FROM part""",
)
def x07(spark: Spark, d: str) -> DataFrame:
    # even sizes are plain rectangles; odd ones a U whose centroid falls in its gap; some rings are not closed
    x, y = _k() * 1.0, F.col("p_size") * 1.0
    corners = [(0, 0), (10, 0), (10, 9), (8, 9), (8, 0.5), (2, 0.5), (2, 8.5), (0, 8.5), (0, 0)]
    u = F.array(*[F.array(x + a, y + b) for a, b in corners])
    ring = F.when(F.col("p_size") % 2 == 0, G.rect(x, y, x + 10, y + 8)).otherwise(u)
    ring = F.when(F.col("p_size") % 7 == 0, F.slice(ring, 1, 4)).otherwise(ring)
    return G.representative_points(spread(load(spark, d, "part")).select("p_partkey", F.array(ring).alias("rings")), ["p_partkey"], "rings")


@query(
    "x08_footprint_assignment",
    f"""WITH {AREAS}, b AS (SELECT p_partkey, p_size, (p_partkey * 7 % 113) / 2.0 + 0.25 AS x, (p_partkey * 3 % 107) / 2.0 + 0.25 AS y FROM part), c AS (SELECT p_partkey, 1 AS i, x + 0.5 AS cx, y + 0.5 AS cy FROM b UNION ALL SELECT p_partkey, 2, x + 4.5, y + 0.5 FROM b WHERE p_size % 3 = 0),
    h AS (SELECT p_partkey, i, count(area) AS hits, max(area) AS a FROM c LEFT JOIN ar ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y0 + 10 GROUP BY 1, 2),
    r AS (SELECT p_partkey, count(*) FILTER (WHERE hits > 1) AS amb, count(*) FILTER (WHERE hits <> 1) AS un, count(DISTINCT a) FILTER (WHERE hits = 1) AS n, max(a) FILTER (WHERE hits = 1) AS a FROM h GROUP BY 1),
    s AS (SELECT p_partkey, a, CASE WHEN p_partkey % 50 = 0 THEN 'missing_geometry' WHEN amb > 0 THEN 'ambiguous' WHEN n > 1 THEN 'crosses_areas' WHEN un > 0 AND n > 0 THEN 'partly_outside' WHEN un > 0 THEN 'outside' ELSE 'matched' END AS match_status FROM r)
    SELECT p_partkey, CASE WHEN match_status = 'matched' THEN a END AS area, match_status FROM s""",
)
def x08(spark: Spark, d: str) -> DataFrame:
    x, y = F.col("p_partkey") * 7 % 113 / 2.0 + 0.25, F.col("p_partkey") * 3 % 107 / 2.0 + 0.25
    one = F.array(G.rect(x, y, x + 1, y + 1))
    two = F.array(G.rect(x + 4, y, x + 5, y + 1))
    shapes = F.when(F.col("p_size") % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    # every fiftieth record has no geometry
    records = spread(load(spark, d, "part")).select("p_partkey", F.when(F.col("p_partkey") % 50 != 0, shapes).alias("shapes"))
    return G.assign_footprints(records, _areas(spark, d), "p_partkey", "shapes", "area", "polygons", 5.0)


@query(
    "x09_geometry_json",
    """SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 2 THEN NULL ELSE 1 + p_size % 3 END AS INT) AS polygons, CASE WHEN p_size % 3 < 2 THEN CAST((1 + p_size % 3) * p_size AS DOUBLE) END AS area FROM part""",
)
def x09(spark: Spark, d: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    ring = F.concat(F.lit("[[0,0,7],["), s, F.lit(",0,7],["), s, F.lit(",1,7],[0,1,7],[0,0,7]]"))
    far = F.concat(F.lit("[[100,0,7],["), (100 + F.col("p_size")).cast("string"), F.lit(",0,7],["), (100 + F.col("p_size")).cast("string"), F.lit(",1,7],[100,1,7],[100,0,7]]"))
    m = F.col("p_size") % 3
    doc = (
        F.when(m == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}")))
        .when(m == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), far, F.lit("]]}")))
        .otherwise(F.lit('{"type":"Point","coordinates":[1,2]}'))
    )
    polys = load(spark, d, "part").select("p_partkey", G.geojson_polygons(doc).alias("g"))
    return polys.select("p_partkey", F.when(F.col("g").isNotNull(), F.size("g")).alias("polygons"), G.polygon_measure(F.col("g"))["area"].alias("area"))


@query(
    "x10_datum_shift",
    f"""SELECT c_custkey, x, y, round(east, 3) AS new_x, round(north, 3) AS new_y FROM ({D.shift_sql("SELECT c_custkey, 440000.0::DOUBLE + c_custkey % 997 * 10 AS x, 4110000.0::DOUBLE + c_custkey % 983 * 10 AS y FROM customer", "x", "y")})""",
)
def x10(spark: Spark, d: str) -> DataFrame:
    """Customer coordinates around one city moved between datums."""
    k = F.col("c_custkey")
    pts = load(spark, d, "customer").select("c_custkey", (440000.0 + k % 997 * 10).alias("x"), (4110000.0 + k % 983 * 10).alias("y"))
    moved = D.shift_planar(pts, "x", "y", "new_x", "new_y")
    return moved.withColumns({c: F.round(c, 3) for c in ("new_x", "new_y")})


DEG = 0.0008333
def _dense(spark: Spark, d: str) -> DataFrame:
    """Full board: lines of one ship month and supplier block form a tile."""
    li = load(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("tile"), (F.col("l_partkey") % 15).alias("row"), (F.col("l_orderkey") % 12).alias("col")
    ).agg((F.round(F.sum("l_extendedprice"), 2) / F.count("*")).alias("v"))


DENSE = "ce AS (SELECT l_returnflag AS tile, l_partkey % 15 AS row, l_orderkey % 12 AS col, round(sum(l_extendedprice), 2) / count(*) AS v FROM lineitem GROUP BY 1, 2, 3)"


@query("x11_block_mean", f"WITH {DENSE} SELECT tile, row // 3 AS row, col // 3 AS col, round(avg(v), 6) AS v FROM ce GROUP BY 1, 2, 3 HAVING count(*) = 9")
def x11(spark: Spark, d: str) -> DataFrame:
    return RA.block_mean(_dense(spark, d), "tile", "row", "col", "v", 3)


@query(
    "x12_neighbour_slope",
    f"""WITH {DENSE}, g AS (SELECT a.*, radians(40.0 - {DEG} * (a.row + 0.5)) AS lat FROM ce a), n AS (SELECT a.tile, a.row, a.col, max(CASE WHEN b.row = a.row THEN abs(b.v - a.v) / ({DEG} * 111320.0 * cos(a.lat)) ELSE abs(b.v - a.v) / ({DEG} * 110574.0) END) AS s
      FROM g a JOIN ce b ON a.tile = b.tile AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2, 3) SELECT tile, row, col, round(100.0 * s, 4) AS slope FROM n""",
)
def x12(spark: Spark, d: str) -> DataFrame:
    lat = RA.row_latitude(F.lit(40.0), DEG, F.col("row"))
    out = RA.neighbour_slope(_dense(spark, d), "tile", "row", "col", "v", lat, DEG, "slope")
    return out.select("tile", "row", "col", F.round("slope", 4).alias("slope"))


@query(
    "x13_zonal_shares",
    f"""WITH {DENSE}, g AS (SELECT *, CASE WHEN (row + 0.5) <= 7 THEN 'north' ELSE 'south' END AS zone, {DEG} * 111320.0 * cos(radians(40.0 - {DEG} * (row + 0.5))) * {DEG} * 110574.0 AS w, v > 27000 AS steep, v < 23000 AS water FROM ce WHERE row + 0.5 <> 7)
    SELECT zone, round(sum(w) / 1e6, 6) AS land_km2, round(sum(CASE WHEN steep OR water THEN w ELSE 0 END) / sum(w), 6) AS undevelopable_share, round(sum(CASE WHEN steep THEN w ELSE 0 END) / sum(w), 6) AS steep_share, round(sum(CASE WHEN water THEN w ELSE 0 END) / sum(w), 6) AS water_share,
    count(*) AS cells, CAST(CASE WHEN zone = 'north' THEN 1.5 ELSE 2.0 END AS DOUBLE) AS published_km2, round(100.0 * abs(sum(w) / 1e6 - CASE WHEN zone = 'north' THEN 1.5 ELSE 2.0 END) / CASE WHEN zone = 'north' THEN 1.5 ELSE 2.0 END, 6) AS area_err_pct FROM g GROUP BY zone""",
)
def x13(spark: Spark, d: str) -> DataFrame:
    # cell centres are joined to zone polygons, then weighted by the true cell area
    cells = _dense(spark, d).withColumns(
        {"key": F.concat_ws("/", "tile", F.col("row").cast("string"), F.col("col").cast("string")), "px": F.col("col") + 0.5, "py": F.col("row") + 0.5}
    )
    names = spark.createDataFrame([("north", 0.0, 7.0, 1.5), ("south", 7.0, 15.0, 2.0)], "zone string, y0 double, y1 double, published_km2 double")
    zones = names.select("zone", F.array(F.array(G.rect(F.lit(0.0), F.col("y0"), F.lit(12.0), F.col("y1")))).alias("polygons"))
    hits = G.assign_points(cells, zones, "key", "px", "py", "zone", "polygons", 4.0).filter("match_status = 'matched'")
    lat = RA.row_latitude(F.lit(40.0), DEG, F.col("row"))
    return RA.zonal_shares(hits, "zone", F.col("v") > 27000, F.col("v") < 23000, RA.cell_area(lat, DEG), names.select("zone", "published_km2"))
