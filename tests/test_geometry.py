"""Shapes with holes, concave outlines, edges and several parts."""

import math

import pytest
from pyspark.sql import functions as F

from parcelbook.operators import datum as D
from parcelbook.operators import geometry as G
from parcelbook.operators import raster as RA

SQ = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]
RIGHT = [[4.0, 0.0], [8.0, 0.0], [8.0, 4.0], [4.0, 4.0], [4.0, 0.0]]
ELL = [[0.0, 0.0], [10.0, 0.0], [10.0, 1.0], [1.0, 1.0], [1.0, 10.0], [0.0, 10.0], [0.0, 0.0]]


def shapes(spark, rows):
    return spark.createDataFrame(rows, f"id string, g {G.POLYGONS}")


def test_ring_rules_and_measures(spark):
    rows = [("sq", SQ), ("open", SQ[:4]), ("short", SQ[:2] + SQ[:1]), ("nan", [[0.0, 0.0], [math.nan, 1.0], [1.0, 1.0], [0.0, 0.0]]), ("flat", [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0]]), ("cw", SQ[::-1])]
    df = spark.createDataFrame(rows, f"id string, r {G.RING}")
    got = {r["id"]: r for r in df.select("id", G.ring_ok(F.col("r")).alias("ok"), G.ring_measure(F.col("r")).alias("m")).collect()}
    assert [got[k]["ok"] for k in ("sq", "open", "short", "nan", "flat")] == [True, False, False, False, True]
    assert tuple(got["sq"]["m"]) == (16.0, 2.0, 2.0) == tuple(got["cw"]["m"])
    assert got["open"]["m"] is None and got["flat"]["m"] is None


def test_polygon_measure(spark):
    rows = [("hole", [[SQ, HOLE]]), ("two", [[SQ], [RIGHT]]), ("eaten", [[HOLE, SQ]]), ("broken", [[SQ, HOLE[:3]]]), ("none", [])]
    got = {r["id"]: r["m"] for r in shapes(spark, rows).select("id", G.polygon_measure(F.col("g")).alias("m")).collect()}
    assert tuple(got["hole"]) == (12.0, 2.0, 2.0) and tuple(got["two"]) == (32.0, 4.0, 2.0)
    assert got["eaten"] is None and got["broken"] is None and got["none"] is None


def test_covers_counts_edges_not_holes(spark):
    pts = [(0.5, 0.5, True), (2.0, 2.0, False), (1.0, 2.0, True), (4.0, 4.0, True), (4.0001, 4.0, False), (0.0, 2.0, True)]
    df = spark.createDataFrame(pts, "x double, y double, want boolean").crossJoin(shapes(spark, [("a", [[SQ, HOLE]])]))
    assert all(r[0] == r[1] for r in df.select(G.covers(F.col("x"), F.col("y"), F.col("g")), "want").collect())


@pytest.mark.parametrize("cell", [1.5, 100.0])
def test_assignment_states(spark, cell):
    areas = shapes(spark, [("left", [[SQ]]), ("right", [[RIGHT]])])
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 2.0), (3, 9.0, 2.0), (4, 6.0, 0.0)], "k int, x double, y double")
    got = {r["k"]: (r["id"], r["match_status"]) for r in G.assign_points(pts, areas, "k", "x", "y", "id", "g", cell).collect()}
    assert got == {1: ("left", "matched"), 2: (None, "ambiguous"), 3: (None, "outside"), 4: ("right", "matched")}


def test_representative_point_is_inside(spark):
    rows = [("ell", [ELL]), ("ring", [SQ, HOLE]), ("sq", [SQ])]
    df = spark.createDataFrame(rows, f"id string, rings array<{G.RING}>")
    pts = G.representative_points(df, ["id"], "rings").join(df, "id")
    got = {r["id"]: r for r in pts.select("id", "px", "py", G.covers(F.col("px"), F.col("py"), F.array("rings")).alias("c")).collect()}
    assert all(r["c"] for r in got.values()) and (got["sq"]["px"], got["sq"]["py"]) == (2.0, 2.0)
    assert (got["ell"]["px"], got["ell"]["py"]) == (0.5, 5.5)


def test_footprint_states(spark):
    def box(x):
        x = float(x)
        return [[[x, 1.0], [x + 1, 1.0], [x + 1, 2.0], [x, 2.0], [x, 1.0]]]

    areas = shapes(spark, [("left", [[SQ]]), ("right", [[RIGHT]])])
    recs = [("one", [box(1)]), ("same", [box(0), box(2)]), ("cross", [box(1), box(6)]), ("part", [box(1), box(20)]), ("out", [box(20)]), ("edge", [box(3.5)]), ("none", None), ("empty", [])]
    got = {r["rec"]: (r["id"], r["match_status"]) for r in G.assign_footprints(shapes(spark, recs).withColumnsRenamed({"id": "rec", "g": "shape"}), areas, "rec", "shape", "id", "g", 3.0).collect()}
    assert got == {
        "one": ("left", "matched"), "same": ("left", "matched"), "cross": (None, "crosses_areas"), "part": (None, "partly_outside"),
        "out": (None, "outside"), "edge": (None, "ambiguous"), "none": (None, "missing_geometry"), "empty": (None, "missing_geometry"),
    }


def test_geojson(spark):
    docs = ['{"type":"Polygon","coordinates":[[[0,0,5],[1,0,5],[1,1,5],[0,0,5]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}', '{"type":"Point","coordinates":[1,2]}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(docs)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(G.geojson_polygons(F.col("s"))).collect()]
    assert got[0] == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]] and len(got[1]) == 2 and got[2] is None


def test_datum_shift_has_the_published_size(spark):
    df = spark.createDataFrame([(447000.0, 4114000.0), (440000.0, 4474000.0)], "x double, y double")
    for r in D.shift_planar(df, "x", "y", "nx", "ny").collect():
        assert -114 < r["nx"] - r["x"] < -107 and -211 < r["ny"] - r["y"] < -203


def test_projection_round_trip_up_to_the_edge_of_the_zone(spark, monkeypatch):
    for name, value in {"HAYFORD": D.GRS80, "SHIFT_M": (0.0, 0.0, 0.0), "ROTATION_ARCSEC": (0.0, 0.0, 0.0), "SCALE_PPM": 0.0}.items():
        monkeypatch.setattr(D, name, value)
    df = spark.createDataFrame([(447000.0, 4114000.0, 1), (120000.0, 4830000.0, 2), (880000.0, 3990000.0, 3), (None, 1.0, 4)], "x double, y double, lat int")
    for r in D.shift_planar(df, "x", "y", "nx", "ny").collect():
        assert (r.nx is None and r.lat == 4) or (abs(r.nx - r.x) < 1e-3 and abs(r.ny - r.y) < 1e-3)


def test_raster(spark):
    cells = [(0, i // 4, i % 4, float(v)) for i, v in enumerate([1, 2, 4, 4, 1, 2, 4, 4, 1, 2, 4, 9, 0, 0, 0, 0])]
    df = spark.createDataFrame(cells, "tile int, row int, col int, v double")
    blocks = {(r["row"], r["col"]): r["v"] for r in RA.block_mean(df, "tile", "row", "col", "v", 3).collect()}
    assert blocks == {(0, 0): 21 / 9}
    out = {(r["row"], r["col"]): r["s"] for r in RA.neighbour_slope(df, "tile", "row", "col", "v", F.lit(0.0), 1.0, "s").collect()}
    assert math.isclose(out[(0, 0)], 100 / 111320) and math.isclose(out[(2, 3)], 100 * 9 / 110574)


def test_zonal_shares_with_overlap_of_flags(spark):
    df = spark.createDataFrame([("z", True, True, 1e6), ("z", True, False, 1e6), ("z", False, False, 2e6)], "zone string, s boolean, w boolean, a double")
    r = RA.zonal_shares(df, "zone", F.col("s"), F.col("w"), F.col("a")).first()
    assert (r["land_km2"], r["undevelopable_share"], r["steep_share"], r["water_share"]) == (4.0, 0.5, 0.5, 0.25)


def test_a_large_area_takes_few_cells(spark):
    areas = shapes(spark, [("big", [[[[0.0, 0.0], [3000.0, 0.0], [3000.0, 2000.0], [0.0, 2000.0], [0.0, 0.0]]]]), ("small", [[SQ]])])
    grid = G._gridded(areas, "id", "g", 5.0).collect()
    for r in grid:
        size = 5.0 * 2 ** r["_level"]
        assert (r["_b"].xmax - r["_b"].xmin) / size <= G.SPAN
    pts = spark.createDataFrame([(1, 2999.0, 1999.0), (2, 1.0, 0.5), (3, -1.0, 0.0)], "k int, x double, y double")
    hits = {(r.k, r.id) for r in G.point_hits(pts, areas, "k", "x", "y", "id", "g", 5.0).collect()}
    assert (1, "big") in hits and {(2, "big"), (2, "small")} <= hits and not any(k == 3 for k, _ in hits)


def test_broken_rings_keep_their_row(spark):
    df = spark.createDataFrame([("open", [SQ[:-1]]), ("hole", [SQ, HOLE[:-1]]), ("sq", [SQ]), ("null", None)], f"id string, rings array<{G.RING}>")
    got = {r.id: (r.px, r.point_status) for r in G.representative_points(df, ["id"], "rings").collect()}
    assert got == {"open": (None, "broken"), "hole": (None, "broken"), "sq": (2.0, "centroid"), "null": (None, "broken")}


def _ring(*points):
    return [[float(a), float(b)] for a, b in points]


def _box(x0, y0, x1, y1):
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


TOPOLOGY = {
    "plain": ([[_box(0, 0, 10, 10)]], []),
    "hole": ([[_box(0, 0, 10, 10), _box(2, 2, 4, 4)]], []),
    "bow-tie": ([[_ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0))]], ["self_crossing"]),
    "spike": ([[_ring((0, 0), (10, 0), (10, 10), (10, 15), (10, 10), (0, 10), (0, 0))]], ["self_crossing"]),
    "touches itself": ([[_ring((0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0))]], ["self_crossing"]),
    "repeated point": ([[_ring((0, 0), (0, 0), (10, 0), (10, 10), (0, 10), (0, 0))]], []),
    "hole across": ([[_box(0, 0, 10, 10), _box(8, 8, 12, 12)]], ["hole_outside"]),
    "hole far": ([[_box(0, 0, 10, 10), _box(20, 20, 22, 22)]], ["hole_outside"]),
    "hole touches": ([[_box(0, 0, 10, 10), _ring((0, 5), (2, 4), (2, 6), (0, 5))]], []),
    "same hole": ([[_box(0, 0, 10, 10), _box(2, 2, 4, 4), _box(2, 2, 4, 4)]], ["hole_overlap"]),
    "hole in hole": ([[_box(0, 0, 10, 10), _box(3, 3, 4, 4), _box(2, 2, 6, 6)]], ["hole_overlap"]),
    "holes share an edge": ([[_box(0, 0, 10, 10), _box(2, 2, 4, 4), _box(4, 2, 6, 4)]], []),
    "shared edge": ([[_box(0, 0, 10, 10)], [_box(10, 0, 20, 10)]], []),
    "shared corner": ([[_box(0, 0, 10, 10)], [_box(10, 10, 12, 12)]], []),
    "overlap": ([[_box(0, 0, 10, 10)], [_box(5, 5, 15, 15)]], ["overlap"]),
    "overlap along edges": ([[_box(0, 0, 10, 10)], [_box(5, 0, 15, 10)]], ["overlap"]),
    "twice": ([[_box(0, 0, 10, 10)], [_box(0, 0, 10, 10)]], ["overlap"]),
    "inside": ([[_box(2, 2, 3, 3)], [_box(0, 0, 10, 10)]], ["overlap"]),
    "in a hole": ([[_box(0, 0, 10, 10), _box(2, 2, 8, 8)], [_box(3, 3, 5, 5)]], []),
    "fills a hole": ([[_box(0, 0, 10, 10), _box(2, 2, 8, 8)], [_box(2, 2, 8, 8)]], []),
    "over a hole": ([[_box(0, 0, 10, 10), _box(2, 2, 8, 8)], [_box(1, 1, 9, 9)]], ["overlap"]),
    "open ring": ([[_box(0, 0, 1, 1)[:4]]], None),
    "nothing": ([], None),
    "null": (None, None),
}


def test_topology_names_what_is_wrong(spark):
    df = spark.createDataFrame([(k, g) for k, (g, _) in TOPOLOGY.items()], "k string, g array<array<array<array<double>>>>")
    got = {r.k: r.t for r in df.select("k", G.topology(df.g).alias("t")).collect()}
    assert got == {k: want for k, (_, want) in TOPOLOGY.items()}
