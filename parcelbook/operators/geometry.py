"""Planar polygons as arrays: polygon list -> rings (outer first) -> [x, y] points.

Measures and point location are higher-order functions on the arrays, so they run
inside the JVM next to the scan. Joins between points and areas are equi-joins on
grid cells with an exact test afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelbook.functions import let

RING = "array<array<double>>"
POLYGONS = "array<array<array<array<double>>>>"
EDGE_TOL = 1e-7


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed counter-clockwise rectangle ring."""
    pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in pts])


def ring_ok(ring: Column) -> Column:
    """At least four points, closed, two finite coordinates each."""
    inf = F.lit(float("inf"))
    n = F.size(ring)
    shape = F.forall(
        ring,
        lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)),
    )
    closed = F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1))
    return F.coalesce((n >= 4) & shape & closed, F.lit(False))


def ring_moments(ring: Column) -> Column:
    """struct(twice_area, sx, sy) by the shoelace sum about the first point."""
    ox, oy = ring[0][0], ring[0][1]
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(
            (a[0] - ox).alias("ax"), (a[1] - oy).alias("ay"), (b[0] - ox).alias("bx"), (b[1] - oy).alias("by")
        ),
    )
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def step(acc: Column, e: Column) -> Column:
        c = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct(
            (acc["t"] + c).alias("t"),
            (acc["sx"] + (e["ax"] + e["bx"]) * c).alias("sx"),
            (acc["sy"] + (e["ay"] + e["by"]) * c).alias("sy"),
        )

    return F.aggregate(pairs, zero, step)


def ring_measure(ring: Column) -> Column:
    """struct(area, cx, cy); null for a broken or degenerate ring."""

    def measured(m: Column) -> Column:
        t = F.nullif(m["t"], F.lit(0.0))
        out = F.struct(
            (F.abs(m["t"]) / 2).alias("area"),
            (ring[0][0] + m["sx"] / (3 * t)).alias("cx"),
            (ring[0][1] + m["sy"] / (3 * t)).alias("cy"),
        )
        return F.when(F.abs(m["t"]) >= 1e-8, out)

    return F.when(ring_ok(ring), let(ring_moments(ring), measured))


def polygon_measure(polygons: Column) -> Column:
    """struct(area, cx, cy) of polygons with holes.

    Null when any ring is broken or the holes of a polygon consume it.
    """

    def one_polygon(rings: Column) -> Column:
        # outer ring counts positive, holes negative; a broken ring makes it null
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n"))

        def step(s: Column, r: Column) -> Column:
            a = F.when(s["n"] == 0, r["area"]).otherwise(-r["area"])
            return F.struct(
                (s["a"] + a).alias("a"),
                (s["x"] + a * r["cx"]).alias("x"),
                (s["y"] + a * r["cy"]).alias("y"),
                (s["n"] + 1).alias("n"),
            )

        return F.aggregate(F.transform(rings, ring_measure), zero, step)

    def combine(parts: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        total = F.aggregate(
            parts,
            zero,
            lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")),
        )
        usable = (F.size(parts) > 0) & F.forall(parts, lambda p: F.coalesce(p["a"] > 0, F.lit(False)))
        return F.when(
            usable,
            let(total, lambda t: F.struct(t["a"].alias("area"), (t["x"] / t["a"]).alias("cx"), (t["y"] / t["a"]).alias("cy"))),
        )

    return F.when(polygons.isNotNull(), let(F.transform(polygons, one_polygon), combine))


def bbox(polygons: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) over all points."""
    pts = F.flatten(F.flatten(polygons))
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def ring_location(x: Column, y: Column, ring: Column) -> Column:
    """0 outside, 1 inside, 2 on the boundary (within tolerance)."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")),
    )

    def locate(s: Column) -> Column:
        px, py = s["x"], s["y"]

        def on_edge(e: Column) -> Column:
            dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
            cross = (px - e["ax"]) * dy - (py - e["ay"]) * dx
            return (
                (F.abs(cross) <= EDGE_TOL * F.greatest(F.lit(1.0), F.hypot(dx, dy)))
                & px.between(F.least(e["ax"], e["bx"]) - EDGE_TOL, F.greatest(e["ax"], e["bx"]) + EDGE_TOL)
                & py.between(F.least(e["ay"], e["by"]) - EDGE_TOL, F.greatest(e["ay"], e["by"]) + EDGE_TOL)
            )

        def crosses(e: Column) -> Column:
            straddles = (e["ay"] > py) != (e["by"] > py)
            at = e["ax"] + (py - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
            return straddles & (px < at)

        return F.when(F.exists(s["e"], on_edge), F.lit(2)).otherwise(F.size(F.filter(s["e"], crosses)) % 2)

    return let(F.struct(x.alias("x"), y.alias("y"), edges.alias("e")), locate)


def covers(x: Column, y: Column, polygons: Column) -> Column:
    """Point covered by any polygon; boundaries count, hole interiors do not."""

    def one(rings: Column) -> Column:
        sides = F.transform(rings, lambda r: ring_location(x, y, r))
        # outer ring first: covered when on any edge, or inside it and in no hole
        return let(
            sides,
            lambda s: (s[0] > 0)
            & (F.array_contains(s, 2) | ~F.exists(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda h: h == 1)),
        )

    return F.coalesce(F.exists(polygons, one), F.lit(False))


# -------------------------------------------------------------------- topology


def _segments(ring: Column) -> Column:
    """Edges of a ring as structs; those without length are left out."""
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")),
    )
    return F.filter(pairs, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def _turn(e: Column, x: Column, y: Column) -> Column:
    """Distance of a point from an edge's line, with the side as its sign."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    return (dx * (y - e["ay"]) - dy * (x - e["ax"])) / F.hypot(dx, dy)


def _boxes_meet(e: Column, f: Column) -> Column:
    return (
        (F.least(e["ax"], e["bx"]) <= F.greatest(f["ax"], f["bx"]) + EDGE_TOL)
        & (F.least(f["ax"], f["bx"]) <= F.greatest(e["ax"], e["bx"]) + EDGE_TOL)
        & (F.least(e["ay"], e["by"]) <= F.greatest(f["ay"], f["by"]) + EDGE_TOL)
        & (F.least(f["ay"], f["by"]) <= F.greatest(e["ay"], e["by"]) + EDGE_TOL)
    )


def _meet(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common."""
    sides = lambda g, h: (_turn(g, h["ax"], h["ay"]) > EDGE_TOL) & (_turn(g, h["bx"], h["by"]) > EDGE_TOL) | (_turn(g, h["ax"], h["ay"]) < -EDGE_TOL) & (_turn(g, h["bx"], h["by"]) < -EDGE_TOL)
    return _boxes_meet(e, f) & ~sides(e, f) & ~sides(f, e)


def _turns_back(e: Column, f: Column) -> Column:
    """Whether the next edge runs back along this one."""
    dot = (e["bx"] - e["ax"]) * (f["bx"] - f["ax"]) + (e["by"] - e["ay"]) * (f["by"] - f["ay"])
    return (F.abs(_turn(e, f["bx"], f["by"])) <= EDGE_TOL) & (dot < 0)


def ring_crosses(ring: Column) -> Column:
    """Whether a ring meets itself anywhere but where one edge ends and the next begins.

    Edges are compared two by two inside the row, boxes first, so the work follows the
    square of a ring's points and needs no shuffle.
    """

    def crossing(s: Column) -> Column:
        n = F.size(s)

        def against(e: Column, i: Column) -> Column:
            def pair(f: Column, j: Column) -> Column:
                following, last = j == i + 1, (i == 0) & (j == n - 1)
                return F.when(j <= i, False).when(following, _turns_back(e, f)).when(last, _turns_back(f, e)).otherwise(_meet(e, f))

            return F.exists(F.transform(s, pair), lambda x: x)

        return (n < 3) | F.exists(F.transform(s, against), lambda x: x)

    return let(_segments(ring), crossing)


def _parts_between(e: Column, others: Column) -> Column:
    """Middles of the parts into which the edges ``others`` cut an edge."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]

    def cuts(f: Column) -> Column:
        fx, fy = f["bx"] - f["ax"], f["by"] - f["ay"]
        across = dx * fy - dy * fx
        slant = F.abs(across) > 1e-12 * F.hypot(dx, dy) * F.hypot(fx, fy)
        at = ((f["ax"] - e["ax"]) * fy - (f["ay"] - e["ay"]) * fx) / F.when(slant, across)
        along = lambda x, y: ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / (dx * dx + dy * dy)
        return F.when(~_meet(e, f), F.array().cast("array<double>")).when(slant, F.array(at)).otherwise(F.array(along(f["ax"], f["ay"]), along(f["bx"], f["by"])))

    inner = F.filter(F.flatten(F.transform(others, cuts)), lambda t: (t > 0) & (t < 1))
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    middles = F.zip_with(F.slice(stops, F.lit(1), F.size(stops) - 1), F.slice(stops, F.lit(2), F.size(stops) - 1), lambda a, b: (a + b) / 2)
    return F.transform(middles, lambda t: F.array(e["ax"] + t * dx, e["ay"] + t * dy))


def _pieces(ring: Column, other: Column) -> Column:
    """Middles of all parts of a ring's boundary between its meetings with another ring."""
    return let(_segments(other), lambda o: F.flatten(F.transform(_segments(ring), lambda e: _parts_between(e, o))))


def _ring_inside(ring: Column, other: Column, side: int) -> Column:
    """Whether a part of the ring's boundary lies on that side of another ring (0 outside, 1 inside)."""
    return F.exists(_pieces(ring, other), lambda p: ring_location(p[0], p[1], other) == side)


def topology(polygons: Column) -> Column:
    """States of polygons with holes whose rings are sound: an empty array where all is right.

    ``self_crossing``: a ring meets itself. ``hole_outside``: a part of a hole lies outside
    its outer ring. ``hole_overlap``: two holes of a polygon share area. ``overlap``: two
    polygons share area; shared edges and points are no fault. Null where a ring is broken
    (``ring_ok``) or there is no polygon.
    """
    sound = (F.size(polygons) > 0) & F.forall(polygons, lambda rings: (F.size(rings) > 0) & F.forall(rings, ring_ok))

    def any_two(items: Column, test: Callable[[Column, Column], Column]) -> Column:
        """Whether any item passes the test against another, in either order.

        Both orders are visited, not written side by side: Spark takes higher-order
        functions that differ only in the order of outer lambda variables for the same.
        """
        return F.exists(F.transform(items, lambda a, i: F.exists(F.transform(items, lambda b, j: F.when(j != i, test(a, b)).otherwise(False)), lambda x: x)), lambda x: x)

    def same_area(a: Column, b: Column) -> Column:
        """Whether the inner point of a ring lies inside another."""
        return let(_scanline(F.array(a)), lambda p: F.coalesce(ring_location(p["x"], p["y"], b) == 1, F.lit(False)))

    def share(a: Column, b: Column) -> Column:
        return _ring_inside(a, b, 1) | same_area(a, b)

    holes = lambda rings: F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))

    def inside(x: Column, y: Column, rings: Column) -> Column:
        """Strictly inside a polygon: in its outer ring, in no hole and on no edge."""
        return (ring_location(x, y, rings[0]) == 1) & F.forall(holes(rings), lambda h: ring_location(x, y, h) == 0)

    def enters(a: Column, b: Column) -> Column:
        """Whether a part of a's outer boundary, cut by all rings of b, or a's inner point lies inside b."""
        edges = F.flatten(F.transform(b, _segments))
        cut = let(edges, lambda o: F.exists(F.flatten(F.transform(_segments(a[0]), lambda e: _parts_between(e, o))), lambda p: inside(p[0], p[1], b)))
        return cut | let(_scanline(a), lambda p: F.coalesce(inside(p["x"], p["y"], b), F.lit(False)))

    states = {
        "self_crossing": F.exists(polygons, lambda rings: F.exists(rings, ring_crosses)),
        "hole_outside": F.exists(polygons, lambda rings: F.exists(holes(rings), lambda h: _ring_inside(h, rings[0], 0))),
        "hole_overlap": F.exists(polygons, lambda rings: any_two(holes(rings), share)),
        "overlap": any_two(polygons, enters),
    }
    return F.when(sound, F.array_compact(F.array(*[F.when(wrong, name) for name, wrong in states.items()])))


def geojson_polygons(doc: Column) -> Column:
    """Polygon or MultiPolygon document -> polygon array with the first two coordinates."""
    kind = F.get_json_object(doc, "$.type")
    coords = F.get_json_object(doc, "$.coordinates")
    single = F.array(F.from_json(coords, "array<array<array<double>>>"))
    multi = F.from_json(coords, POLYGONS)
    raw = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi)
    return F.transform(
        raw, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.slice(p, 1, 2)))
    )


# ---------------------------------------------------------------------- joins


#: Cells an area may span in each direction; a larger area goes to a coarser grid.
SPAN = 16


def _cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor((lo - EDGE_TOL) / size), F.floor((hi + EDGE_TOL) / size))


def _gridded(areas: DataFrame, area: str, polygons: str, cell: float) -> DataFrame:
    """(area, box, level): the level whose cells are 2**level times ``cell`` so that the box spans few."""
    boxes = areas.select(area, bbox(F.col(polygons)).alias("_b")).filter("_b.xmin IS NOT NULL")
    longest = F.greatest(F.col("_b.xmax") - F.col("_b.xmin"), F.col("_b.ymax") - F.col("_b.ymin"))
    return boxes.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(1e-9)) / (cell * SPAN)))).cast("int"))


def _candidates(points: DataFrame, areas: DataFrame, x: str, y: str, area: str, polygons: str, cell: float) -> DataFrame:
    """Every point at least once, with each area whose box holds it and that area's polygons, else null.

    Only ids and boxes are spread over cells, a bounded number for each area; a point
    falls in one cell of each level in use. Polygons are attached to what is left.
    """
    grid = _gridded(areas, area, polygons, cell)
    levels = sorted(r[0] for r in grid.select("_level").distinct().collect())  # at most one for each power of two of a double
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    spread = (
        grid.withColumn("_cx", F.explode(_cells(F.col("_b.xmin"), F.col("_b.xmax"), size)))
        .withColumn("_cy", F.explode(_cells(F.col("_b.ymin"), F.col("_b.ymax"), size)))
        .withColumnRenamed(area, "_id")
    )
    at = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels or [0]])))
    at = at.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
    inside = F.col(x).between(F.col("_b.xmin"), F.col("_b.xmax")) & F.col(y).between(F.col("_b.ymin"), F.col("_b.ymax"))
    keys = [at[c] == spread[c] for c in ("_level", "_cx", "_cy")]
    near = at.join(spread, keys[0] & keys[1] & keys[2] & inside, "left").select(*points.columns, "_id")
    shapes = areas.select(F.col(area).alias("_id"), F.col(polygons).alias("_shape"))
    return near.join(shapes, "_id", "left")


def point_hits(
    points: DataFrame, areas: DataFrame, key: str, x: str, y: str, area: str, polygons: str, cell: float
) -> DataFrame:
    """(key, area) of every covered pair; the join is an equality on grid cells with exact tests afterwards."""
    near = _candidates(points.select(key, x, y), areas, x, y, area, polygons, cell)
    return near.filter(F.col("_id").isNotNull() & covers(F.col(x), F.col(y), F.col("_shape"))).select(key, F.col("_id").alias(area))


def assign_points(
    points: DataFrame, areas: DataFrame, key: str, x: str, y: str, area: str, polygons: str, cell: float
) -> DataFrame:
    """Exactly one covering area -> matched; several -> ambiguous; none -> outside. ``key`` is unique."""
    near = _candidates(points, areas, x, y, area, polygons, cell)
    held = F.when(F.col("_shape").isNotNull() & covers(F.col(x), F.col(y), F.col("_shape")), F.col("_id"))
    others = [F.first(c).alias(c) for c in points.columns if c != key]
    out = near.withColumn("_held", held).groupBy(key).agg(*others, F.count_distinct("_held").alias("hits"), F.max("_held").alias("_area"))
    return out.select(
        *points.columns,
        "hits",
        F.when(F.col("hits") == 1, F.col("_area")).alias(area),
        F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous").otherwise("outside").alias(
            "match_status"
        ),
    )


def _scanline(rings: Column) -> Column:
    """struct(x, y): middle of the widest inner interval on the line through the tallest gap between heights.

    Lines through lower gaps are tried where a line has no interval; null if none has.
    """
    heights = F.array_sort(F.array_distinct(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[1])))))

    def gaps(h: Column) -> Column:
        steps = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda a, b: F.struct((a - b).alias("less"), ((a + b) / 2).alias("y")))
        return F.array_sort(steps)

    def crossings(ring: Column, y: Column) -> Column:
        edges = F.zip_with(
            F.slice(ring, F.lit(1), F.size(ring) - 1),
            F.slice(ring, F.lit(2), F.size(ring) - 1),
            lambda a, b: F.when((a[1] <= y) != (b[1] <= y), a[0] + (y - a[1]) * (b[0] - a[0]) / F.nullif(b[1] - a[1], F.lit(0.0))),
        )
        return F.filter(edges, lambda v: v.isNotNull())

    def widest(line: Column, y: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(line) / 2).cast("int")), lambda i: F.struct((line[2 * i - 1] - line[2 * i - 2]).alias("w"), (-i).alias("i"), ((line[2 * i - 1] + line[2 * i - 2]) / 2).alias("x")))
        best = F.array_max(pairs)
        return F.when((F.size(line) >= 2) & (F.size(line) % 2 == 0), let(best, lambda b: F.when(b["w"] > 0, F.struct(b["x"].alias("x"), y.alias("y")))))

    lines = let(heights, lambda h: F.transform(gaps(h), lambda g: let(F.array_sort(F.flatten(F.transform(rings, lambda r: crossings(r, g["y"])))), lambda line: widest(line, g["y"]))))
    return F.try_element_at(F.filter(lines, lambda p: p.isNotNull()), F.lit(1))


def representative_points(df: DataFrame, keys: list[str], rings: str, out_x: str = "px", out_y: str = "py") -> DataFrame:
    """Interior point of each polygon row (``rings``: outer ring first), with ``point_status``.

    The centroid where it lies strictly inside, else a point of a scanline. A polygon
    with a broken ring, or without area, keeps its row with a null point and ``broken``.
    """

    def place(m: Column) -> Column:
        sides = F.transform(rings, lambda r: ring_location(m["cx"], m["cy"], r))
        # strictly inside: in the outer ring, on no edge, in no hole
        inner = let(sides, lambda s: (s[0] == 1) & (F.aggregate(s, F.lit(0), lambda a, v: a + v) == 1))
        return F.when(inner, F.struct(m["cx"].alias("x"), m["cy"].alias("y"), F.lit("centroid").alias("s"))).otherwise(
            let(_scanline(F.col(rings)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(p.isNotNull(), "scanline").otherwise("none").alias("s")))
        )

    placed = let(polygon_measure(F.array(F.col(rings))), lambda m: F.when(m.isNotNull(), place(m)))
    found = df.select(*keys, placed.alias("_p"))
    return found.select(*keys, F.col("_p.x").alias(out_x), F.col("_p.y").alias(out_y), F.coalesce("_p.s", F.lit("broken")).alias("point_status"))


def assign_footprints(
    records: DataFrame, areas: DataFrame, key: str, polygons: str, area: str, area_polygons: str, cell: float
) -> DataFrame:
    """A record matches only if the points of all its components fall in the same area."""
    parts = records.select(key, F.posexplode(polygons).alias("_i", "_rings"))
    pts = representative_points(parts, [key, "_i"], "_rings").withColumn(
        "_part", F.concat_ws("/", F.col(key).cast("string"), F.col("_i").cast("string"))
    )
    # components whose ring is broken have no point and count as missing geometry
    located = assign_points(pts.filter("px is not null"), areas, "_part", "px", "py", area, area_polygons, cell)
    per_record = located.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("match_status") == "ambiguous").alias("_amb"),
        F.count_if(F.col("match_status") != "matched").alias("_un"),
        F.count_distinct(area).alias("_areas"),
        F.max(area).alias("_area"),
    )
    sized = records.select(key, F.size(polygons).alias("_parts"))
    joined = sized.join(per_record, key, "left")
    status = (
        F.when((F.coalesce("_parts", F.lit(0)) <= 0) | F.col("_n").isNull() | (F.col("_n") < F.col("_parts")), "missing_geometry")
        .when(F.col("_amb") > 0, "ambiguous")
        .when(F.col("_areas") > 1, "crosses_areas")
        .when((F.col("_un") > 0) & (F.col("_areas") > 0), "partly_outside")
        .when(F.col("_un") > 0, "outside")
        .otherwise("matched")
    )
    return joined.withColumn("match_status", status).select(
        key, F.when(F.col("match_status") == "matched", F.col("_area")).alias(area), "match_status"
    )
