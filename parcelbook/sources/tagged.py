"""XML building records and HTML tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelbook.functions import let
from parcelbook.functions.buckets import date_quality
from parcelbook.operators.geometry import polygon_measure, ring_ok

# declared shape of one building record, without namespaces; attributes start with "_"
_RING = "STRUCT<LinearRing: STRUCT<posList: STRUCT<_VALUE: STRING, _srsDimension: STRING, _count: STRING>>>"
_SURFACE = f"STRUCT<_srsName: STRING, patches: STRUCT<PolygonPatch: ARRAY<STRUCT<exterior: {_RING}, interior: ARRAY<{_RING}>>>>>"
BUILDING = (
    "Building STRUCT<_id: STRING, inspireId: STRUCT<Identifier: STRUCT<localId: STRING>>, "
    "dateOfConstruction: STRUCT<DateOfEvent: STRUCT<beginning: STRING, `end`: STRING>>, "
    "currentUse: STRING, conditionOfConstruction: STRING, numberOfDwellings: STRING, numberOfBuildingUnits: STRING, "
    "officialArea: STRUCT<OfficialArea: STRUCT<officialAreaReference: STRING, value: STRUCT<_VALUE: STRING, _uom: STRING>>>, "
    f"geometry: ARRAY<STRUCT<_nil: STRING, BuildingGeometry: STRUCT<geometry: STRUCT<_nil: STRING, Surface: ARRAY<{_SURFACE}>>, horizontalGeometryReference: STRING>>>>"
)
# fixed values: identifier prefix, area definition and unit, planar reference system
ID_PREFIX = "ES.SDGC.BU."
AREA_KIND, AREA_UNIT = "grossFloorArea", "m2"
CRS = "urn:ogc:def:crs:EPSG::25830"


CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str, row_tag: str = "gml:featureMember") -> DataFrame:
    """(Building, _corrupt_record, file): the records of XML files (UTF-8), one row each.

    Files are cut behind the end tag of a record by the text reader, which deals parts of
    one file to several tasks, and at every start tag, so a record without an end is one of
    its own. A record that cannot be parsed has null columns and its text in
    ``_corrupt_record``, and those behind it are read all the same (the ``xml`` source
    stops at the first of a file). ``row_tag`` is the tag as written, prefix included.
    """
    end = f"</{row_tag}>"
    # what stands behind the last end tag has no start tag and goes
    pieces = spark.read.option("lineSep", end).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    starts = F.split("value", rf"(?=<{re.escape(row_tag)}[\s>])")
    whole = F.transform(starts, lambda x, i: F.when(x.rlike(rf"^<{re.escape(row_tag)}[\s>]"), F.when(i == F.size(starts) - 1, F.concat(x, F.lit(end))).otherwise(x)))
    records = pieces.select("file", F.explode(F.array_compact(whole)).alias("text"))
    parsed = records.select("file", F.from_xml("text", f"{BUILDING}, {CORRUPT} STRING", {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return parsed.select("r.Building", F.col(f"r.{CORRUPT}").alias(CORRUPT), "file")


def declared_counts(spark: SparkSession, path: str, attribute: str = "numberReturned") -> DataFrame:
    """(file, declared): how many records each file says it has, from the attribute of its collection."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    said = F.regexp_extract("value", rf"\b{attribute}\s*=\s*[\"'](\d+)[\"']", 1)
    return lines.filter(F.contains("value", F.lit(attribute))).groupBy("file").agg(F.sum(F.nullif(said, F.lit("")).cast("long")).alias("declared"))


def record_counts(records: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, declared, read, corrupt, verdict): records of each file against the number it declares."""
    read = records.groupBy("file").agg(F.count("*").alias("read"), F.count(CORRUPT).alias("corrupt"))
    both = declared.join(read, "file", "full").select("file", "declared", F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("corrupt", F.lit(0)).alias("corrupt"))
    verdict = F.when(F.col("declared").isNull(), "undeclared").when(F.col("declared") != F.col("read"), "count_differs").when(F.col("corrupt") > 0, "corrupt_records").otherwise("ok")
    return both.withColumn("verdict", verdict)


def parse_record(xml: Column) -> Column:
    """The same record held as text in a column."""
    return F.from_xml(xml, BUILDING, {"ignoreNamespace": "true"})


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _count(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("long"))


def _numbers(pos: Column) -> Column:
    return F.transform(F.split(F.trim(pos["_VALUE"]), r"\s+"), lambda v: v.try_cast("double"))


def _ring(pos: Column) -> Column:
    """Points of a position list; an odd or unreadable list gives a ring that is not valid."""
    return let(_numbers(pos), lambda n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(n) / 2).cast("int") - 1), lambda i: F.array(F.get(n, 2 * i), F.get(n, 2 * i + 1))))


def _patch_rings(patch: Column) -> Column:
    """Position lists of a patch, the outer one first."""
    inner = F.coalesce(patch["interior"], F.array().cast(f"ARRAY<{_RING}>"))
    return F.transform(F.concat(F.array(patch["exterior"]), inner), lambda r: r["LinearRing"]["posList"])


def building_columns(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Typed record of each ``Building``: dates, counts, floor area, footprint and what is wrong with it.

    ``violations`` names every broken rule; a value that breaks one is null, so nothing
    is published in part. Geometry that is declared nil is missing, not wrong.
    """
    b = F.col("Building")
    area = b["officialArea"]["OfficialArea"]
    shapes = F.coalesce(b["geometry"], F.array().cast(df.schema["Building"].dataType["geometry"].dataType))
    nil = F.exists(shapes, lambda g: F.coalesce(g["_nil"] == "true", F.lit(False)) | F.coalesce(g["BuildingGeometry"]["geometry"]["_nil"] == "true", F.lit(False)))
    surfaces = F.flatten(F.filter(F.transform(shapes, lambda g: g["BuildingGeometry"]["geometry"]["Surface"]), lambda x: x.isNotNull()))
    raw = df.select(
        *(keys or []),
        b["inspireId"]["Identifier"]["localId"].alias("refcat"),
        b["_id"].alias("_gml"),
        _text(b["currentUse"]).alias("current_use"),
        _text(b["conditionOfConstruction"]).alias("condition"),
        date_quality(_text(b["dateOfConstruction"]["DateOfEvent"]["beginning"]), _text(b["dateOfConstruction"]["DateOfEvent"]["end"])).alias("_dq"),
        _text(b["numberOfDwellings"]).alias("_dwellings"),
        _text(b["numberOfBuildingUnits"]).alias("_units"),
        area["officialAreaReference"].alias("_kind"),
        area["value"]["_uom"].alias("_uom"),
        _text(area["value"]["_VALUE"]).alias("_floor"),
        nil.alias("_nil"),
        F.exists(shapes, lambda g: g["BuildingGeometry"]["geometry"]["Surface"].isNotNull() & (F.lower(F.coalesce(g["BuildingGeometry"]["horizontalGeometryReference"], F.lit(""))) != "footprint")).alias("_other"),
        F.exists(surfaces, lambda s: F.coalesce(s["_srsName"] != CRS, F.lit(True))).alias("_crs"),
        F.flatten(F.transform(surfaces, lambda s: F.transform(s["patches"]["PolygonPatch"], _patch_rings))).alias("_pos"),
    )
    rings = raw.withColumns(
        {
            "_polygons": F.transform("_pos", lambda p: F.transform(p, _ring)),
            "_all": F.flatten("_pos"),
            "_size": F.col("_floor").try_cast("double"),
        }
    )
    infinite = F.lit(float("inf"))
    wrong_area = F.col("_floor").isNotNull() & (F.coalesce(F.col("_kind") != AREA_KIND, F.lit(True)) | F.coalesce(F.col("_uom") != AREA_UNIT, F.lit(True)))
    bad_area = F.col("_floor").isNotNull() & ~F.coalesce((F.col("_size") >= 0) & (F.col("_size") < infinite), F.lit(False))
    sound = F.col("refcat").rlike("^[A-Z0-9]{14}$")
    geometry = {
        "partly_missing_geometry": F.col("_nil") & (F.size("_polygons") > 0),
        "not_a_footprint": F.col("_other"),
        "reference_system": F.col("_crs"),
        "dimension": F.exists("_all", lambda p: F.coalesce(p["_srsDimension"], F.lit("2")) != "2"),
        "declared_points": F.exists("_all", lambda p: F.coalesce(p["_count"].try_cast("int") * 2 != F.size(_numbers(p)), F.lit(False))),
        "broken_ring": F.exists("_polygons", lambda rings: F.exists(rings, lambda r: ~ring_ok(r))),
    }
    rules = {
        "reference": ~F.coalesce(sound, F.lit(False)),
        "identifier": ~F.coalesce(F.col("_gml") == F.concat(F.lit(ID_PREFIX), "refcat"), F.lit(False)),
        "reversed_dates": F.coalesce(F.col("_dq.reversed"), F.lit(False)),
        "dwellings": F.col("_dwellings").isNotNull() & _count(F.col("_dwellings")).isNull(),
        "units": F.col("_units").isNotNull() & _count(F.col("_units")).isNull(),
        "area_definition": wrong_area,
        "area_value": bad_area,
        **geometry,
    }
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    marked = rings.withColumn("violations", found)
    whole = (F.size("_polygons") > 0) & ~F.arrays_overlap("violations", F.array(*[F.lit(g) for g in geometry]))
    shaped = marked.withColumn("polygons", F.when(whole, F.col("_polygons")))
    measured = shaped.withColumn("_m", F.when(F.col("polygons").isNotNull(), polygon_measure(F.col("polygons"))))
    return measured.select(
        *(keys or []),
        "refcat",
        F.coalesce(sound, F.lit(False)).alias("ref_ok"),
        "current_use",
        "condition",
        "_dq.year_start",
        "_dq.year_end",
        "_dq.date_quality",
        "_dq.reversed",
        _count(F.col("_dwellings")).alias("dwelling_properties"),
        _count(F.col("_units")).alias("building_units"),
        F.when(~wrong_area & ~bad_area, F.col("_size")).alias("gross_floor_m2"),
        "polygons",
        F.col("_m.area").alias("footprint_m2"),
        F.col("_m.cx").alias("centroid_x"),
        F.col("_m.cy").alias("centroid_y"),
        "violations",
    )


class _Rows(HTMLParser):
    """Collects rows of cells with the class of the first cell; end tags may be left out.

    A new cell closes the open one, a new row closes the open row, and the end of a
    section, of the table or of the page closes both. A table inside a cell adds its own
    rows; the outer row goes on behind it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, list[str], bool]] = []
        self._outer: list[tuple] = []
        self._reset_row()

    def _reset_row(self) -> None:
        self._cells: list[str] | None = None
        self._depth, self._header = "", True
        self._text: list[str] | None = None

    def _end_cell(self) -> None:
        if self._text is not None and self._cells is not None:
            self._cells.append(" ".join("".join(self._text).split()))
        self._text = None

    def _end_row(self) -> None:
        self._end_cell()
        if self._cells:
            self.rows.append((self._depth, self._cells, self._header))
        self._reset_row()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._outer.append((self._cells, self._depth, self._header, self._text))
            self._reset_row()
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row()
            self._cells = [] if tag == "tr" else None
        elif tag in ("td", "th") and self._cells is not None:
            self._end_cell()
            self._text = []
            self._header &= tag == "th"
            if not self._cells:
                self._depth = dict(attrs).get("class") or ""

    def handle_data(self, data):
        if self._text is not None:
            self._text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row()
        elif tag == "table":
            self._end_row()
            if self._outer:
                self._cells, self._depth, self._header, self._text = self._outer.pop()

    def close(self):
        super().close()
        while self._outer:
            self.handle_endtag("table")
        self._end_row()


def html_table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row number, depth class, label, cells, header) of every table row of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[key], batch[html], strict=True):
                parser = _Rows()
                parser.feed(text or "")
                parser.close()
                for i, (depth, cells, header) in enumerate(parser.rows):
                    out.append((page, i, depth, cells[0], cells[1:], header))
            yield pd.DataFrame(out, columns=[key, "row_no", "depth", "label", "cells", "header"])

    return pages.select(key, html).mapInPandas(
        parse, f"{key} {kind}, row_no int, depth string, label string, cells array<string>, header boolean"
    )


def table_violations(rows: DataFrame, key: str, columns: list[str], levels: list[str]) -> DataFrame:
    """(key, row_no, violation) of parsed table rows; a sound table gives no row.

    ``columns`` are the header's cells in order, ``levels`` the depth classes from the
    outermost in. A page needs one header with these cells, each body row a value for
    every column but the label, a known level, and a level at most one below that of the
    row before; a label stands once under its level and outer label.
    """
    cells = F.concat(F.array("label"), F.col("cells"))
    rank = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("depth"))
    heads = rows.filter("header")
    wrong = heads.filter(cells != F.array(*[F.lit(c) for c in columns])).select(key, "row_no", F.lit("header_order").alias("violation"))
    counted = rows.groupBy(key).agg(F.count_if("header").alias("n")).filter("n <> 1")
    number = counted.select(key, F.lit(None).cast("int").alias("row_no"), F.lit("header_count").alias("violation"))
    page = Window.partitionBy(key).orderBy("row_no")  # the rows of one page
    body = rows.filter(~F.col("header")).withColumn("_rank", rank).withColumn("_before", F.lag("_rank").over(page))
    outer = body.withColumn("_outer", F.last(F.when(F.col("_rank") == 1, F.col("label")), ignorenulls=True).over(page))
    again = Window.partitionBy(key, "_outer", "_rank", "label").orderBy("row_no")
    marked = outer.withColumn("_again", F.row_number().over(again)).withColumn(
        "_found",
        F.array_compact(
            F.array(
                F.when(F.size("cells") != len(columns) - 1, "cell_count"),
                F.when(F.col("_rank") == 0, "unknown_level"),
                F.when((F.col("_rank") > 0) & (F.col("_rank") > F.coalesce("_before", F.lit(0)) + 1), "level_jump"),
                F.when(F.col("_again") > 1, "repeated_label"),
            )
        ),
    )
    return wrong.unionByName(number).unionByName(marked.select(key, "row_no", F.explode("_found").alias("violation")))
