"""Scans, reshapes, sinks and pins; text formats are built from the tables in the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelbook.functions.keys import zfill
from parcelbook.functions.numbers import mixed_separator_number
from parcelbook.plans import base as B
from parcelbook.plans.registry import query
from parcelbook.session import scratch_path, settle, spread
from parcelbook.sources import manifest as MF
from parcelbook.sources import melt as ML
from parcelbook.sources import nested as NS
from parcelbook.sources import tables as TB
from parcelbook.sources import tagged as TG
from parcelbook.sources import text as TX
from parcelbook.sources.tables import load

Spark = SparkSession


@query("s01_parquet_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR AS day FROM lineitem")
def s01(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


@query("s02_delimited_text", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def s02(spark: Spark, d: str) -> DataFrame:
    # a written text table read back with no inference; every column stays text
    names = ["id", "name", "brand", "size"]
    path = scratch_path(spark, "delimited")
    part = load(spark, d, "part").select(*[F.col(c).cast("string").alias(n) for c, n in zip(["p_partkey", "p_name", "p_brand", "p_size"], names, strict=True)])
    part.write.option("sep", ";").option("header", True).csv(path)
    return TX.read_delimited(spark, path, names, ";")


@query("s03_legacy_encoding", "SELECT CAST(doc_id AS VARCHAR) AS id, lang, CAST(n_chars AS VARCHAR) AS chars FROM documents WHERE doc_id % 5 > 1")
def s03(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "legacy")
    chars = F.when(F.col("doc_id") % 5 == 0, "-").when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("n_chars").cast("string"))
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Año "), "lang").alias("lang"), chars.alias("chars"))
    docs.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").option("emptyValue", "").csv(path)
    read = TX.read_delimited(spark, path, ["id", "lang", "chars"], ";", encoding="windows-1252")
    return TX.published_cells(read.na.fill(""), "chars").select("id", F.replace("lang", F.lit("Año "), F.lit("")).alias("lang"), "chars")


@query(
    "s04_json_series",
    f"WITH {B.NY} SELECT unit AS territory, yr, CAST(28 AS INT) AS period, CAST(n_orders AS DOUBLE) AS value FROM ny",
)
def s04(spark: Spark, d: str) -> DataFrame:
    # one payload per unit (its history is bounded by the calendar), two series each
    ny = B.nation_year(spark, d)
    point = F.struct(F.col("yr").alias("Anyo"), F.lit(28).alias("FK_Periodo"), F.col("n_orders").cast("double").alias("Valor"))
    data = ny.groupBy("unit").agg(F.collect_list(point).alias("Data"))

    def series(tail: str, code: str):
        return F.struct(F.concat("unit", F.lit(tail)).alias("Nombre"), F.concat(F.lit(code), "unit").alias("COD"), F.col("Data"))

    payload = data.select(F.to_json(F.array(series(". Total. Orders.", "T"), series(". Index. Orders.", "I"))).alias("payload"))
    return NS.series_rows(payload, "payload", ["Total", "Orders"], []).drop("series_code")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
CUBES_SQL = """e AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT)) AS k FROM events GROUP BY 1, 2), l(t, i) AS (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)),
  g AS (SELECT d.day, l.t, m, n, k FROM (SELECT DISTINCT day FROM e) d CROSS JOIN l CROSS JOIN (VALUES (0), (1)) x(m) LEFT JOIN e ON e.day = d.day AND e.event_type = l.t)"""


def _event_cubes(spark: Spark, d: str) -> DataFrame:
    """A cube of event type by measure for each day: sparse or dense, in both orders of dimensions.

    A count divisible by three is left out and flagged; every eighth day has a text for a number.
    """
    k = F.from_json("props", "k long")["k"]
    e = load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
    by = e.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "k")))).alias("m"))

    def cell(t: str, measure: int):
        x = F.try_element_at("m", F.lit(t))
        return F.when(x["n"] % 3 != 0, x["n"]) if measure == 0 else x["k"]

    def flag(t: str, measure: int):
        return F.when(F.try_element_at("m", F.lit(t))["n"] % 3 == 0, "c") if measure == 0 else F.lit(None).cast("string")

    turned, listed, odd = F.dayofmonth("day") % 4 >= 2, F.dayofmonth("day") % 2 == 1, F.dayofmonth("day") % 8 == 5
    plain = [(t, m) for t in EVENT_TYPES for m in (0, 1)]
    other = [(t, m) for m in (0, 1) for t in EVENT_TYPES]

    def container(make):
        cells = F.when(turned, F.array(*[make(t, m).cast("string") for t, m in other])).otherwise(F.array(*[make(t, m).cast("string") for t, m in plain]))
        quoted = F.transform(cells, lambda c: F.when(c.rlike("^-?[0-9]"), c).otherwise(F.concat(F.lit('"'), c, F.lit('"'))))
        as_list = F.concat(F.lit("["), F.array_join(quoted, ",", "null"), F.lit("]"))
        pairs = F.array_compact(F.transform(quoted, lambda c, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), c)))
        return F.when(listed, as_list).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))

    value = F.when(odd, F.regexp_replace(container(cell), r"([0-9]+)(\]|\})$", '"many"$2')).otherwise(container(cell))
    types = ",".join(f'"{t}":{i}' for i, t in enumerate(EVENT_TYPES))
    labels = ",".join(f'"{t}":"{t.title()}"' for t in EVENT_TYPES)
    dimension = f'"dimension":{{"type":{{"category":{{"index":{{{types}}},"label":{{{labels}}}}}}},"measure":{{"category":{{"index":["n","k"]}}}}}}'
    shape = F.when(turned, '"id":["measure","type"],"size":[2,5]').otherwise('"id":["type","measure"],"size":[5,2]')
    payload = F.concat(F.lit("{"), shape, F.lit(f',{dimension},"value":'), value, F.lit(',"status":'), container(flag), F.lit("}"))
    return by.select(F.col("day").cast("string").alias("day"), payload.alias("payload"))


@query(
    "s05_dimensional_cube",
    f"""WITH {CUBES_SQL} SELECT CAST(day AS VARCHAR) AS day, t AS type, upper(t[1]) || t[2:] AS type_label, CASE m WHEN 0 THEN 'n' ELSE 'k' END AS measure, CASE WHEN m = 1 AND NOT (t = 'view' AND day(day) % 8 = 5) THEN CAST(k AS DOUBLE) WHEN m = 0 AND n % 3 <> 0 THEN CAST(n AS DOUBLE) END AS value, CASE WHEN m = 0 AND n % 3 = 0 THEN 'c' END AS status FROM g""",
)
def s05(spark: Spark, d: str) -> DataFrame:
    return NS.cube_cells(_event_cubes(spark, d), "payload", ["day"], ["type", "measure"]).select("day", "type", "type_label", "measure", "value", "status")


@query(
    "s05_cube_violations",
    f"WITH {CUBES_SQL} SELECT DISTINCT CAST(day AS VARCHAR) AS day, 'not_a_number' AS violation FROM g WHERE day(day) % 8 = 5 UNION ALL SELECT DISTINCT CAST(day AS VARCHAR), 'out_of_bounds' FROM g WHERE m = 1 AND k > 2000 AND NOT (t = 'view' AND day(day) % 8 = 5)",
)
def s05b(spark: Spark, d: str) -> DataFrame:
    return NS.cube_violations(_event_cubes(spark, d), "payload", ["day"], ["measure", "type"], low=0, high=2000)


@query(
    "s06_wide_year_features",
    """SELECT c_custkey, 2000 + y AS yr, CASE WHEN v > 0 THEN round(v, 6) END AS value FROM (SELECT c_custkey, unnest([15, 16, 17]) AS y, unnest([c_acctbal, c_acctbal - 1000, c_acctbal * 2]) AS v FROM customer)""",
)
def s06(spark: Spark, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    wide = load(spark, d, "customer").select("c_custkey", b.alias("INC_15"), (b - 1000).alias("INC_16"), (b * 2).alias("INC_17"))
    return NS.wide_years(wide, ["c_custkey"], "INC_", [2015, 2016, 2017])


YEARS = list(range(1995, 2002))


@query(
    "s07_melt_measures",
    """WITH m AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS yr, sum(l_quantity) AS qty, round(sum(l_tax), 2) AS tax FROM lineitem GROUP BY 1, 2)
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS code, 'qty' AS measure, 100 + yr AS yr, round(qty, 6) AS value FROM m UNION ALL SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0'), 'tax', 100 + yr, tax FROM m""",
)
def s07(spark: Spark, d: str) -> DataFrame:
    # wide sheet first (measure_YY columns), then the melt of its populated cells
    li = load(spark, d, "lineitem")
    y = F.year("l_shipdate")
    wide = li.groupBy(zfill(F.col("l_suppkey"), 5).alias("code")).agg(
        *[F.sum(F.when(y == t, F.col("l_quantity"))).alias(f"qty_{t % 100:02d}") for t in YEARS],
        *[F.round(F.sum(F.when(y == t, F.col("l_tax"))), 2).alias(f"tax_{t % 100:02d}") for t in YEARS],
    )
    long = ML.melt_measure_year(wide, ["code"], [c for c in wide.columns if c != "code"])
    # two-digit years of the last century read as 20xx; both sides shift by 100
    return long.withColumn("yr", F.when(F.col("yr") < 2050, F.col("yr") + 100).otherwise(F.col("yr")))


@query(
    "s08_section_carry",
    """WITH r AS (SELECT p_brand AS sheet, p_partkey AS row_no, CASE WHEN p_size <= 10 THEN p_type END AS head, p_retailprice AS v FROM part)
    SELECT sheet, row_no, last_value(head IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section, v FROM r""",
)
def s08(spark: Spark, d: str) -> DataFrame:
    rows = load(spark, d, "part").select(
        F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"), F.when(F.col("p_size") <= 10, F.col("p_type")).alias("head"), F.col("p_retailprice").alias("v")
    )
    return ML.carry_section(rows, ["sheet"], "row_no", "head", "section").drop("head")


@query(
    "s09_measures_on_grid",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN coalesce(a.k, b.k) % 10 = 0 AND a.k IS NOT NULL AND b.k IS NOT NULL THEN 'A' WHEN coalesce(a.k, b.k) % 10 = 0 AND a.k IS NULL THEN 'B' ELSE 'A' END AS label,
    coalesce(a.k, b.k) % 10 = 0 AND a.k IS NOT NULL AND b.k IS NOT NULL AS label_conflict, CAST(a.v AS DOUBLE) AS final, CAST(b.v AS DOUBLE) AS low FROM a FULL JOIN b ON a.k = b.k""",
)
def s09(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    k = F.col("o_custkey").alias("k")
    final = o.filter(F.col("o_orderstatus") == "F").groupBy(k).agg(F.count("*").alias("v")).withColumn("label", F.lit("A"))
    low = o.filter(F.col("o_orderpriority") == "5-LOW").groupBy(k).agg(F.count("*").alias("v")).withColumn("label", F.when(F.col("k") % 10 == 0, "B").otherwise("A"))
    return ML.on_key_grid({"final": final, "low": low}, ["k"], "label", "v")


def _register_lines(part: DataFrame) -> DataFrame:
    """(part, value): the lines of eight collections of building records, each with the number of its records.

    Nested, namespaced records with holes, several patches, nil geometry and broken rules;
    every 19th has a tag that is not closed, and one file in eight declares a record too many.
    """
    size, ref = F.col("p_size"), zfill(F.col("p_partkey"), 14)
    stamp = F.concat((1950 + size).cast("string"), F.lit("-01-01T00:00:00"))

    def tag(name: str, *inner, attributes=""):
        return F.concat(F.lit(f"<{name}{attributes}>"), *[F.lit(i) if isinstance(i, str) else i for i in inner], F.lit(f"</{name}>"))

    def ring(points: str, name: str):
        return tag(f"gml:{name}", tag("gml:LinearRing", tag("gml:posList", points, attributes=' srsDimension="2"')))

    outer = F.when(size % 5 == 1, ring("0 0 10 0 10 10 0 10", "exterior")).otherwise(ring("0 0 10 0 10 10 0 10 0 0", "exterior"))
    far = F.when(size % 5 == 1, ring("20 0 30 0 30 10", "exterior")).otherwise(ring("20 0 30 0 30 10 20 10 20 0", "exterior"))
    hole = F.when(size % 2 == 0, ring("4 4 6 4 6 6 4 6 4 4", "interior")).otherwise("")
    far_hole = F.when(size % 2 == 0, ring("24 4 26 4 26 6 24 6 24 4", "interior")).otherwise("")
    second = F.when(size % 9 == 0, tag("gml:PolygonPatch", far, far_hole)).otherwise("")
    surface = tag("gml:Surface", tag("gml:patches", tag("gml:PolygonPatch", outer, hole), second), attributes=f' srsName="{TG.CRS}"')
    drawn = tag("bu:geometry", tag("bu:BuildingGeometry", tag("bu:geometry", surface), tag("bu:horizontalGeometryReference", "footPrint")))
    record = F.concat(
        F.lit('<gml:featureMember xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:bu="urn:bu" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><bu:Building gml:id="'),
        F.lit(TG.ID_PREFIX), F.when(size % 17 == 0, "other").otherwise(ref), F.lit('">'),
        tag("bu:inspireId", tag("base:Identifier", tag("base:localId", ref), attributes=' xmlns:base="urn:base"')),
        tag("bu:dateOfConstruction", tag("bu:DateOfEvent", tag("bu:beginning", F.when(size % 4 != 0, stamp).otherwise("--01-01T00:00:00")), tag("bu:end", stamp))),
        F.concat(F.lit("<bu:currentUse>"), F.col("p_type"), F.when(F.col("p_partkey") % 19 == 0, "").otherwise("</bu:currentUse>")),
        F.when(size % 3 != 0, tag("bu:conditionOfConstruction", "functional")).otherwise('<bu:conditionOfConstruction xsi:nil="true"/>'),
        tag("bu:numberOfDwellings", F.when(size % 11 == 0, "-3").otherwise(size.cast("string"))),
        tag("bu:officialArea", tag("bu:OfficialArea", tag("bu:officialAreaReference", F.when(size % 13 == 0, "netFloorArea").otherwise("grossFloorArea")), tag("bu:value", F.col("p_retailprice").cast("string"), attributes=' uom="m2"'))),
        F.when(size % 7 == 0, '<bu:geometry xsi:nil="true"/>').otherwise(drawn),
        F.lit("</bu:Building></gml:featureMember>"),
    )
    # only the few columns are dealt and sorted; texts, twenty times as wide, are built where they are written
    parts = part.select((F.col("p_partkey") % 8).alias("part"), "p_partkey", "p_size", "p_type", "p_retailprice")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    ends = counts.select("part", F.explode(F.array(F.lit(0), F.lit(2))).alias("place"), "n")
    lines = parts.withColumn("place", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    declared = (F.col("n") + F.when(F.col("part") == 3, 1).otherwise(0)).cast("string")
    opening = F.concat(F.lit('<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" numberReturned="'), declared, F.lit('">'))
    value = F.when(F.col("place") == 0, opening).when(F.col("place") == 2, "</gml:FeatureCollection>").otherwise(record)
    # each number has a task of its own, so a collection is whole however Spark deals the lines
    return lines.repartitionById(8, F.col("part").cast("int")).sortWithinPartitions("part", "place").select("part", value.alias("value"))


def _register_files(spark: Spark, d: str) -> str:
    """Folder of XML files of building records, a folder and file for each collection."""
    path = scratch_path(spark, "register")
    _register_lines(load(spark, d, "part")).write.partitionBy("part").text(path)
    return path


@query(
    "s10_tagged_records",
    """SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS refcat, p_type AS current_use, CASE WHEN p_size % 3 <> 0 THEN 'functional' END AS condition, CASE WHEN p_size % 4 <> 0 THEN 1950 + p_size END AS year_start,
    1950 + p_size AS year_end, CASE WHEN p_size % 4 <> 0 THEN 'complete' ELSE 'partial' END AS date_quality, CASE WHEN p_size % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS dwelling_properties, CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS gross_floor_m2,
    CASE WHEN p_size % 7 > 0 AND p_size % 5 <> 1 THEN (CASE WHEN p_size % 2 = 0 THEN 96.0 ELSE 100.0 END) * CASE WHEN p_size % 9 = 0 THEN 2 ELSE 1 END END::DOUBLE AS footprint_m2,
    CASE WHEN p_size % 7 > 0 AND p_size % 5 <> 1 THEN 5.0 + CASE WHEN p_size % 9 = 0 THEN 10 ELSE 0 END END::DOUBLE AS centroid_x, CASE WHEN p_size % 7 > 0 AND p_size % 5 <> 1 THEN 5.0 END::DOUBLE AS centroid_y,
    concat_ws(',', CASE WHEN p_size % 17 = 0 THEN 'identifier' END, CASE WHEN p_size % 11 = 0 THEN 'dwellings' END, CASE WHEN p_size % 13 = 0 THEN 'area_definition' END, CASE WHEN p_size % 7 > 0 AND p_size % 5 = 1 THEN 'broken_ring' END) AS violations FROM part WHERE p_partkey % 19 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'corrupt_record' FROM part WHERE p_partkey % 19 = 0""",
)
def s10(spark: Spark, d: str) -> DataFrame:
    """Building records read from files by row tag; a broken record is a row that says so."""
    records = TG.read_records(spark, _register_files(spark, d))
    out = TG.building_columns(records, [TG.CORRUPT])
    broken = F.col(TG.CORRUPT).isNotNull()
    key = F.when(broken, F.regexp_extract(TG.CORRUPT, "localId>0*([0-9]+)<", 1)).otherwise(F.col("refcat")).cast("int")
    shown = ["refcat", "current_use", "condition", "year_start", "year_end", "date_quality", "dwelling_properties", "gross_floor_m2", "footprint_m2", "centroid_x", "centroid_y"]
    found = F.when(broken, "corrupt_record").otherwise(F.array_join("violations", ","))
    return out.select(key.cast(load(spark, d, "part").schema["p_partkey"].dataType).alias("p_partkey"), *[F.when(~broken, F.col(c)).alias(c) for c in shown], found.alias("violations"))


@query(
    "s10_record_counts",
    """WITH f AS (SELECT p_partkey % 8 AS f, count(*) AS n, count(*) FILTER (WHERE p_partkey % 19 = 0) AS corrupt FROM part GROUP BY 1)
    SELECT n + CASE WHEN f = 3 THEN 1 ELSE 0 END AS declared, n AS read, corrupt, CASE WHEN f = 3 THEN 'count_differs' WHEN corrupt > 0 THEN 'corrupt_records' ELSE 'ok' END AS verdict FROM f""",
)
def s10b(spark: Spark, d: str) -> DataFrame:
    """Records of every file against the number that the file declares."""
    path = _register_files(spark, d)
    return TG.record_counts(TG.read_records(spark, path), TG.declared_counts(spark, path)).select("declared", "read", "corrupt", "verdict")


@query(
    "s11_html_tables",
    """SELECT p_partkey, 1 AS row_no, 'nivel2' AS depth, p_name AS label, 2 AS n_cells, round(p_retailprice, 2) AS price, CASE WHEN p_size % 4 = 0 THEN 'header_order' END AS violation FROM part""",
)
def s11(spark: Spark, d: str) -> DataFrame:
    # the driver's pages hold no tables, so a page per part is written around its values
    html = F.concat(
        # a third of the pages leave out end tags, a quarter has its header in another order
        F.when(F.col("p_size") % 4 == 0, "<html><body><table><tr><th>brand</th><th>name</th><th>price</th></tr>").otherwise("<html><body><table><tr><th>name<th>brand<th>price"),
        F.lit("<tr><td class='nivel2'> "),
        F.col("p_name"),
        F.when(F.col("p_size") % 3 == 0, "<td>").otherwise(" </td><td>"),
        F.col("p_brand"),
        F.when(F.col("p_size") % 3 == 0, "<td>").otherwise("</td><td>"),
        F.format_number("p_retailprice", 2),
        F.when(F.col("p_size") % 3 == 0, "</table>").otherwise("</td></tr></table></body></html>"),
    )
    pages = spread(load(spark, d, "part")).select("p_partkey", html.alias("html"))
    rows = settle(TG.html_table_rows(pages, "p_partkey", "html"))
    found = TG.table_violations(rows, "p_partkey", ["name", "brand", "price"], ["nivel2"]).select("p_partkey", "violation")
    return rows.filter("NOT header").join(found, "p_partkey", "left").select(
        "p_partkey", "row_no", "depth", "label", F.size("cells").alias("n_cells"), mixed_separator_number(F.col("cells")[1]).alias("price"), "violation"
    )


@query("s11_pages_scan", "SELECT page_id, 0 AS table_rows FROM pages")
def s11b(spark: Spark, d: str) -> DataFrame:
    pages = load(spark, d, "pages")
    rows = TG.html_table_rows(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").cast("int").alias("n"))
    return pages.select("page_id").join(rows, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("table_rows"))


@query(
    "s12_census_margin",
    """SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS code, 'NATION_' || c_nationkey AS label, count(*) AS n FROM customer GROUP BY c_nationkey""",
)
def s12(spark: Spark, d: str) -> DataFrame:
    # every cut of the cube (segment, own or Total) as one text line, then the margin is kept
    c = load(spark, d, "customer").withColumn("seg", F.explode(F.array(F.lit("Total"), "c_mktsegment")))
    cells = c.groupBy("c_nationkey", "seg").agg(F.count("*").alias("n"))
    label = F.concat(zfill(F.col("c_nationkey"), 5), F.lit(" NATION_"), F.col("c_nationkey").cast("string"))
    line = cells.select(F.concat_ws(";", label, F.lit(""), "seg", F.col("n").cast("string")).alias("line"))
    rows = line.select(TX.parse_line(F.col("line"), ["municipality", "district", "segment", "total"]).alias("r")).select("r.*")
    kept = TX.keep_margin(rows, {"segment": "Total"}, ["district"])
    code, name = TX.code_and_label(F.col("municipality"))
    return kept.select(code.alias("code"), name.alias("label"), F.col("total").try_cast("long").alias("n"))


@query("s13_table_replace", f"WITH {B.NY} SELECT unit, region, yr, n_orders, customers, revenue FROM ny")
def s13(spark: Spark, d: str) -> DataFrame:
    panel = B.nation_year(spark, d).select("unit", "region", "yr", "n_orders", "customers", "revenue")
    path = scratch_path(spark, "replace")
    TB.publish_version(panel.filter("yr < 1998"), path, ["yr"])  # an older version that readers no longer see
    TB.publish_version(panel, path, ["yr"])
    return TB.read_version(spark, path).select(*panel.columns)


@query("s14_declared_publish", f"WITH {B.NY} SELECT unit, CAST(yr AS BIGINT) AS yr, CAST(n_orders AS DOUBLE) AS n_orders, yr < 2001 AS closed FROM ny")
def s14(spark: Spark, d: str) -> DataFrame:
    declared = T.StructType(
        [T.StructField("unit", T.StringType()), T.StructField("yr", T.LongType()), T.StructField("n_orders", T.DoubleType()), T.StructField("closed", T.BooleanType())]
    )
    panel = B.nation_year(spark, d).withColumn("closed", F.col("yr") < 2001)
    return TB.publish(panel, declared, scratch_path(spark, "publish"), versioned=True)


@query("s15_namespaces", "SELECT p_brand, count(*) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def s15(spark: Spark, d: str) -> DataFrame:
    sets = {"stock": {"buildings": f"{d}/part.parquet"}, "flows": {"lines": f"{d}/lineitem.parquet"}}
    with TB.attached(spark, sets, scratch_path(spark, "namespace")) as name:
        return spark.sql(
            f"""SELECT p_brand, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers
            FROM {name["flows"]}.lines JOIN {name["stock"]}.buildings ON l_partkey = p_partkey GROUP BY p_brand"""
        )


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(
    "s16_source_manifest",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}.parquet', '{'mismatched' if t == 'nation' else 'unpinned' if t == 'region' else 'ok'}')" for t in TABLES)
    + ", ('absent.parquet', 'missing')) AS t(file, status)",
)
def s16(spark: Spark, d: str) -> DataFrame:
    """Hashes of every file of the listing against pins with one absent, one altered and one extra file.

    The pins are taken by a second reading of the files' whole content: by Spark's reader, and by
    position over 16 MB. A table that is a folder of files is one entry of the listing, with the
    hash of all its files.
    """
    paths = f"{d}/*.parquet"
    pins = MF.by_source(MF.pins_of(spark, paths)).filter("file <> 'region.parquet'").select(
        "file", F.when(F.col("file") == "nation.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256")
    )
    extra = F.when(F.col("file") == "part.parquet", F.array("file", F.lit("absent.parquet"))).otherwise(F.array("file"))
    return MF.compare_to_pins(MF.by_source(MF.file_hashes(spark, paths)), pins.select(F.explode(extra).alias("file"), "sha256"))


@query(
    "s17_snapshot_age",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INT) END AS age_days, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN DATE '2002-01-01' - CAST(o_orderdate AS DATE) END > 365, FALSE) AS stale FROM orders""",
)
def s17(spark: Spark, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 8 == 0, F.lit("not a date")).when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    age = MF.snapshot_age(raw, F.lit("2002-01-01").cast("date"))
    return load(spark, d, "orders").select("o_orderkey", age.alias("age_days"), F.coalesce(age > 365, F.lit(False)).alias("stale"))
