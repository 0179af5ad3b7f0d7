"""Files written by hand: text, XML, HTML, pins, declared tables."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelbook.plans import sources as PS
from parcelbook.session import settle
from parcelbook.sources import manifest as MF
from parcelbook.sources import melt as ML
from parcelbook.sources import nested as NS
from parcelbook.sources import tables as TB
from parcelbook.sources import tagged as TG
from parcelbook.sources import text as TX


def test_delimited_with_mark_and_header_drift(spark, tmp_path, rows):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿code;name\n01;Málaga\n02;\n".encode())
    df = TX.read_delimited(spark, str(path), ["code", "name"])
    assert rows(df) == [("01", "Málaga"), ("02", None)]
    with pytest.raises(Exception, match="(?i)header"):
        TX.read_delimited(spark, str(path), ["code", "label"]).collect()
    for encoding in ("UTF-8", "windows-1252"):
        folder = tmp_path / encoding
        folder.mkdir()
        (folder / "1.csv").write_text("id;v\n1;2\n")
        (folder / "2.csv").write_text("v;id\n1;2\n")
        with pytest.raises(Exception, match="(?i)header"):
            TX.read_delimited(spark, str(folder), ["id", "v"], encoding=encoding).collect()


def test_windows_encoding(spark, tmp_path, rows):
    path = tmp_path / "w.csv"
    path.write_bytes("id;v\n1;10 € – año\n".encode("cp1252"))
    assert rows(TX.read_delimited(spark, str(path), ["id", "v"], encoding="windows-1252")) == [("1", "10 € – año")]


def test_margin(spark, rows):
    df = spark.createDataFrame([("01 A", "", "Total", "5"), ("01 A", "1", "Total", "2"), ("01 A", None, "x", "1"), ("02 B b", None, "Total", "-")], "m string, d string, s string, t string")
    kept = TX.published_cells(TX.keep_margin(df, {"s": "Total"}, ["d"]), "t")
    code, label = TX.code_and_label(F.col("m"))
    assert rows(kept.select(code, label, "t")) == [("01", "A", "5")]


def building(ref, inner, gml=None):
    return (
        f'<gml:featureMember><bu:Building gml:id="{gml or TG.ID_PREFIX + ref}"><bu:inspireId><base:Identifier xmlns:base="b"><base:localId>{ref}</base:localId></base:Identifier></bu:inspireId>{inner}</bu:Building></gml:featureMember>'
    )


def surface(positions, attributes="", crs=TG.CRS, use="footPrint"):
    ring = f"<gml:exterior><gml:LinearRing><gml:posList{attributes}>{positions}</gml:posList></gml:LinearRing></gml:exterior>"
    return f'<bu:geometry><bu:BuildingGeometry><bu:geometry><gml:Surface srsName="{crs}"><gml:patches><gml:PolygonPatch>{ring}</gml:PolygonPatch></gml:patches></gml:Surface></bu:geometry><bu:horizontalGeometryReference>{use}</bu:horizontalGeometryReference></bu:BuildingGeometry></bu:geometry>'


def test_building_xml(spark, tmp_path):
    square = "0 0 10 0 10 10 0 10 0 0"
    dates = "<bu:dateOfConstruction><bu:DateOfEvent><bu:beginning>1950-01-01T00:00:00</bu:beginning><bu:end>1940-01-01T00:00:00</bu:end></bu:DateOfEvent></bu:dateOfConstruction>"
    area = '<bu:officialArea><bu:OfficialArea><bu:officialAreaReference>grossFloorArea</bu:officialAreaReference><bu:value uom="{}">{}</bu:value></bu:OfficialArea></bu:officialArea>'
    nil = '<bu:geometry xsi:nil="true"/>'
    cases = {
        "A0000000000001": (dates + "<bu:numberOfDwellings>3</bu:numberOfDwellings>" + area.format("m2", "120.5") + surface(square, ' srsDimension="2" count="5"'), ["reversed_dates"]),
        "short": ("<bu:numberOfDwellings>x</bu:numberOfDwellings><bu:numberOfBuildingUnits>-1</bu:numberOfBuildingUnits>" + area.format("m2", "-1") + nil, ["reference", "dwellings", "units", "area_value"]),
        "A0000000000003": (area.format("ft2", "5") + surface(square) + nil, ["area_definition", "partly_missing_geometry"]),
        "A0000000000004": (surface(square, crs="other", use="outline"), ["not_a_footprint", "reference_system"]),
        "A0000000000005": (surface("0 0 10 0 10 10 0", ' srsDimension="3" count="9"'), ["dimension", "declared_points", "broken_ring"]),
        "A0000000000006": ("", []),
    }
    path = tmp_path / "b.xml"
    members = "".join(building(ref, inner) for ref, (inner, _) in cases.items())
    path.write_text(f'<c xmlns:gml="g" xmlns:bu="u" xmlns:xsi="x">{members}</c>')
    got = {r.refcat: r for r in TG.building_columns(TG.read_records(spark, str(path))).collect()}
    assert {ref: r.violations for ref, r in got.items()} == {ref: found for ref, (_, found) in cases.items()}
    full = got["A0000000000001"]
    assert (full.dwelling_properties, full.gross_floor_m2, full.footprint_m2, full.centroid_x) == (3, 120.5, 100.0, 5.0)
    assert full.date_quality == "complete" and full.polygons == [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]]
    assert all(got[r].polygons is None and got[r].footprint_m2 is None for r in cases if r != "A0000000000001")
    assert got["short"].gross_floor_m2 is None and got["A0000000000003"].gross_floor_m2 is None


def test_html_rows(spark):
    html = "<table><tr><th>h</th></tr><tr><td class='n1'>A &amp; B</td><td> 1\n 2 </td><td></td></tr></table><p>no</p>"
    got = TG.html_table_rows(spark.createDataFrame([(7, html), (8, None)], "id int, html string"), "id", "html").orderBy("row_no").collect()
    assert [(r["id"], r["depth"], r["label"], r["cells"]) for r in got] == [(7, "", "h", []), (7, "n1", "A & B", ["1 2", ""])]


def test_broken_records_are_rows_and_cost_no_other(spark, tmp_path, rows):
    good = [building(f"A000000000000{i}", f"<bu:numberOfDwellings>{i}</bu:numberOfDwellings>") for i in range(6)]
    unclosed = building("A0000000000007", "<bu:currentUse>x")
    no_end = building("A0000000000008", "").removesuffix("</gml:featureMember>")
    head = '<?xml version="1.0"?>\n<gml:FeatureCollection xmlns:gml="g" xmlns:bu="u" numberReturned="{}">\n'
    (tmp_path / "a.xml").write_text(head.format(5) + "\n".join([good[0], unclosed, no_end, good[1], good[2]]) + "\n</gml:FeatureCollection>")
    (tmp_path / "b.xml").write_text(head.format(4) + "".join(good[3:]) + "</gml:FeatureCollection>\n")
    (tmp_path / "c.xml").write_text("<gml:FeatureCollection>" + good[0] + building("A0000000000009", "")[:-60])
    (tmp_path / "d.xml").write_text(head.format(0) + "</gml:FeatureCollection>")
    records = TG.read_records(spark, str(tmp_path))
    out = TG.building_columns(records.filter("_corrupt_record is null"), ["file"])
    name = F.element_at(F.split("file", "/"), -1).alias("file")
    assert rows(out, name, "refcat", "dwelling_properties") == sorted([("a.xml" if i < 3 else "b.xml", f"A000000000000{i}", i) for i in range(6)] + [("c.xml", "A0000000000000", 0)])
    assert sorted(r[0][:40] for r in records.filter("_corrupt_record is not null").select("_corrupt_record").collect()) == sorted(x[:40] for x in (unclosed, no_end, building("A0000000000009", "")))
    assert rows(TG.record_counts(records, TG.declared_counts(spark, str(tmp_path))), name, "declared", "read", "corrupt", "verdict") == [
        ("a.xml", 5, 5, 2, "corrupt_records"), ("b.xml", 4, 3, 0, "count_differs"), ("c.xml", None, 2, 1, "undeclared"), ("d.xml", 0, 0, 0, "ok")]


def test_records_are_dealt_from_one_file(spark, tmp_path):
    (tmp_path / "big.xml").write_text("<c>" + "".join(building(f"A{i:013d}", "") for i in range(3000)) + "</c>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        records = TG.read_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 3
        assert TG.building_columns(records).select("refcat").distinct().count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cube_keeps_zero_and_missing(spark, rows):
    doc = '{"id":["g","t"],"size":[2,3],"value":{"0":1.5,"2":0.0,"5":9.0},"status":{"1":":"}}'
    df = NS.cube_rows(spark.createDataFrame([("k", doc)], "k string, doc string"), "doc", ["k"], 2)
    assert [(r["dim0"], r["dim1"], r["value"], r["status"]) for r in df.orderBy("pos").collect()] == [
        (0, 0, 1.5, None), (0, 1, None, ":"), (0, 2, 0.0, None), (1, 0, None, None), (1, 1, None, None), (1, 2, 9.0, None)]


CATEGORIES = '"dimension":{"g":{"category":{"index":{"b":1,"a":0},"label":{"a":"First","b":"Second"}}},"t":{"category":{"index":["2024","2025","2026"]}}}'


def test_cube_forms_orders_and_labels_agree(spark, rows):
    want = [("a", "First", "2024", 0.0, "b"), ("a", "First", "2025", None, None), ("a", "First", "2026", 2.5, None), ("b", "Second", "2024", None, "c"), ("b", "Second", "2025", None, None), ("b", "Second", "2026", 9.0, None)]
    docs = [
        ("map", '{"id":["g","t"],"size":[2,3],"value":{"0":0,"2":2.5,"5":9},"status":{"0":"b","3":"c"},' + CATEGORIES + "}"),
        ("list", '{"id":["g","t"],"size":[2,3],"value":[0,null,2.5,null,null,9.0],"status":["b",null,null,"c"],' + CATEGORIES + "}"),
        ("short", '{"id":["g","t"],"size":[2,3],"value":[0,null,2.5,null,null,9.0,7,7],"status":{"0":"b","3":"c","9":"x","01":"y"},' + CATEGORIES + "}"),
        ("turned", '{"id":["t","g"],"size":[3,2],"value":{"0":0,"4":2.5,"5":9},"status":["b","c"],' + CATEGORIES + "}"),
    ]
    df = NS.cube_cells(spark.createDataFrame(docs, "k string, doc string"), "doc", ["k"], ["g", "t"])
    for name, _ in docs:
        assert rows(df.filter(df.k == name), "g", "g_label", "t", "value", "status") == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t)), name
    assert rows(NS.cube_violations(spark.createDataFrame(docs, "k string, doc string"), "doc", ["k"], ["g", "t"])) == [("short", "position_out_of_range")]


def test_broken_cubes_are_named_and_give_no_wrong_cell(spark, rows):
    cube = lambda value, sizes="[2,3]", ids='["g","t"]': f'{{"id":{ids},"size":{sizes},"value":{value},{CATEGORIES}}}'
    docs = [
        ("text", cube('{"0":"12.5","1":true,"2":3}')),
        ("none", cube("{}")),
        ("number", cube("7")),
        ("sizes", cube("[1]", "[2]")),
        ("index", cube("[1]", "[3,3]")),
        ("dims", cube("[1]", "[2,3]", '["g","x"]')),
        ("twice", cube("[1]", "[2,2]", '["g","g"]')),
        ("outside", cube('{"-1":1,"2":3,"6":1}')),
        ("high", cube("[101, 0]")),
        ("broken", "{"),
        ("null", None),
    ]
    df = spark.createDataFrame(docs, "k string, doc string")
    got = {}
    for r in NS.cube_violations(df, "doc", ["k"], ["g", "t"], {"g": "a"}, 0, 100).filter("violation <> 'unexpected_g'").collect():
        got.setdefault(r.k, set()).add(r.violation)
    assert got["text"] == {"not_a_number"} and got["none"] == {"no_values"} and got["number"] == {"value_container", "no_values"}
    assert got["sizes"] >= {"size_mismatch"} and got["index"] == {"category_index"} and got["outside"] == {"position_out_of_range"}
    assert got["dims"] == {"unexpected_dimensions", "category_index"} and got["twice"] >= {"repeated_dimension"} and got["high"] == {"out_of_bounds"}
    assert got["broken"] >= {"unreadable"} and got["null"] >= {"unreadable"}
    cells = NS.cube_rows(df, "doc", ["k"], 2)
    assert rows(cells.filter("k in ('text', 'outside') and value is not null"), "k", "pos", "value") == [("outside", 2, 3.0), ("text", 2, 3.0)]
    assert cells.filter("k in ('sizes', 'broken', 'null')").count() == 0


def test_series_and_wide_years(spark, rows):
    doc = '[{"Nombre":"Álava. Total. Personas.","COD":"X","Data":[{"Anyo":2020,"FK_Periodo":28,"Valor":5.0},{"Anyo":2021,"FK_Periodo":28,"Valor":null}]},{"Nombre":"Álava. Hombres. Personas.","COD":"Y","Data":[]}]'
    df = NS.series_rows(spark.createDataFrame([(doc,)], "doc string"), "doc", ["Total", "Personas"], [])
    assert rows(df, "territory", "yr", "value") == [("Álava", 2020, 5.0), ("Álava", 2021, None)]
    wide = spark.createDataFrame([("a", 1.0, -2.0, float("nan"))], "k string, I_15 double, I_16 double, I_17 double")
    assert rows(NS.wide_years(wide, ["k"], "I_", [2015, 2016, 2017])) == [("a", 2015, 1.0), ("a", 2016, None), ("a", 2017, None)]


def test_sections_and_grid(spark, rows):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, "A"), ("s", 3, None), ("s", 4, "B")], "sheet string, n int, h string")
    for block in (1, 2, 1000):
        assert rows(ML.carry_section(df, ["sheet"], "n", "h", "sec", block), "n", "sec") == [(1, None), (2, "A"), (3, "A"), (4, "B")]
    a = spark.createDataFrame([(1, "x", 5.0), (2, "y", 6.0)], "k int, l string, v double")
    b = spark.createDataFrame([(2, "z", 7.0)], "k int, l string, v double")
    assert rows(ML.on_key_grid({"a": a, "b": b}, ["k"], "l", "v"), "k", "label_conflict", "a", "b") == [(1, False, 5.0, None), (2, True, 6.0, 7.0)]


def test_publish_swaps_and_checks(spark, tmp_path, rows):
    declared = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    path = str(tmp_path / "out")
    TB.publish(spark.createDataFrame([(1, 2)], "k int, v int"), declared, path)
    out = TB.publish(spark.createDataFrame([(3, 4)], "k int, v int"), declared, path)
    assert rows(out) == [(3, 4.0)] and TB.schema_drift(out, declared) == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(ValueError, match="missing"):
        TB.publish(spark.createDataFrame([(3,)], "k int"), declared, path)
    assert TB.schema_drift(out.withColumn("x", F.lit(1)), declared) == ["x: declared absent, found int"]


def test_pins(spark, tmp_path, rows):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 10)
    found = MF.file_hashes(spark, f"{tmp_path}/*.bin")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert dict(rows(found, "file", "sha256"))["a.bin"] == digest
    pins = spark.createDataFrame([("a.bin", digest), ("c.bin", "0")], "file string, sha256 string")
    assert rows(MF.compare_to_pins(found, pins)) == [("a.bin", "ok"), ("b.bin", "unpinned"), ("c.bin", "missing")]


def test_folders_of_files_are_one_source_each(spark, tmp_path, rows):
    for name, content in [("a.parquet/part-0", b"abc"), ("a.parquet/k=1/part-0", b"d"), ("b.parquet/part-0", b"x"), ("c.parquet", b"c")]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    paths = f"{tmp_path}/*.parquet"
    pins = settle(MF.by_source(MF.pins_of(spark, paths)))
    assert dict(rows(pins))["c.parquet"] == hashlib.sha256(b"c").hexdigest()
    assert rows(MF.compare_to_pins(MF.by_source(MF.file_hashes(spark, paths)), pins)) == [("a.parquet", "ok"), ("b.parquet", "ok"), ("c.parquet", "ok")]
    (tmp_path / "b.parquet/part-0").write_bytes(b"y")
    (tmp_path / "a.parquet/part-1").write_bytes(b"e")
    assert rows(MF.compare_to_pins(MF.by_source(MF.file_hashes(spark, [paths])), pins)) == [("a.parquet", "mismatched"), ("b.parquet", "mismatched"), ("c.parquet", "ok")]
    assert rows(MF.by_source(MF.file_hashes(spark, [f"{tmp_path}/c.parquet", f"{tmp_path}/b.parquet/*"])), "file") == [("c.parquet",), ("part-0",)]


def test_pins_of_files_that_the_whole_file_reader_refuses(spark, tmp_path, rows):
    (tmp_path / "a b").mkdir()
    most = 1 << 24
    for name, size in [("a b/held.bin", most), ("a b/long%20.bin", most + 1), ("a b/longer.bin", 2 * most + 3), ("short.bin", 3)]:
        (tmp_path / name).write_bytes(bytes(range(251)) * (size // 251) + b"x" * (size % 251))
    digest = {f"{p.relative_to(tmp_path)}": hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.rglob("*.bin")}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", most)
    try:
        pins = rows(MF.pins_of(spark, [f"{tmp_path}/a b", f"{tmp_path}/short.bin"]), "file", "sha256", "path", "source")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    listed = [("a b/held.bin", "a b"), ("a b/long%20.bin", "a b"), ("a b/longer.bin", "a b"), ("short.bin", "short.bin")]
    assert pins == [(n.split("/")[-1], digest[n], f"file:{tmp_path}/{n}", f"file:{tmp_path}/{source}") for n, source in listed]
    found = MF.file_hashes(spark, [f"{tmp_path}/a b", f"{tmp_path}/short.bin"])
    assert rows(found, "file", "sha256", "path", "source") == pins
    assert found.filter("length > 3").select(F.spark_partition_id()).distinct().count() == 3


def test_pins_in_a_store_that_only_spark_opens(spark, tmp_path, rows):
    (tmp_path / "long.bin").write_bytes(b"ab" * (1 << 24))
    (tmp_path / "c.bin").write_bytes(b"c")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pins.link./in", f"file://{tmp_path}")
    expected = [("c.bin", hashlib.sha256(b"c").hexdigest()), ("long.bin", hashlib.sha256(b"ab" * (1 << 24)).hexdigest())]
    assert rows(MF.pins_of(spark, "viewfs://pins/in/*.bin"), "file", "sha256") == expected
    assert rows(MF.pins_of(spark, ["viewfs://pins/in/long.bin", f"{tmp_path}/c.bin"]), "file", "sha256") == expected


def test_snapshot_age(spark):
    df = spark.createDataFrame([("2024-01-01",), ("soon",), (None,)], "s string")
    assert [r[0] for r in df.select(MF.snapshot_age(F.col("s"), F.lit("2024-01-31").cast("date"))).collect()] == [30, None, None]


def test_stale_outputs(spark, rows):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, sha256 string")
    stamps = spark.createDataFrame([("x", "a", "1"), ("y", "a", "1"), ("y", "b", "0"), ("z", "gone", "9")], "output string, file string, sha256 string")
    assert rows(MF.stale_outputs(stamps, now), "output", "state") == [("x", "fresh"), ("y", "stale"), ("z", "stale")]


def test_html_rows_without_end_tags_and_nested(spark):
    html = "<table><thead><tr><th>h<th>v<tbody><tr><td class=n1>A<td>1<tr><td class=n2>B<td><table><tr><td>in</table>2"
    got = TG.html_table_rows(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").orderBy("row_no").collect()
    assert [(r.depth, r.label, r.cells, r.header) for r in got] == [("", "h", ["v"], True), ("n1", "A", ["1"], False), ("", "in", [], False), ("n2", "B", ["2"], False)]


def test_html_table_violations(spark):
    sound = "<table><tr><th>area<th>n<tr><td class=n1>A<td>1<tr><td class=n2>a<td>1<tr><td class=n1>B<td>2<tr><td class=n2>a<td>2</table>"
    broken = "<table><tr><th>n<th>area<tr><td class=n2>a<td>1<tr><td class=n1>A<td>1<td>2<tr><td class=n2>x<td>1<tr><td class=n2>x<td>1<tr><td class=n9>y<td>1</table>"
    pages = spark.createDataFrame([(1, sound), (2, broken), (3, "<table><tr><td class=n1>A<td>1</table>")], "id int, html string")
    got = TG.table_violations(TG.html_table_rows(pages, "id", "html"), "id", ["area", "n"], ["n1", "n2"]).collect()
    assert sorted((r.id, r.row_no if r.row_no is not None else -1, r.violation) for r in got) == [
        (2, 0, "header_order"), (2, 1, "level_jump"), (2, 2, "cell_count"), (2, 4, "repeated_label"), (2, 5, "unknown_level"), (3, -1, "header_count"),
    ]


def test_a_reader_keeps_the_version_it_began_with(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    old = TB.publish_version(spark.createDataFrame([(1, "a")], "k int, p string"), path, ["p"])
    reading = TB.read_version(spark, path)
    new = TB.publish_version(spark.createDataFrame([(2, "a"), (3, "b")], "k int, p string"), path, ["p"])
    assert rows(reading, "k") == rows(old, "k") == [(1,)] and rows(TB.read_version(spark, path), "k") == rows(new, "k") == [(2,), (3,)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        TB.publish_version(spark.range(3).select((F.lit(1) / F.col("id")).alias("k")), path)
    assert rows(TB.read_version(spark, path), "k") == [(2,), (3,)] and rows(reading, "k") == [(1,)]
    # the pointer alone decides: a version that was written but never pointed to is not read
    spark.createDataFrame([(9, "z")], "k int, p string").write.parquet(f"{path}/v999999999999-half")
    assert rows(TB.read_version(spark, path), "k") == [(2,), (3,)]
    for k in (4, 5):
        TB.publish_version(spark.createDataFrame([(k, "a")], "k int, p string"), path, ["p"])
    assert rows(TB.read_version(spark, path), "k") == [(5,)] and len(TB.current_versions(spark, path)) == 2
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(("v", ".CURRENT.crc"))) == ["CURRENT"]


def test_attached_namespaces_go_and_files_stay(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(4).write.parquet(path)
    before = {r[0] for r in spark.sql("SHOW SCHEMAS").collect()}
    with TB.attached(spark, {"one": {"t": path}, "two": {"t": path}}, str(tmp_path / "places")) as name:
        df = spark.sql(f"SELECT count(*) AS n FROM {name['one']}.t a JOIN {name['two']}.t b ON a.id = b.id")
    assert {r[0] for r in spark.sql("SHOW SCHEMAS").collect()} == before
    assert df.first().n == 4 and spark.read.parquet(path).count() == 4


def test_register_sorts_narrow_rows(spark, tmp_path, rows):
    part = spark.range(1, 60).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size", "'x' AS p_type", "id * 1.5D AS p_retailprice").unionByName(spark.sql("SELECT -3L AS p_partkey, 4 AS p_size, 'y' AS p_type, 1D AS p_retailprice"))
    lines = PS._register_lines(part)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    # the long texts are built above the sort, whose rows hold the table's columns alone
    assert "featureMember" in plan[: plan.index("Sort [")] and "featureMember" not in plan[plan.index("Sort [") :]
    lines.write.partitionBy("part").text(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part=*/part-*"))
    assert len(files) == 9 and sum(f.read_text().count("<gml:featureMember") for f in files) == 60
    for f in files:
        text = f.read_text()
        assert text.startswith("<gml:FeatureCollection") and text.endswith("</gml:FeatureCollection>\n")
    found = TG.record_counts(TG.read_records(spark, str(tmp_path / "out")), TG.declared_counts(spark, str(tmp_path / "out")))
    assert sum(r[0] for r in rows(found, "read")) == 60 and [r[0] for r in rows(found.filter("declared <> read"), "verdict")] == ["count_differs"]
