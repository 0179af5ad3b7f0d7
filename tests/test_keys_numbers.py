"""Cleansing rules on hand-made cells."""

from pyspark.sql import functions as F

from parcelbook.functions import buckets as BK
from parcelbook.functions import keys as K
from parcelbook.functions import numbers as N


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]



def test_names(spark):
    assert one(spark, ["  Málaga   la Vella ", "ñandú €", None], K.norm_name) == ["MALAGA LA VELLA", "NANDU", None]
    assert one(spark, ["Árbol-2 b"], K.flat_key) == ["ARBOL2B"]


def test_place_key(spark):
    names = ["El Bruc", "Bruc, El", "L'Ametlla", "Madrid (ciudad)", "Las", "Las Rozas, Las", "Palma, La"]
    assert one(spark, names, K.place_key) == ["BRUC", "BRUC", "AMETLLA", "MADRID", "", "ROZAS", "PALMA"]


def test_labels(spark):
    df = spark.createDataFrame([("El Bruc", "Bruc, El"), ("Sevilla (provincia)", "Sevilla"), ("Resto de Sevilla", "Sevilla")], "a string, b string")
    assert [r[0] for r in df.select(K.labels_agree(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert one(spark, ["Atazar, El", "Madrid"], K.uninvert) == ["El Atazar", "Madrid"]
    assert one(spark, ["01 Andalucía", "3. Centro", "x 1"], K.strip_code) == ["Andalucía", "Centro", "x 1"]
    assert one(spark, ["A. B.. C. "], K.dotted_parts) == [["A", "B", "C"]]
    assert one(spark, ["1", "123456"], lambda c: K.zfill(c, 5)) == ["00001", "123456"]
    assert one(spark, ["41001", "41999", "4100", "4100a"], K.is_unit_code) == [True, False, False, False]


def test_strict_number(spark):
    cells = ["1.234,5", "12", ".", "", "1,234.5", "12 a", None, "-3,5"]
    assert one(spark, cells, lambda c: N.strict_number(c)[0]) == [1234.5, 12.0, None, None, None, None, None, -3.5]
    assert one(spark, cells, lambda c: N.strict_number(c)[1]) == [False, False, False, False, True, True, False, False]


def test_mixed_number(spark):
    cells = ["18.689,8", "18,689.8", "3,5", "1,234", "1,234,567", "..", ",", "7.25", ""]
    assert one(spark, cells, N.mixed_separator_number) == [18689.8, 18689.8, 3.5, 1234.0, 1234567.0, None, None, 7.25, None]


def test_sentinels_and_ratios(spark):
    assert one(spark, [" ND ", "-", "0", "3,5"], lambda c: N.drop_sentinel(c, True)) == [None, None, None, 3.5]
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(N.ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 1.5]


def test_annuity_matches_discounted_payments(spark):
    df = spark.createDataFrame([(100000.0, 0.0, 10), (0.0, 0.01, 10), (100000.0, 0.01, 24)], "p double, r double, m int")
    pay = [r[0] for r in df.select(N.annuity(F.col("p"), F.col("r"), F.col("m"))).collect()]
    assert pay[0] == 10000.0 and pay[1] == 0.0
    assert abs(sum(pay[2] / 1.01**k for k in range(1, 25)) - 100000.0) < 1e-6


def test_dates(spark):
    cells = [None, BK.NO_DATE, "1999-05-06T00:00:00", "1999-05-06T00:00:00.5+14:00", "1999-05-06T00:00:00+14:30", "1999-02-30T00:00:00", "2101-01-01T00:00:00Z", "1999-05-06", "1999-05-06T25:00:00"]
    got = one(spark, cells, BK.construction_date)
    assert [tuple(g) for g in got] == [(None, "missing"), (None, "missing"), (1999, "valid"), (1999, "valid")] + [(None, "invalid")] * 5


def test_age_groups(spark):
    assert one(spark, [17, 20, 27, 70], BK.age_groups, "int") == [["TOTAL"], ["TOTAL", "Y18-24", "Y18-64"], ["TOTAL", "Y25-29", "Y18-64"], ["TOTAL", "Y_GE65"]]
    assert one(spark, [None, 1950, 1990], lambda c: BK.band(c, [(0, 1960, "old"), (1961, 2000, "new")], "undated"), "int") == ["undated", "old", "new"]
