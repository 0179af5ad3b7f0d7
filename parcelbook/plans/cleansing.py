"""Keys, labels, numbers, buckets and key reconciliation on the text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.functions import buckets as BK
from parcelbook.functions import keys as K
from parcelbook.functions import numbers as N
from parcelbook.operators import joins as J
from parcelbook.operators import periods as P
from parcelbook.plans import base as B
from parcelbook.plans.registry import query
from parcelbook.session import settle, spread
from parcelbook.sources.tables import load

Spark = SparkSession


@query(
    "k01_name_norm",
    """SELECT doc_id, length(k) AS key_length, md5(k) AS key_hash FROM (SELECT doc_id,
    trim(regexp_replace(regexp_replace(upper(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM documents)""",
)
def k01(spark: Spark, d: str) -> DataFrame:
    # whole texts are normalised; a hash stands for the long key in the result
    k = K.norm_name(F.col("text"))
    return spread(load(spark, d, "documents")).select("doc_id", k.alias("k")).select(
        "doc_id", F.length("k").cast("long").alias("key_length"), F.md5("k").alias("key_hash")
    )


@query(
    "k02_flat_key",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(upper(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '[^A-Z0-9]', '', 'g')) AS flat_hash FROM documents""",
)
def k02(spark: Spark, d: str) -> DataFrame:
    return spread(load(spark, d, "documents")).select("doc_id", F.md5(K.flat_key(F.col("text"))).alias("flat_hash"))


PLACE = """CASE p_size % 5 WHEN 0 THEN 'El ' || p_name WHEN 1 THEN p_name || ', La' WHEN 2 THEN p_name || ' (provincia)' WHEN 3 THEN 'L''' || p_name ELSE 'Las' END"""


def _place(size: str = "p_size", name: str = "p_name"):
    m = F.col(size) % 5
    n = F.col(name)
    return (
        F.when(m == 0, F.concat(F.lit("El "), n))
        .when(m == 1, F.concat(n, F.lit(", La")))
        .when(m == 2, F.concat(n, F.lit(" (provincia)")))
        .when(m == 3, F.concat(F.lit("L'"), n))
        .otherwise(F.lit("Las"))
    )


@query(
    "k03_place_key",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN '' ELSE upper(p_name) END AS place FROM part""",
)
def k03(spark: Spark, d: str) -> DataFrame:
    # a name that is only an article loses it, as the leading rule has no exception
    return load(spark, d, "part").select("p_partkey", K.place_key(_place()).alias("place"))


@query(
    "k04_uninvert",
    """SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_size % 2 = 0 THEN ', El' ELSE '' END, '^(.*),\\s*(.*)$', '\\2 \\1') AS name FROM part""",
)
def k04(spark: Spark, d: str) -> DataFrame:
    raw = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ", El").otherwise(""))
    return load(spark, d, "part").select("p_partkey", K.uninvert(raw).alias("name"))


@query(
    "k05_code_label",
    """SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, p_name AS label, p_name AS stripped FROM part""",
)
def k05(spark: Spark, d: str) -> DataFrame:
    raw = F.concat_ws(" ", K.zfill(F.col("p_size"), 2), F.col("p_name"))
    dotted = F.concat(F.col("p_size").cast("string"), F.lit(". "), F.col("p_name"))
    code, label = K.split_code(raw)
    return load(spark, d, "part").select("p_partkey", code.alias("code"), label.alias("label"), K.strip_code(dotted).alias("stripped"))


@query(
    "k06_dotted_parts",
    """SELECT c_custkey, c_name AS first, c_mktsegment AS second, 3 AS parts FROM customer""",
)
def k06(spark: Spark, d: str) -> DataFrame:
    raw = F.concat(F.col("c_name"), F.lit(".  "), F.col("c_mktsegment"), F.lit(". . Total. "))
    parts = K.dotted_parts(raw)
    return load(spark, d, "customer").select(
        "c_custkey", F.element_at(parts, 1).alias("first"), F.element_at(parts, 2).alias("second"), F.size(parts).alias("parts")
    )


@query(
    "k07_label_classifier",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS territory, CASE WHEN c_custkey % 4 < 2 THEN 'Total' END AS measure FROM customer""",
)
def k07(spark: Spark, d: str) -> DataFrame:
    m = F.col("c_custkey") % 4
    name = F.col("c_name")
    raw = (
        F.when(m == 0, F.concat(name, F.lit(". Total.")))
        .when(m == 1, F.concat(F.lit("Total. "), name))
        .when(m == 2, F.lit("Total. Number."))
        .otherwise(name)
    )
    territory, measure = K.classify_parts(K.dotted_parts(raw), ["Total", "Number"])
    return load(spark, d, "customer").select("c_custkey", territory.alias("territory"), measure.alias("measure"))


@query(
    "k08_strict_number",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN NULL ELSE o_totalprice END AS value, o_orderkey % 7 = 1 AS error FROM orders""",
)
def k08(spark: Spark, d: str) -> DataFrame:
    # 1234567.89 -> '1.234.567,89', with blanks and a malformed spelling mixed in
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    m = F.col("o_orderkey") % 7
    raw = F.when(m == 0, "..").when(m == 1, F.concat(text, F.lit(" eur"))).otherwise(text)
    texts = load(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    value, error = N.strict_number(F.col("raw"))
    return texts.select("o_orderkey", value.alias("value"), error.alias("error"))


@query(
    "k09_sentinels",
    """SELECT p_partkey, CASE WHEN p_size % 6 IN (0, 1, 2) THEN NULL ELSE p_retailprice END AS price FROM part""",
)
def k09(spark: Spark, d: str) -> DataFrame:
    m = F.col("p_size") % 6
    raw = F.when(m == 0, " N.D. ").when(m == 1, "-").when(m == 2, "0").otherwise(F.col("p_retailprice").cast("string"))
    return load(spark, d, "part").select("p_partkey", N.drop_sentinel(raw, zero_is_missing=True).alias("price"))


@query(
    "k10_zero_padded",
    """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code, CASE WHEN c_nationkey IN (5, 6) THEN '05+06' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS unit FROM customer""",
)
def k10(spark: Spark, d: str) -> DataFrame:
    code = K.zfill(F.col("c_nationkey"), 2)
    return load(spark, d, "customer").select("c_custkey", code.alias("code"), K.merged_unit(code, ["05", "06"]).alias("unit"))


@query(
    "k11_code_shape",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey < 100000 THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS code FROM orders)
    SELECT o_orderkey, code FROM c WHERE regexp_full_match(code, '[0-9]{5}') AND right(code, 3) <> '999'""",
)
def k11(spark: Spark, d: str) -> DataFrame:
    raw = F.col("o_orderkey").cast("string")
    code = F.when(F.col("o_orderkey") % 3 == 0, raw).otherwise(K.zfill(raw, 5))
    return load(spark, d, "orders").select("o_orderkey", code.alias("code")).filter(K.is_unit_code(F.col("code")))


@query(
    "k12_age_bands",
    """WITH a AS (SELECT c_custkey, CAST(c_custkey % 90 AS INT) AS age FROM customer) SELECT c_custkey, CASE WHEN age <= 19 THEN '0-19' WHEN age <= 34 THEN '20-34' WHEN age <= 49 THEN '35-49' WHEN age <= 64 THEN '50-64' ELSE '65+' END AS band,
    CASE WHEN age < 18 THEN 'Y_LT18' WHEN age <= 24 THEN 'Y18-24' WHEN age <= 29 THEN 'Y25-29' WHEN age <= 64 THEN 'Y30-64' ELSE 'Y_GE65' END AS cohort,
    1 + CAST(age BETWEEN 18 AND 24 AS INT) + CAST(age BETWEEN 25 AND 29 AS INT) + CAST(age BETWEEN 18 AND 64 AS INT) + CAST(age >= 65 AS INT) AS groups FROM a""",
)
def k12(spark: Spark, d: str) -> DataFrame:
    age = (F.col("c_custkey") % 90).cast("int")
    return load(spark, d, "customer").select(
        "c_custkey", BK.band(age, BK.AGE_BANDS).alias("band"), BK.band(age, BK.COHORTS).alias("cohort"), F.size(BK.age_groups(age)).alias("groups")
    )


@query(
    "k13_era_buckets",
    f"""WITH {B.PB} SELECT {B.ERA_SQL} AS era, CASE WHEN vintage IS NULL THEN 6 WHEN vintage <= 1940 THEN 1 WHEN vintage <= 1960 THEN 2 WHEN vintage <= 1980 THEN 3 WHEN vintage <= 2000 THEN 4 ELSE 5 END AS pos,
    count(*) AS records, CAST(sum(w) AS BIGINT) AS weight FROM pb GROUP BY 1, 2""",
)
def k13(spark: Spark, d: str) -> DataFrame:
    v = F.col("vintage")
    return (
        B.buildings(spark, d)
        .groupBy(BK.band(v, B.ERAS, "undated").alias("era"), BK.band_order(v, B.ERAS).alias("pos"))
        .agg(F.count("*").alias("records"), F.sum("w").alias("weight"))
    )


@query(
    "k14_date_quality",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year_start, CASE WHEN o_orderkey % 5 IN (0, 2) THEN NULL WHEN o_orderkey % 5 = 4 THEN 1990 ELSE CAST(year(o_orderdate) AS INT) END AS year_end,
    CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'partial' ELSE 'complete' END AS date_quality, o_orderkey % 5 = 4 AS reversed FROM orders""",
)
def k14(spark: Spark, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 5
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    start = F.when(m == 0, F.lit(BK.NO_DATE)).when(m == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(iso)
    end = F.when(m.isin(0, 2), F.lit(None).cast("string")).when(m == 4, "1990-01-01T00:00:00Z").otherwise(iso)
    raw = load(spark, d, "orders").select("o_orderkey", start.alias("s"), end.alias("e"))
    return raw.select("o_orderkey", BK.date_quality(F.col("s"), F.col("e")).alias("q")).select("o_orderkey", "q.*")


@query(
    "k15_month_end_serial",
    """SELECT o_orderkey, CAST(last_day(o_orderdate) - DATE '1899-12-30' AS INT) AS serial, CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS at_month_end FROM orders""",
)
def k15(spark: Spark, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    serial = BK.month_end_serial(day)
    return load(spark, d, "orders").select(
        "o_orderkey", serial.alias("serial"), BK.from_serial(serial).cast("string").alias("month_end"), BK.is_month_end(day).alias("at_month_end")
    )


@query(
    "k16_alias_map",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'EQUIPMENT' WHEN 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS segment FROM customer""",
)
def k16(spark: Spark, d: str) -> DataFrame:
    alias = spark.createDataFrame([("MACHINERY", "EQUIPMENT"), ("HOUSEHOLD", "HOME")], "c_mktsegment string, alias string")
    c = load(spark, d, "customer").join(alias, "c_mktsegment", "left")
    return c.select("c_custkey", F.coalesce("alias", "c_mktsegment").alias("segment"))


@query(
    "k17_homonym_quarantine",
    """WITH k AS (SELECT p_partkey, upper(p_name) AS key, p_brand, p_type, p_retailprice FROM part), a AS (SELECT key, min(p_brand) <> max(p_brand) AS ambiguous FROM k GROUP BY 1)
    SELECT p_partkey, ambiguous, CASE WHEN NOT ambiguous THEN p_type END AS p_type, p_retailprice FROM k JOIN a USING (key)""",
)
def k17(spark: Spark, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", K.place_key(F.col("p_name")).alias("key"), "p_brand", "p_type", "p_retailprice")
    return J.quarantine_homonyms(p, ["key"], "p_brand", ["p_type"]).select("p_partkey", "ambiguous", "p_type", "p_retailprice")


@query(
    "k18_case_repair",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN upper(c_name) END AS reference, c_custkey % 3 <> 2 AND lower(c_name) <> upper(c_name) AND c_custkey % 3 = 0 AS repaired FROM customer""",
)
def k18(spark: Spark, d: str) -> DataFrame:
    m = F.col("c_custkey") % 3
    a = F.when(m == 0, F.lower("c_name")).otherwise(F.upper("c_name"))
    b = F.when(m == 2, F.lit("other")).otherwise(F.col("c_name"))
    ref, repaired = K.repair_case(a, b)
    return load(spark, d, "customer").select("c_custkey", ref.alias("reference"), repaired.alias("repaired"))


@query(
    "k19_label_agreement",
    """SELECT p_partkey, p_size % 5 NOT IN (2, 4) AS agrees FROM part""",
)
def k19(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", K.labels_agree(_place(), F.col("p_name")).alias("agrees"))


@query(
    "k20_crosswalk",
    """WITH a AS (SELECT upper(p_name) AS key, count(*) AS n, max(p_partkey) AS code FROM part WHERE p_size <= 10 GROUP BY 1), b AS (SELECT upper(p_name) AS key, count(*) AS n, max(p_partkey) AS code FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN coalesce(a.n, 1) = 1 THEN a.code END AS code_a, CASE WHEN coalesce(b.n, 1) = 1 THEN b.code END AS code_b,
    CASE WHEN b.n IS NULL THEN 'missing_right' WHEN a.n IS NULL THEN 'missing_left' WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' ELSE 'ok' END AS pair_status FROM a FULL JOIN b ON a.key = b.key""",
)
def k20(spark: Spark, d: str) -> DataFrame:
    p = load(spark, d, "part")
    key = K.norm_name(F.col("p_name")).alias("key")
    a = p.filter(F.col("p_size") <= 10).select(key, F.col("p_partkey").alias("code_a"))
    b = p.filter(F.col("p_size") > 10).select(key, F.col("p_partkey").alias("code_b"))
    return J.crosswalk_check(a, b, "key", "code_a", "code_b")


@query(
    "k21_mixed_separators",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(round_even(o_totalprice * 1000, 0) AS BIGINT) END AS units FROM orders""",
)
def k21(spark: Spark, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 4
    us = F.format_number("o_totalprice", 2)
    raw = (
        F.when(m == 0, us)
        .when(m == 1, F.translate(us, ",.", ".,"))
        .when(m == 2, F.translate(F.replace(us, F.lit(","), F.lit("")), ".", ","))
        .otherwise(F.lit(".."))
    )
    texts = load(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    values = texts.select("o_orderkey", N.mixed_separator_number(F.col("raw")).alias("value"))
    return values.withColumn("units", N.thousands_to_units(F.col("value")))


K22_SQL = f"""WITH {B.NY}, a AS (SELECT region, yr, sum(n_orders) AS anchor FROM ny GROUP BY 1, 2), r AS (SELECT region AS nm, region, yr, CAST(sum(n_orders) AS DOUBLE) * 1.001 AS v, 'sum' AS code FROM ny GROUP BY 1, 2, 3
  UNION ALL SELECT CASE WHEN unit IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') THEN region ELSE unit END, region, yr, CAST(n_orders AS DOUBLE), unit FROM ny),
  s AS (SELECT r.*, abs(v - anchor) / anchor AS gap, row_number() OVER (PARTITION BY r.region, r.yr, nm ORDER BY abs(v - anchor) / anchor, code) AS rn, count(*) OVER (PARTITION BY r.region, r.yr, nm) AS n FROM r JOIN a ON r.region = a.region AND r.yr = a.yr)"""


@query(
    "k22_anchor_disambiguation",
    f"""{K22_SQL} SELECT region, yr, CASE WHEN n = 2 THEN nm || ' (unit)' ELSE nm END AS label, round(v, 6) AS v, code FROM s WHERE NOT (rn = 1 AND gap <= 0.005)""",
)
def k22(spark: Spark, d: str) -> DataFrame:
    ny = settle(B.nation_year(spark, d))
    shared = [f"NATION_{i}" for i in range(5)]
    anchor = ny.groupBy("region", "yr").agg(F.sum("n_orders").alias("anchor"))
    total = anchor.select(F.col("region").alias("nm"), "region", "yr", (F.col("anchor").cast("double") * 1.001).alias("v"), F.lit("sum").alias("code"))
    units = ny.select(
        F.when(F.col("unit").isin(shared), F.col("region")).otherwise(F.col("unit")).alias("nm"),
        "region",
        "yr",
        F.col("n_orders").cast("double").alias("v"),
        F.col("unit").alias("code"),
    )
    series = total.unionByName(units).join(anchor, ["region", "yr"])
    gap = F.abs(F.col("v") - F.col("anchor")) / F.col("anchor")
    # at most a handful of series share one name inside a parent and year
    near = series.withColumn("gap", gap).groupBy("region", "yr", "nm").agg(
        F.min_by("code", F.struct("gap", "code")).alias("closest"), F.min("gap").alias("best"), F.count("*").alias("n")
    )
    tagged = series.join(near, ["region", "yr", "nm"])
    dropped = (F.col("code") == F.col("closest")) & (F.col("best") <= 0.005)
    return tagged.filter(~dropped).select(
        "region", "yr", F.when(F.col("n") == 2, F.concat("nm", F.lit(" (unit)"))).otherwise(F.col("nm")).alias("label"), "v", "code"
    )


# ----------------------------------------------------------- reconciling joins


@query(
    "j13_unique_match",
    """WITH r AS (SELECT upper(p_name) AS key, count(*) AS matches, max(p_brand) AS lb, max(nullif(p_retailprice, 0) - 920) AS v FROM part WHERE p_size <= 6 GROUP BY 1),
    l AS (SELECT p_partkey, upper(p_name) AS key, p_brand FROM part WHERE p_size > 6), j AS (SELECT l.*, coalesce(matches, 0) AS matches, lb, v FROM l LEFT JOIN r USING (key))
    SELECT p_partkey, matches, CASE WHEN matches = 0 THEN 'missing' WHEN matches > 1 THEN 'duplicate' WHEN replace(lb, 'Brand#', '') = '' OR regexp_replace(lb, '[0-9#]', '', 'g') <> regexp_replace(p_brand, '[0-9#]', '', 'g') THEN 'label_mismatch'
      WHEN v IS NULL THEN 'missing' WHEN v <= 0 THEN 'nonpositive' ELSE 'valid' END AS status, CASE WHEN matches = 1 AND v > 0 THEN round(v, 6) END AS value FROM j""",
)
def j13(spark: Spark, d: str) -> DataFrame:
    p = load(spark, d, "part").withColumn("key", K.place_key(F.col("p_name")))
    right = p.filter(F.col("p_size") <= 6).select("key", F.col("p_brand").alias("lb"), (F.nullif(F.col("p_retailprice"), F.lit(0.0)) - 920).alias("v"))
    left = p.filter(F.col("p_size") > 6).select("p_partkey", "key", "p_brand")
    return J.unique_match(left, right, "key", "p_brand", "lb", "v").select("p_partkey", "matches", "status", "value")


@query(
    "j14_fallback_source",
    f"""WITH {B.NM}, u AS (SELECT unit, region, yr, CASE WHEN count(*) = 12 THEN CAST(sum(n_orders) AS DOUBLE) END AS v FROM nm GROUP BY 1, 2, 3), r AS (SELECT region, yr, CASE WHEN count(v) >= 4 THEN round(sum(v) / count(v), 6) END AS rv FROM u GROUP BY 1, 2)
    SELECT unit, u.yr, coalesce(v, rv) AS value, CASE WHEN v IS NOT NULL THEN 'own' WHEN rv IS NOT NULL THEN 'region' END AS source FROM u JOIN r ON u.region = r.region AND u.yr = r.yr""",
)
def j14(spark: Spark, d: str) -> DataFrame:
    u = settle(B.nation_month(spark, d)).groupBy("unit", "region", "yr").agg(
        F.when(F.count("*") == 12, F.sum("n_orders").cast("double")).alias("v")
    )
    r = u.groupBy("region", "yr").agg(F.when(F.count("v") >= 4, F.round(F.avg("v"), 6)).alias("rv"))
    value, source = J.with_fallback(F.col("v"), F.col("rv"), ("own", "region"))
    return u.join(r, ["region", "yr"]).select("unit", "yr", value.alias("value"), source.alias("source"))


@query(
    "j15_attach_by_name",
    """WITH r AS (SELECT p_brand AS b, upper(p_name) AS key, count(*) AS n, min(p_type) <> max(p_type) AS clash, max(p_retailprice) AS price FROM part WHERE p_size <= 25 GROUP BY 1, 2),
    l AS (SELECT p_partkey, p_brand, upper(p_name) AS key, p_size FROM part WHERE p_size > 25) SELECT p_partkey, CASE WHEN p_size >= 30 AND n = 1 AND NOT clash THEN price END AS price FROM l LEFT JOIN r ON l.p_brand = r.b AND l.key = r.key""",
)
def j15(spark: Spark, d: str) -> DataFrame:
    p = load(spark, d, "part").withColumn("key", K.place_key(F.col("p_name")))
    left = p.filter(F.col("p_size") > 25).select("p_partkey", "p_brand", "key", "p_size")
    right = p.filter(F.col("p_size") <= 25).select("p_brand", "key", "p_type", F.col("p_retailprice").alias("price"))
    return J.attach_by_name(left, right, ["p_brand"], "key", "p_type", "price", F.col("p_size") >= 30).select("p_partkey", "price")


@query(
    "j16_calendar_spine",
    f"""WITH {B.UD}, s AS (SELECT user_id, CAST(unnest(generate_series((SELECT min(day) FROM ud), (SELECT max(day) FROM ud), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM ud))
    SELECT s.user_id, CAST(s.day AS VARCHAR) AS day, ud.n FROM s LEFT JOIN ud ON s.user_id = ud.user_id AND s.day = ud.day""",
)
def j16(spark: Spark, d: str) -> DataFrame:
    ud = B.user_day(spark, d).select("user_id", "day", "n")
    users = ud.select("user_id").distinct()
    bounds = load(spark, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("z"))
    filled = P.spine(ud, users, ["user_id"], "day", bounds.select("a").scalar(), bounds.select("z").scalar())
    return filled.select("user_id", F.col("day").cast("string").alias("day"), "n")


@query(
    "j17_common_support",
    f"""WITH {B.NM}, m AS (SELECT unit, yr * 100 + mo AS period, CAST(nullif(n_orders, 5) AS DOUBLE) AS v FROM nm), w AS (SELECT period, max(v) FILTER (WHERE unit = 'NATION_3') AS a, max(v) FILTER (WHERE unit = 'NATION_7') AS b FROM m WHERE unit IN ('NATION_3', 'NATION_7') GROUP BY 1)
    SELECT period, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'only_a' WHEN b IS NOT NULL THEN 'only_b' ELSE 'none' END AS state, a - b AS difference FROM w""",
)
def j17(spark: Spark, d: str) -> DataFrame:
    m = B.nation_month(spark, d).select("unit", (F.col("yr") * 100 + F.col("mo")).alias("period"), F.nullif(F.col("n_orders"), F.lit(5)).cast("double").alias("v"))
    return P.common_support(m, "unit", "period", "v", "NATION_3", "NATION_7")


@query(
    "j19_tolerance_antijoin",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS price FROM lineitem l WHERE NOT EXISTS
    (SELECT 1 FROM part p WHERE abs(l.l_extendedprice - p.p_retailprice * 20) <= 0.5 + 0.25)""",
)
def j19(spark: Spark, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.lit(0.25).alias("slack"))
    claims = load(spark, d, "part").select((F.col("p_retailprice") * 20).alias("claim"), F.lit(0.5).alias("tol"))
    return J.unmatched_numbers(li, claims, "price", "slack", "claim", "tol", 1.0).drop("slack")
