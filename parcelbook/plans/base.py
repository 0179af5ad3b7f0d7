"""Panels derived from the driver tables, with the same panels as SQL text.

Money sums are rounded to cents before they are divided, so both engines divide the
same numbers and ties in ranks are the same ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.sources.tables import load


def places(spark: SparkSession, d: str) -> DataFrame:
    """Nation with its region."""
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("unit"), F.col("r_name").alias("region")
    )


def customer_year(spark: SparkSession, d: str) -> DataFrame:
    """Orders reduced to customer and year before anything is joined to them."""
    o = load(spark, d, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(
        F.count("*").alias("n"),
        F.sum("o_totalprice").alias("rev"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urg"),
    )


def nation_year(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    cy = customer_year(spark, d)
    by = (
        cy.join(c, cy.o_custkey == c.c_custkey)
        .groupBy("c_nationkey", "yr")
        .agg(
            F.sum("n").alias("n_orders"),
            F.count("*").alias("customers"),
            F.round(F.sum("rev"), 2).alias("revenue"),
            F.sum("urg").alias("urgent"),
        )
    )
    p = places(spark, d)
    return by.join(p, by.c_nationkey == p.n_nationkey).select(
        "unit",
        "region",
        "yr",
        "n_orders",
        "customers",
        "revenue",
        (F.col("revenue") / F.col("n_orders")).alias("price"),
        "urgent",
    )


NY = """ny AS (
  SELECT n_name AS unit, r_name AS region, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n_orders,
         count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS revenue,
         round(sum(o_totalprice), 2) / count(*) AS price,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""


def nation_month(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    cm = o.groupBy(
        "o_custkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")
    ).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("rev"))
    by = (
        cm.join(c, cm.o_custkey == c.c_custkey)
        .groupBy("c_nationkey", "yr", "mo")
        .agg(F.sum("n").alias("n_orders"), F.round(F.sum("rev"), 2).alias("revenue"))
    )
    p = places(spark, d)
    return by.join(p, by.c_nationkey == p.n_nationkey).select(
        "unit", "region", "yr", "mo", "n_orders", "revenue"
    )


NM = """nm AS (
  SELECT n_name AS unit, r_name AS region, CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mo,
         count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)"""


def supplier_means(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier: mean price x, mean discount y, mean quantity z; group = nation."""
    li = load(spark, d, "lineitem")
    s = load(spark, d, "supplier")
    by = li.groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_extendedprice"), 2).alias("_x"),
        F.round(F.sum("l_discount"), 2).alias("_y"),
        F.round(F.sum("l_quantity"), 2).alias("_z"),
    )
    p = places(spark, d)
    return (
        by.join(s, by.l_suppkey == s.s_suppkey)
        .join(p, F.col("s_nationkey") == p.n_nationkey)
        .select(
            F.col("s_suppkey").alias("id"),
            F.col("unit").alias("grp"),
            "region",
            "n",
            (F.col("_x") / F.col("n")).alias("x"),
            (F.col("_y") / F.col("n")).alias("y"),
            (F.col("_z") / F.col("n")).alias("z"),
        )
    )


SM = """sm AS (
  SELECT s_suppkey AS id, n_name AS grp, r_name AS region, count(*) AS n,
         round(sum(l_extendedprice), 2) / count(*) AS x, round(sum(l_discount), 2) / count(*) AS y,
         round(sum(l_quantity), 2) / count(*) AS z
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""


def supplier_year(spark: SparkSession, d: str) -> DataFrame:
    """Supplier x ship year panel: means of price, discount, tax, quantity."""
    li = load(spark, d, "lineitem")
    by = li.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_extendedprice"), 2).alias("_p"),
        F.round(F.sum("l_discount"), 2).alias("_d"),
        F.round(F.sum("l_tax"), 2).alias("_t"),
        F.round(F.sum("l_quantity"), 2).alias("_q"),
    )
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return by.join(s, by.l_suppkey == s.s_suppkey).select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("cl"),
        "yr",
        "n",
        F.log(F.col("_p") / F.col("n")).alias("y"),
        (F.col("_d") / F.col("n")).alias("disc"),
        (F.col("_t") / F.col("n")).alias("tax"),
        (F.col("_q") / F.col("n")).alias("qty"),
        F.col("s_acctbal").alias("bal"),
    )


SY = """sy AS (
  SELECT s_suppkey AS id, s_nationkey AS cl, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n,
         ln(round(sum(l_extendedprice), 2) / count(*)) AS y, round(sum(l_discount), 2) / count(*) AS disc,
         round(sum(l_tax), 2) / count(*) AS tax, round(sum(l_quantity), 2) / count(*) AS qty, s_acctbal AS bal
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey, s_acctbal, 3)"""


def buildings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as buildings: vintage from size (missing for one type), weight = line items."""
    p, li = load(spark, d, "part"), load(spark, d, "lineitem")
    n = li.groupBy("l_partkey").agg(F.count("*").alias("w"))
    return p.join(n, p.p_partkey == n.l_partkey, "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("area"),
        F.when(F.col("p_type") != "PROMO", 1920 + 2 * F.col("p_size")).alias("vintage"),
        F.coalesce("w", F.lit(0)).alias("w"),
        F.col("p_retailprice").alias("floor_m2"),
        F.col("p_type").alias("kind"),
    )


PB = """pb AS (
  SELECT p_partkey AS id, p_brand AS area, CASE WHEN p_type <> 'PROMO' THEN 1920 + 2 * p_size END AS vintage,
         coalesce(w, 0) AS w, p_retailprice AS floor_m2, p_type AS kind
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS w FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""

# fixed values: construction eras of the examples
ERAS = [(0, 1940, "to_1940"), (1941, 1960, "1941_1960"), (1961, 1980, "1961_1980"), (1981, 2000, "1981_2000"), (2001, 2100, "from_2001")]
ERA_SQL = """CASE WHEN vintage IS NULL THEN 'undated' WHEN vintage <= 1940 THEN 'to_1940' WHEN vintage <= 1960 THEN '1941_1960'
  WHEN vintage <= 1980 THEN '1961_1980' WHEN vintage <= 2000 THEN '1981_2000' ELSE 'from_2001' END"""


def segment_stock(spark: SparkSession, d: str) -> DataFrame:
    """Stock by nation, origin (market segment) and year: orders placed."""
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    cy = customer_year(spark, d)
    by = (
        cy.join(c, cy.o_custkey == c.c_custkey)
        .groupBy("c_nationkey", "c_mktsegment", "yr")
        .agg(F.sum("n").cast("double").alias("stock"))
    )
    p = places(spark, d)
    return by.join(p, by.c_nationkey == p.n_nationkey).select(
        "unit", F.col("c_mktsegment").alias("origin"), "yr", "stock"
    )


ST = """st AS (
  SELECT n_name AS unit, c_mktsegment AS origin, CAST(year(o_orderdate) AS INT) AS yr, CAST(count(*) AS DOUBLE) AS stock
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def user_day(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")
    )


UD = """ud AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"""


def persons(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as persons of a household (order), with weights and a cost."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    lines = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return lines.join(
        o.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"),
        lines.l_orderkey == o.o_orderkey,
    ).select(
        F.col("o_orderkey").alias("hid"),
        F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_linenumber") * 13).alias("age"),
        F.col("l_quantity").alias("wt"),
        F.col("o_totalprice").alias("income"),
        F.col("o_orderpriority").alias("tenure"),
        # monthly cost, absent for one status
        F.when(F.col("o_orderstatus") != "P", F.col("l_extendedprice") / 12).alias("cost"),
        (F.col("l_discount") * 1000).alias("allowance"),
        F.col("l_returnflag").alias("flag"),
    )


PS = """ps AS (
  SELECT o_orderkey AS hid, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber * 13 END AS age, l_quantity AS wt,
         o_totalprice AS income, o_orderpriority AS tenure,
         CASE WHEN o_orderstatus <> 'P' THEN l_extendedprice / 12 END AS cost, l_discount * 1000 AS allowance, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
