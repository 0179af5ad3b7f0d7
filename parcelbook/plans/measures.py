"""Derived-measure queries over nation, month, building and event panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.functions.numbers import ratio
from parcelbook.operators import aggregates as A
from parcelbook.operators import joins as J
from parcelbook.operators import measures as M
from parcelbook.operators import order_stats as Q
from parcelbook.operators import periods as P
from parcelbook.plans import base as B
from parcelbook.plans.registry import query
from parcelbook.session import settle
from parcelbook.sources.tables import load

Spark = SparkSession


@query(
    "m01_territory_dimension",
    """SELECT CASE WHEN c_nationkey IN (5, 6) THEN 'NATION_5+6' ELSE n_name END AS unit, min(r_name) AS region, min(r_name) <> max(r_name) AS name_conflict, count(*) AS customers
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def m01(spark: Spark, d: str) -> DataFrame:
    p = B.places(spark, d)
    n = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    j = n.join(p, n.c_nationkey == p.n_nationkey).withColumn("unit", F.when(F.col("n_nationkey").isin(5, 6), "NATION_5+6").otherwise(F.col("unit")))
    dim = M.dimension_with_check(j, "unit", "region")
    return dim.join(j.groupBy("unit").agg(F.sum("n").alias("customers")), "unit")


@query(
    "m02_stock_pivot",
    """WITH t AS (SELECT c_nationkey AS nation, count(*) FILTER (WHERE o_orderstatus = 'F') AS final, count(*) FILTER (WHERE o_orderstatus <> 'F') AS other, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT *, final + other - total AS gap, TRUE AS adds_up FROM t""",
)
def m02(spark: Spark, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    kinds = F.array(F.lit("total"), F.when(F.col("o_orderstatus") == "F", "final").otherwise("other"))
    per = o.withColumn("kind", F.explode(kinds)).groupBy("o_custkey", "kind").agg(F.count("*").alias("n"))
    long = per.join(c, per.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), "kind").agg(F.sum("n").alias("n"))
    return M.pivot_with_check(long, ["nation"], "kind", ["final", "other"], "total", "n")


@query(
    "m03_size_pivot",
    """WITH h AS (SELECT l_orderkey, count(*) AS s FROM lineitem GROUP BY 1), t AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) FILTER (WHERE s = 1) AS s1, count(*) FILTER (WHERE s = 2) AS s2, count(*) FILTER (WHERE s = 3) AS s3, count(*) FILTER (WHERE s >= 4) AS s4plus, count(*) AS total
    FROM h JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT *, s1 + s2 + s3 + s4plus - total AS gap, TRUE AS adds_up FROM t""",
)
def m03(spark: Spark, d: str) -> DataFrame:
    h = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("s"))
    o = load(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    size = F.when(F.col("s") >= 4, "s4plus").otherwise(F.concat(F.lit("s"), F.col("s").cast("string")))
    long = h.join(o, h.l_orderkey == o.o_orderkey).select("yr", F.explode(F.array(F.lit("total"), size)).alias("kind")).groupBy("yr", "kind").agg(F.count("*").alias("n"))
    return M.pivot_with_check(long, ["yr"], "kind", ["s1", "s2", "s3", "s4plus"], "total", "n")


@query(
    "m04_source_splice",
    f"WITH {B.NY} SELECT unit, yr, CASE WHEN yr < 1998 THEN customers ELSE n_orders END AS value, CASE WHEN yr < 1998 THEN 'census' ELSE 'register' END AS source FROM ny",
)
def m04(spark: Spark, d: str) -> DataFrame:
    value, source = P.splice(F.col("yr"), 1998, F.col("customers"), F.col("n_orders"), ("census", "register"))
    return B.nation_year(spark, d).select("unit", "yr", value.alias("value"), source.alias("source"))


@query(
    "m05_seam_diagnostic",
    f"""WITH {B.NY}, s AS (SELECT unit, 100.0 * (n_orders - customers) / nullif(CAST(customers AS DOUBLE), 0) AS d FROM ny WHERE yr = 1998)
    SELECT arg_max(unit, (abs(d), unit)) AS worst_unit, round(arg_max(d, (abs(d), unit)), 6) AS worst_pct, count(d) AS units FROM s""",
)
def m05(spark: Spark, d: str) -> DataFrame:
    return P.seam(B.nation_year(spark, d), "unit", "yr", 1998, "customers", "n_orders")


@query(
    "m06_series_by_source",
    f"""WITH {B.NY} SELECT unit, yr, CASE WHEN yr = 1995 THEN CAST(customers AS DOUBLE) WHEN yr BETWEEN 1996 AND 1997 THEN CAST(nullif(n_orders, 90) AS DOUBLE) WHEN yr >= 1999 THEN CAST(urgent AS DOUBLE) END AS value,
    CASE WHEN yr = 1995 THEN 'census' WHEN yr BETWEEN 1996 AND 1997 AND n_orders <> 90 THEN 'survey' WHEN yr >= 1999 THEN 'register' END AS source FROM ny""",
)
def m06(spark: Spark, d: str) -> DataFrame:
    y = F.col("yr")
    value, source = M.series_by_source(
        y,
        [
            (y == 1995, F.col("customers").cast("double"), "census"),
            (y.between(1996, 1997), F.nullif(F.col("n_orders"), F.lit(90)).cast("double"), "survey"),
            (y >= 1999, F.col("urgent").cast("double"), "register"),
        ],
    )
    return B.nation_year(spark, d).select("unit", "yr", value.alias("value"), source.alias("source"))


def _unit_mart(spark: Spark, d: str) -> DataFrame:
    """Stock, population, price, sales of suppliers and ratios per unit and year."""
    ny = B.nation_year(spark, d)
    li = load(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    sold = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "yr").agg(F.sum("q").alias("sold_qty"), F.sum("n").alias("sales"))
    p = B.places(spark, d).select("n_nationkey", "unit")
    sold = sold.join(p, sold.s_nationkey == p.n_nationkey).drop("s_nationkey", "n_nationkey")
    return ny.join(sold, ["unit", "yr"], "left")


MART = f"""{B.NY}, sd AS (SELECT n_name AS unit, CAST(year(l_shipdate) AS INT) AS yr, sum(l_quantity) AS sold_qty, count(*) AS sales FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
  mart AS (SELECT ny.*, sold_qty, sales FROM ny LEFT JOIN sd ON ny.unit = sd.unit AND ny.yr = sd.yr)"""


@query(
    "m07_unit_year_mart",
    f"""WITH {MART} SELECT unit, region, yr, n_orders, customers, revenue, round(price, 6) AS price, urgent, round(sold_qty, 6) AS sold_qty, sales,
    round(1000.0 * n_orders / nullif(customers, 0), 6) AS orders_per_1000, round(sold_qty / nullif(CAST(sales AS DOUBLE), 0), 6) AS qty_per_sale FROM mart""",
)
def m07(spark: Spark, d: str) -> DataFrame:
    return M.ratio_set(
        _unit_mart(spark, d), {"orders_per_1000": ("n_orders", "customers", 1000.0), "qty_per_sale": ("sold_qty", "sales", 1.0)}
    )


@query(
    "m08_region_year_mart",
    f"""WITH {B.NY}, i AS (SELECT unit AS region0, region, yr, price FROM ny WHERE unit IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')),
    r AS (SELECT region, yr, CAST(sum(n_orders) AS BIGINT) AS n_orders, CAST(sum(customers) AS BIGINT) AS customers FROM ny GROUP BY 1, 2 UNION ALL SELECT 'ALL', yr, CAST(sum(n_orders) AS BIGINT), CAST(sum(customers) AS BIGINT) FROM ny GROUP BY 2),
    x AS (SELECT r.*, i.price AS price_index, lag(n_orders) OVER (PARTITION BY r.region ORDER BY r.yr) AS p FROM r LEFT JOIN i ON r.region = i.region AND r.yr = i.yr)
    SELECT region, yr, n_orders, customers, round(price_index, 6) AS price_index, round(CAST(n_orders AS DOUBLE) / nullif(customers, 0), 6) AS orders_per_customer, round((n_orders - p) / CAST(p AS DOUBLE) * 100, 6) AS change_pct FROM x""",
)
def m08(spark: Spark, d: str) -> DataFrame:
    ny = settle(B.nation_year(spark, d))
    own = ny.filter(F.col("unit").isin([f"NATION_{i}" for i in range(5)])).select("region", "yr", F.col("price").alias("price_index"))
    mart = M.region_mart(ny, "region", "yr", ["n_orders", "customers"], own, "price_index", "ALL")
    return mart.withColumns(
        {
            "orders_per_customer": ratio(F.col("n_orders"), F.col("customers")),
            "change_pct": P.change(["region"], "yr", "n_orders", "pct"),
        }
    )


@query(
    "m09_ratio_set",
    f"""WITH {MART} SELECT unit, yr, round(1000.0 * sales / nullif(customers, 0), 6) AS sales_per_1000, round(CAST(n_orders AS DOUBLE) / nullif(customers, 0), 6) AS per_customer, round(100.0 * urgent / nullif(n_orders, 0), 6) AS urgent_pct,
    round(100.0 * (n_orders - urgent) / nullif(n_orders, 0), 6) AS other_pct, round(100.0 * sales / nullif(sold_qty, 0), 6) AS sale_pct FROM mart""",
)
def m09(spark: Spark, d: str) -> DataFrame:
    mart = _unit_mart(spark, d).withColumn("other", F.col("n_orders") - F.col("urgent"))
    specs = {
        "sales_per_1000": ("sales", "customers", 1000.0),
        "per_customer": ("n_orders", "customers", 1.0),
        "urgent_pct": ("urgent", "n_orders", 100.0),
        "other_pct": ("other", "n_orders", 100.0),
        "sale_pct": ("sales", "sold_qty", 100.0),
    }
    return M.ratio_set(mart, specs).select("unit", "yr", *specs)


@query(
    "m10_years_of_income",
    f"""WITH {B.NY}, l AS (SELECT *, revenue / customers AS income FROM ny) SELECT a.unit, a.yr, round(a.price / 1000 * 90.0 / nullif(b.income, 0), 6) AS years_of_income FROM l a LEFT JOIN l b ON a.unit = b.unit AND b.yr = a.yr - 1""",
)
def m10(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).withColumns({"income": F.col("revenue") / F.col("customers"), "m2": F.col("price") / 1000})
    return M.income_years(ny, "unit", "yr", "m2", "income").select("unit", "yr", "years_of_income")


@query(
    "m11_real_terms",
    f"""WITH {B.NY}, ix AS (SELECT yr, round(sum(revenue), 2) / sum(n_orders) AS lvl FROM ny GROUP BY 1), r AS (SELECT unit, ny.yr, price * (SELECT lvl FROM ix WHERE yr = 2000) / nullif(lvl, 0) AS real FROM ny JOIN ix ON ny.yr = ix.yr)
    SELECT unit, round(max(real) FILTER (WHERE yr = 1995), 6) AS real_start, round(max(real) FILTER (WHERE yr = 2000), 6) AS real_end, round((max(real) FILTER (WHERE yr = 2000) / max(real) FILTER (WHERE yr = 1995) - 1) * 100, 6) AS real_pct FROM r GROUP BY 1""",
)
def m11(spark: Spark, d: str) -> DataFrame:
    ny = settle(B.nation_year(spark, d))
    index = ny.groupBy("yr").agg((F.round(F.sum("revenue"), 2) / F.sum("n_orders")).alias("lvl"))
    real = ny.join(index, "yr").withColumn("real", P.deflate(ny, "yr", F.col("price"), index, "lvl", 2000))
    return J.endpoint_change(real, ["unit"], "yr", 1995, 2000, ["real"]).select(
        "unit", "real_start", "real_end", ((F.col("real_end") / F.col("real_start") - 1) * 100).alias("real_pct")
    )


@query(
    "m12_mixed_grain_anchors",
    f"""WITH {B.NY}, dt AS (SELECT unit, CASE WHEN unit IN ('NATION_5', 'NATION_6') THEN 'SINGLE_' || unit ELSE region END AS region, CAST(n_orders AS DOUBLE) AS v FROM ny WHERE yr = 1999),
    pub AS (SELECT unit AS label, v FROM dt WHERE unit IN ('NATION_1', 'NATION_2', 'NATION_3') UNION ALL SELECT region, sum(v) + CASE WHEN region = 'ASIA' THEN 5 ELSE 0 END FROM dt GROUP BY region),
    sz AS (SELECT region, count(DISTINCT unit) AS units, min(unit) AS only_unit, sum(v) AS s FROM dt GROUP BY 1)
    SELECT label AS unit, v, 'unit' AS grain, TRUE AS counted, CAST(NULL AS BOOLEAN) AS agrees FROM pub WHERE label IN (SELECT unit FROM dt)
    UNION ALL SELECT only_unit, v, 'single', TRUE, NULL FROM pub JOIN sz ON label = region WHERE units = 1
    UNION ALL SELECT label, v, 'region', FALSE, abs(v - s) <= 1 FROM pub JOIN sz ON label = region WHERE units > 1""",
)
def m12(spark: Spark, d: str) -> DataFrame:
    alone = F.col("unit").isin("NATION_5", "NATION_6")
    detail = settle(B.nation_year(spark, d)).filter("yr = 1999").select(
        "unit", F.when(alone, F.concat(F.lit("SINGLE_"), "unit")).otherwise(F.col("region")).alias("region"), F.col("n_orders").cast("double").alias("v")
    )
    named = detail.filter(F.col("unit").isin("NATION_1", "NATION_2", "NATION_3")).select(F.col("unit").alias("label"), "v")
    sums = detail.groupBy("region").agg(F.sum("v").alias("v")).select(F.col("region").alias("label"), (F.col("v") + F.when(F.col("region") == "ASIA", 5.0).otherwise(0.0)).alias("v"))
    return M.mixed_grain_anchors(detail, named.unionByName(sums), "unit", "region", "v")


@query(
    "m13_section_occupancy",
    """WITH s AS (SELECT o_custkey AS section, count(*) AS homes, count(*) FILTER (WHERE o_orderstatus <> 'P') AS main, count(*) FILTER (WHERE o_orderstatus = 'F') AS rented, sum(CAST(o_totalprice > 250000 AS INT)) + count(*) AS persons FROM orders GROUP BY 1)
    SELECT section, CASE WHEN homes >= 5 THEN round(CAST(persons AS DOUBLE) / homes, 6) END AS persons_per_home, CASE WHEN homes >= 5 THEN round(CAST(main AS DOUBLE) / homes, 6) END AS households_per_home, CASE WHEN homes >= 5 THEN round(CAST(rented AS DOUBLE) / nullif(main, 0), 6) END AS rented_share FROM s""",
)
def m13(spark: Spark, d: str) -> DataFrame:
    s = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("section")).agg(
        F.count("*").alias("homes"),
        F.count_if(F.col("o_orderstatus") != "P").alias("main"),
        F.count_if(F.col("o_orderstatus") == "F").alias("rented"),
        (F.count_if(F.col("o_totalprice") > 250000) + F.count("*")).alias("persons"),
    )
    out = M.occupancy(s.withColumn("hidden", F.col("homes") < 5), "persons", "homes", "main", "rented", "hidden")
    return out.select("section", "persons_per_home", "households_per_home", "rented_share")


@query(
    "m14_rent_to_income",
    """WITH r AS (SELECT o_custkey AS k, median(o_totalprice) AS rent, count(*) AS contracts FROM orders GROUP BY 1) SELECT c_custkey, round(100.0 * 12 * rent / nullif(CASE WHEN c_acctbal > 0 THEN c_acctbal * 1000 END, 0), 6) AS burden_pct, contracts FROM customer LEFT JOIN r ON c_custkey = k""",
)
def m14(spark: Spark, d: str) -> DataFrame:
    rent = Q.quantiles(load(spark, d, "orders"), ["o_custkey"], "o_totalprice", {"rent": Q.rule("averaging")}).withColumnRenamed("total", "contracts")
    c = load(spark, d, "customer")
    income = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 1000)
    return c.join(rent, c.c_custkey == rent.o_custkey, "left").select("c_custkey", M.rent_burden(F.col("rent"), income).alias("burden_pct"), "contracts")


YIELD = """WITH s AS (SELECT l_partkey AS k, round(sum(l_extendedprice), 2) / count(*) AS price, count(*) AS n FROM lineitem GROUP BY 1),
  y AS (SELECT p_brand, p_partkey, 100.0 * (12 * (p_retailprice / 10)) / nullif(price, 0) AS gross, n < 25 AS thin FROM part JOIN s ON p_partkey = k)"""


def _yields(spark: Spark, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").groupBy("l_partkey").agg((F.round(F.sum("l_extendedprice"), 2) / F.count("*")).alias("price"), F.count("*").alias("n"))
    p = load(spark, d, "part")
    return p.join(li, p.p_partkey == li.l_partkey).select(
        "p_brand", "p_partkey", M.gross_yield(F.col("p_retailprice") / 10, F.col("price")).alias("gross"), (F.col("n") < 25).alias("thin")
    )


@query("m15_gross_yield", f"{YIELD} SELECT p_brand, p_partkey, round(gross, 6) AS gross, thin FROM y")
def m15(spark: Spark, d: str) -> DataFrame:
    return _yields(spark, d)


@query(
    "m15_yield_trend",
    f"""{YIELD}, q AS (SELECT p_brand, list_sort(list(gross)) AS v, count(*) AS n FROM y WHERE NOT thin GROUP BY 1) SELECT p_brand, n, round(v[(n - 1) // 2 + 1], 6) AS median_yield, round(v[n // 4 + 1], 6) AS q1, round(v[3 * n // 4 + 1], 6) AS q3 FROM q""",
)
def m15b(spark: Spark, d: str) -> DataFrame:
    y = _yields(spark, d).filter(~F.col("thin"))
    return Q.quantiles(y, ["p_brand"], "gross", {"median_yield": Q.rule("discrete", 0.5), "q1": Q.rule("quarter"), "q3": Q.rule("three")}).withColumnRenamed("total", "n")


@query(
    "m16_absorption",
    f"""WITH {B.NY}, l AS (SELECT *, lag(n_orders) OVER w AS po, lag(customers) OVER w AS pc FROM ny WINDOW w AS (PARTITION BY unit ORDER BY yr))
    SELECT unit, yr, CASE WHEN customers - pc > 0 THEN round(CAST(n_orders - po AS DOUBLE) / (customers - pc), 6) END AS absorption FROM l""",
)
def m16(spark: Spark, d: str) -> DataFrame:
    return B.nation_year(spark, d).select("unit", "yr", M.absorption("unit", "yr", "n_orders", "customers").alias("absorption"))


@query(
    "m17_household_gap",
    f"""WITH {B.NY}, g AS (SELECT unit, max(n_orders) FILTER (WHERE yr = 2000) - max(n_orders) FILTER (WHERE yr = 1996) AS created, sum(nullif(urgent, 17)) FILTER (WHERE yr BETWEEN 1996 AND 1999) AS b, count(nullif(urgent, 17)) FILTER (WHERE yr BETWEEN 1996 AND 1999) AS n FROM ny GROUP BY 1)
    SELECT unit, created, CASE WHEN n = 4 THEN CAST(b AS BIGINT) END AS built, CASE WHEN n = 4 THEN CAST(created - b AS BIGINT) END AS gap FROM g""",
)
def m17(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).withColumn("built", F.nullif(F.col("urgent"), F.lit(17)))
    return M.household_gap(ny, ["unit"], "yr", "n_orders", "built", 1996, 1999)


@query(
    "m18_gap_with_bounds",
    f"""WITH {B.NM}, {B.NY}, c AS (SELECT unit, count(*) AS e, count(v) AS o, sum(v) AS s FROM (SELECT DISTINCT n_name AS unit, m.slot FROM nation, range(13, 61) m(slot)) g LEFT JOIN (SELECT unit, (yr - 1995) * 12 + mo AS slot, nullif(n_orders, 15) AS v FROM nm) USING (unit, slot) GROUP BY 1),
    cr AS (SELECT unit, max(n_orders) FILTER (WHERE yr = 2000) - max(n_orders) FILTER (WHERE yr = 1996) AS created FROM ny GROUP BY 1),
    r AS (SELECT unit, created, e AS cells_expected, o AS cells_observed, CAST(s AS BIGINT) AS observed_sum, CAST(created - s AS BIGINT) AS gap_upper, CASE WHEN e = o THEN CAST(created - s AS BIGINT) END AS gap FROM cr LEFT JOIN c USING (unit))
    SELECT * FROM r UNION ALL SELECT 'ALL', CAST(sum(created) AS BIGINT), CAST(sum(cells_expected) AS BIGINT), CAST(sum(cells_observed) AS BIGINT), CAST(sum(observed_sum) AS BIGINT), CAST(sum(gap_upper) AS BIGINT), CASE WHEN count(gap) = count(*) THEN CAST(sum(gap) AS BIGINT) END FROM r""",
)
def m18(spark: Spark, d: str) -> DataFrame:
    obs = B.nation_month(spark, d).select("unit", ((F.col("yr") - 1995) * 12 + F.col("mo")).alias("slot"), F.nullif(F.col("n_orders"), F.lit(15)).alias("observed_sum"))
    cells = A.coverage_cells(obs, B.places(spark, d), "unit", F.sequence(F.lit(13), F.lit(60)), "slot", "observed_sum").drop("cells_missing")
    created = J.endpoint_change(B.nation_year(spark, d), ["unit"], "yr", 1996, 2000, ["n_orders"]).select("unit", F.col("n_orders_change").alias("created"))
    return M.bounded_gap(cells, created, "unit", "ALL")


@query(
    "m19_payment_scenarios",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 3.0 END AS rate, 60 * (1 + o_orderkey % 4) AS m, o_totalprice / 50 AS i FROM orders),
    s AS (SELECT *, (rate + added_pp) / 1200.0 AS r FROM c CROSS JOIN (VALUES (0, 'chosen'), (1, 'plus_1'), (2, 'plus_2')) t(added_pp, scenario)),
    q AS (SELECT *, CASE WHEN p <= 0 THEN 0 WHEN r = 0 THEN p / m ELSE p * r / (1 - power(1 + r, -m)) END AS pay FROM s)
    SELECT o_orderkey, scenario, added_pp, round(pay, 6) AS payment, round(100.0 * pay / i, 6) AS payment_pct, round(100.0 * (pay + 100) / i, 6) AS debt_pct, round(i - pay - 100, 6) AS after_debt, round(pay * m, 4) AS total_paid, round(greatest(pay * m - p, 0), 4) AS total_interest FROM q""",
)
def m19(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    rows = M.payment_scenarios(
        o.select("o_orderkey", "o_totalprice"),
        F.when(k % 50 == 0, F.lit(0.0)).otherwise(price),
        F.when(k % 3 == 0, 0.0).otherwise(3.0),
        60 * (1 + k % 4),
        price / 50,
        F.lit(100.0),
    ).drop("o_totalprice")
    return rows.withColumns({"total_paid": F.round("total_paid", 4), "total_interest": F.round("total_interest", 4)})


@query(
    "m20_stock_vs_households",
    f"""WITH {B.NY}, e AS (SELECT unit, max(n_orders) FILTER (WHERE yr = 1995) AS s0, max(n_orders) FILTER (WHERE yr = 2000) AS s1, max(customers) FILTER (WHERE yr = 1995) AS h0, max(customers) FILTER (WHERE yr = 2000) AS h1 FROM ny GROUP BY 1)
    SELECT unit, round(100.0 * (CAST(s1 AS DOUBLE) / s0 - CAST(h1 AS DOUBLE) / h0), 6) AS gap_pp FROM e WHERE s0 > 0 AND s1 > 0 AND h0 > 0 AND h1 > 0""",
)
def m20(spark: Spark, d: str) -> DataFrame:
    e = J.endpoint_change(B.nation_year(spark, d), ["unit"], "yr", 1995, 2000, ["n_orders", "customers"])
    ends = ["n_orders_start", "n_orders_end", "customers_start", "customers_end"]
    ok = e.filter(" AND ".join(f"{c} > 0" for c in ends))
    gap = ratio(F.col("n_orders_end"), F.col("n_orders_start")) - ratio(F.col("customers_end"), F.col("customers_start"))
    return ok.select("unit", (100.0 * gap).alias("gap_pp"))


_SH = ", ".join(f"round(100.0 * coalesce(sum(w) FILTER (WHERE {B.ERA_SQL} = '{lab}'), 0) / nullif(sum(w) FILTER (WHERE vintage IS NOT NULL), 0), 6) AS pct_{lab}" for _, _, lab in B.ERAS)


@query(
    "m21_era_profile",
    f"""WITH {B.PB}, u AS (SELECT * FROM pb WHERE w > 0), r AS (SELECT area, median(vintage) AS median_year FROM (SELECT area, vintage, unnest(range(w)) FROM u WHERE vintage IS NOT NULL) GROUP BY 1),
    s AS (SELECT area, CAST(sum(w) AS BIGINT) AS total, CAST(coalesce(sum(w) FILTER (WHERE vintage IS NOT NULL), 0) AS BIGINT) AS dated, round(100.0 * (sum(w) - coalesce(sum(w) FILTER (WHERE vintage IS NOT NULL), 0)) / sum(w), 6) AS missing_pct, {_SH} FROM u GROUP BY 1)
    SELECT s.*, median_year FROM s JOIN r USING (area)""",
)
def m21(spark: Spark, d: str) -> DataFrame:
    return M.era_profile(B.buildings(spark, d), "area", "vintage", "w", B.ERAS)


@query(
    "m22_area_summary",
    f"""WITH {B.PB}, a AS (SELECT area, CAST(1 + CAST(replace(replace(area, 'Brand#', ''), 'Empty#', '') AS INT) AS DOUBLE) AS km2 FROM (SELECT DISTINCT p_brand AS area FROM part UNION SELECT DISTINCT replace(p_brand, 'Brand', 'Empty') FROM part)), r AS (SELECT area, count(*) AS records, sum(w) AS homes, round(sum(floor_m2), 2) AS floor_m2, count(floor_m2) AS with_floor, count(vintage) AS with_year FROM pb GROUP BY 1)
    SELECT a.area, km2, coalesce(records, 0) AS records, CAST(homes AS BIGINT) AS homes, floor_m2, coalesce(with_floor, 0) AS with_floor, coalesce(with_year, 0) AS with_year, round(homes / km2, 6) AS homes_per_km2 FROM a LEFT JOIN r USING (area)""",
)
def m22(spark: Spark, d: str) -> DataFrame:
    # areas with parts, and as many without
    brand = F.col("p_brand")
    names = load(spark, d, "part").select(F.explode(F.array(brand, F.replace(brand, F.lit("Brand"), F.lit("Empty")))).alias("area")).distinct()
    areas = names.withColumn("km2", (1 + F.element_at(F.split("area", "#"), -1).cast("int")).cast("double"))
    records = B.buildings(spark, d)
    out = M.area_summary(areas, records, "area", "km2", "w", "floor_m2", "vintage")
    return out.select("area", "km2", "records", F.col("homes"), F.round("floor_m2", 2).alias("floor_m2"), "with_floor", "with_year", "homes_per_km2")


@query(
    "m23_two_denominators",
    f"""WITH {B.NY}, r AS (SELECT region, (100.0 * urgent / nullif(CAST(n_orders AS DOUBLE), 0)) / nullif(100.0 * urgent / nullif(CAST(customers AS DOUBLE), 0), 0) AS q FROM ny WHERE yr = 1999)
    SELECT region, count(q) AS units, round(median(q), 6) AS ratio_median, round(min(q), 6) AS ratio_min, round(max(q), 6) AS ratio_max FROM r GROUP BY 1""",
)
def m23(spark: Spark, d: str) -> DataFrame:
    return M.aligned_rates(B.nation_year(spark, d).filter("yr = 1999"), ["region"], "urgent", "customers", "n_orders")


@query(
    "m24_vacancy_rollup",
    """SELECT r_name AS region, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS vacant, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS vacant_pct
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def m24(spark: Spark, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("t"), F.count_if(F.col("o_orderstatus") == "P").alias("v"))
    by = per.join(c, per.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum("t").alias("t"), F.sum("v").alias("v"))
    p = B.places(spark, d)
    return by.join(p, by.c_nationkey == p.n_nationkey).groupBy("region").agg(
        F.sum("t").alias("total"), F.sum("v").alias("vacant"), ratio(F.sum("v"), F.sum("t"), scale=100.0).alias("vacant_pct")
    )


@query(
    "m25_rate_per_100k",
    f"""WITH {B.NY}, u AS (SELECT unit, round(100000.0 * urgent / nullif(customers, 0), 6) AS rate FROM ny WHERE yr = 1999 UNION ALL SELECT 'ALL', round(100000.0 * sum(urgent) / sum(customers), 6) FROM ny WHERE yr = 1999)
    SELECT unit, rate FROM u ORDER BY rate DESC, unit LIMIT 10""",
)
def m25(spark: Spark, d: str) -> DataFrame:
    y = settle(B.nation_year(spark, d)).filter("yr = 1999")
    rate = ratio(F.col("urgent"), F.col("customers"), scale=100000.0)
    nat = y.agg(F.sum("urgent").alias("urgent"), F.sum("customers").alias("customers")).withColumn("unit", F.lit("ALL"))
    both = y.select("unit", rate.alias("rate")).unionByName(nat.select("unit", rate.alias("rate")))
    return both.withColumn("rate", F.round("rate", 6)).orderBy(F.desc("rate"), "unit").limit(10)


@query(
    "m26_endpoint_summary",
    f"""WITH {B.NY}, l AS (SELECT unit, yr, 'n_orders' AS metric, CAST(n_orders AS DOUBLE) AS v FROM ny UNION ALL SELECT unit, yr, 'price', price FROM ny), e AS (SELECT metric, unit, min(yr) AS y0, max(yr) AS y1, arg_min(v, yr) AS v0, arg_max(v, yr) AS v1 FROM l WHERE unit IN ('NATION_3', 'NATION_8') GROUP BY 1, 2)
    SELECT a.metric, a.y0 AS y0_a, a.y1 AS y1_a, round(a.v0, 6) AS v0_a, round(a.v1, 6) AS v1_a, b.y0 AS y0_b, b.y1 AS y1_b, round(b.v0, 6) AS v0_b, round(b.v1, 6) AS v1_b, round(100 * (a.v1 - a.v0) / a.v0, 6) AS pct_a, round(100 * (b.v1 - b.v0) / b.v0, 6) AS pct_b,
    round(100 * (a.v1 - a.v0) / a.v0 - 100 * (b.v1 - b.v0) / b.v0, 6) AS pct_difference, round(a.v1 - b.v1, 6) AS last_difference FROM e a JOIN e b ON a.metric = b.metric WHERE a.unit = 'NATION_3' AND b.unit = 'NATION_8'""",
)
def m26(spark: Spark, d: str) -> DataFrame:
    return M.endpoint_summary(B.nation_year(spark, d), "unit", "yr", ["n_orders", "price"], "NATION_3", "NATION_8")


@query(
    "m27_unit_profile",
    """WITH o AS (SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INT) AS yr, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2), u AS (SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INT) AS yr, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
    a AS (SELECT c_custkey, max(yr) AS y, arg_max(v, yr) AS v FROM o GROUP BY 1), b AS (SELECT c_custkey, max(yr) AS y, (SELECT v FROM u u2 WHERE u2.c_custkey = u.c_custkey AND u2.yr = max(u.yr)) AS v FROM u GROUP BY 1)
    SELECT c.c_custkey, 'orders' AS indicator, a.y AS year, a.v AS value, 'count' AS measure, CASE WHEN a.y IS NULL THEN 'no rows for the unit' WHEN a.v IS NULL THEN 'not published in the latest year' END AS reason FROM customer c LEFT JOIN a USING (c_custkey)
    UNION ALL SELECT c.c_custkey, 'urgent', b.y, b.v, 'count', CASE WHEN b.y IS NULL THEN 'no rows for the unit' WHEN b.v IS NULL THEN 'not published in the latest year' END FROM customer c LEFT JOIN b USING (c_custkey)""",
)
def m27(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("yr")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("u")
    )
    return M.unit_profile(load(spark, d, "customer"), "c_custkey", {"orders": (o, "yr", "n", "count"), "urgent": (o, "yr", "u", "count")})


@query(
    "m28_vintage_by_status",
    f"""WITH {B.PB}, t AS (SELECT area, {B.ERA_SQL} AS band, coalesce(sum(w) FILTER (WHERE kind IN ('SMALL', 'MEDIUM', 'PROMO')), 0) AS main, coalesce(sum(w) FILTER (WHERE kind IN ('LARGE', 'STANDARD')), 0) AS second, coalesce(sum(w) FILTER (WHERE kind = 'ECONOMY'), 0) AS empty FROM pb GROUP BY 1, 2)
    SELECT area, band, CAST(main AS BIGINT) AS main, CAST(second AS BIGINT) AS second, CAST(empty AS BIGINT) AS empty, CAST(main + second + empty AS BIGINT) AS stock, round(100.0 * (main + second + empty) / nullif(sum(main + second + empty) OVER (PARTITION BY area), 0), 6) AS band_pct FROM t""",
)
def m28(spark: Spark, d: str) -> DataFrame:
    k = F.col("kind")
    b = B.buildings(spark, d).withColumn("state", F.when(k.isin("SMALL", "MEDIUM", "PROMO"), "main").when(k == "ECONOMY", "empty").otherwise("second"))
    return M.vintage_status(b, ["area"], "vintage", "state", "w", B.ERAS)


@query(
    "m29_group_comparison",
    f"WITH {B.NY} SELECT CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'coast' ELSE 'inland' END AS grp, count(*) AS total, round(median(price), 6) AS median_price FROM ny WHERE yr = 1999 GROUP BY 1",
)
def m29(spark: Spark, d: str) -> DataFrame:
    y = B.nation_year(spark, d).filter("yr = 1999").withColumn("grp", F.when(F.col("region").isin("ASIA", "EUROPE"), "coast").otherwise("inland"))
    return Q.quantiles(y, ["grp"], "price", {"median_price": Q.rule("averaging")})


@query(
    "m30_trajectories",
    f"WITH {B.NY} SELECT unit, yr, n_orders, round(price, 6) AS price FROM ny WHERE unit IN ('NATION_3', 'NATION_8') AND yr BETWEEN 1996 AND 2000",
)
def m30(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).filter(F.col("unit").isin("NATION_3", "NATION_8") & F.col("yr").between(1996, 2000))
    return ny.select("unit", "yr", "n_orders", "price").orderBy("unit", "yr")


@query(
    "m31_net_change_by_origin",
    f"""WITH {B.ST}, t AS (SELECT origin, yr, sum(stock) AS total FROM st GROUP BY 1, 2), l AS (SELECT *, lag(total) OVER w AS p, lag(yr) OVER w AS py FROM t WINDOW w AS (PARTITION BY origin ORDER BY yr)) SELECT origin, yr, total, CASE WHEN yr - py = 1 THEN total - p END AS net FROM l""",
)
def m31(spark: Spark, d: str) -> DataFrame:
    t = B.segment_stock(spark, d).groupBy("origin", "yr").agg(F.sum("stock").alias("total"))
    return t.withColumn("net", P.change(["origin"], "yr", "total", "diff"))


@query(
    "m32_inflow_by_region",
    f"""WITH {B.NY}, t AS (SELECT region, yr, CAST(sum(urgent) AS BIGINT) AS inflow FROM ny GROUP BY 1, 2) SELECT region, yr, inflow, round(100.0 * (inflow - lag(inflow) OVER w) / lag(inflow) OVER w, 6) AS growth_pct FROM t WINDOW w AS (PARTITION BY region ORDER BY yr)""",
)
def m32(spark: Spark, d: str) -> DataFrame:
    t = B.nation_year(spark, d).groupBy("region", "yr").agg(F.sum("urgent").alias("inflow"))
    return t.withColumn("growth_pct", P.change(["region"], "yr", "inflow", "pct"))
