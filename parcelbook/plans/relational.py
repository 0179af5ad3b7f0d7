"""Projections, joins, aggregates, windows, limits and set operations on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelbook.functions.numbers import finite, ratio, whole_or_null
from parcelbook.operators import aggregates as A
from parcelbook.operators import joins as J
from parcelbook.operators import order_stats as Q
from parcelbook.operators import periods as P
from parcelbook.plans import base as B
from parcelbook.plans.registry import query
from parcelbook.session import settle
from parcelbook.sources.tables import compose, constant_rows, load

Spark = SparkSession


# ------------------------------------------------------------------ projections


@query("p01_project_distinct", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def p01(spark: Spark, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()


@query(
    "p02_bound_filter",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 200000
      AND o_orderstatus <> 'P' AND o_orderdate IS NOT NULL AND year(o_orderdate) = 1998""",
)
def p02(spark: Spark, d: str) -> DataFrame:
    return compose(
        spark,
        {"p02_orders": load(spark, d, "orders")},
        """SELECT o_orderkey, o_orderpriority, o_totalprice FROM {p02_orders}
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN :lo AND :hi
          AND o_orderstatus <> 'P' AND o_orderdate >= make_timestamp_ntz(:yr, 1, 1, 0, 0, 0)
          AND o_orderdate < make_timestamp_ntz(:yr + 1, 1, 1, 0, 0, 0)""",
        lo=100000,
        hi=200000,
        yr=1998,
    )


@query(
    "p03_conditionals",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS size_band,
      CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS state, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status_or_none,
      least(o_totalprice, 250000.0) AS capped, greatest(o_totalprice, 50000.0) AS floored FROM orders""",
)
def p03(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return o.select(
        "o_orderkey",
        F.when(price >= 300000, "high").when(price >= 100000, "mid").otherwise("low").alias("size_band"),
        F.when(status == "F", "final").when(status == "O", "open").alias("state"),
        F.coalesce(F.nullif(status, F.lit("P")), F.lit("none")).alias("status_or_none"),
        F.least(price, F.lit(250000.0)).alias("capped"),
        F.greatest(price, F.lit(50000.0)).alias("floored"),
    )


@query(
    "p04_math",
    """SELECT c_custkey, floor(c_acctbal / 100) * 100.0 AS bin, round(abs(c_acctbal), 1) AS size1, round(power(c_acctbal / 1000, 2), 6) AS squared,
      isfinite(c_acctbal) AS is_finite, round(1000.0 / nullif(floor(c_acctbal / 1000), 0), 6) AS safe_ratio FROM customer""",
)
def p04(spark: Spark, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return load(spark, d, "customer").select(
        "c_custkey",
        (F.floor(b / 100) * 100.0).cast("double").alias("bin"),
        F.round(F.abs(b), 1).alias("size1"),
        F.pow(b / 1000, 2).alias("squared"),
        finite(b).alias("is_finite"),
        ratio(F.lit(1000.0), F.floor(b / 1000)).alias("safe_ratio"),
    )


@query(
    "p05_strings",
    """SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS joined, left(c_name, 8) AS head, right(c_name, 4) AS tail,
      lower(c_mktsegment) AS low, upper(left(c_name, 3)) AS up, replace(c_name, '#0', ' ') AS replaced FROM customer""",
)
def p05(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        "c_custkey",
        F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("joined"),
        F.left("c_name", F.lit(8)).alias("head"),
        F.right("c_name", F.lit(4)).alias("tail"),
        F.lower("c_mktsegment").alias("low"),
        F.upper(F.left("c_name", F.lit(3))).alias("up"),
        F.replace("c_name", F.lit("#0"), F.lit(" ")).alias("replaced"),
    )


@query(
    "p06_tolerant_casts",
    """SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_no, TRY_CAST(p_type AS BIGINT) AS type_no,
      CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS whole_price FROM part""",
)
def p06(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "part").select(
        "p_partkey",
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("long").alias("brand_no"),
        F.col("p_type").try_cast("long").alias("type_no"),
        whole_or_null(F.col("p_retailprice")).alias("whole_price"),
    )


@query(
    "p07_validated_cases",
    """SELECT c_custkey, rate, months FROM (SELECT c_custkey, TRY_CAST(CAST(c_acctbal / 1000 AS VARCHAR) AS DOUBLE) AS rate,
      TRY_CAST(right(c_name, 3) AS BIGINT) AS months FROM customer) WHERE rate BETWEEN 0 AND 9 AND months BETWEEN 12 AND 480""",
)
def p07(spark: Spark, d: str) -> DataFrame:
    cases = load(spark, d, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 1000).cast("string").try_cast("double").alias("rate"),
        F.right("c_name", F.lit(3)).try_cast("long").alias("months"),
    )
    return cases.filter(F.col("rate").between(0, 9) & F.col("months").between(12, 480))


@query(
    "p08_named_composition",
    f"WITH {B.NY}, open_years AS (SELECT * FROM ny WHERE yr < 2001) SELECT region, yr, CAST(sum(n_orders) AS BIGINT) AS n_orders FROM open_years GROUP BY 1, 2",
)
def p08(spark: Spark, d: str) -> DataFrame:
    open_years = compose(spark, {"p08_panel": B.nation_year(spark, d)}, "SELECT * FROM {p08_panel} WHERE yr < :last", last=2001)
    return compose(
        spark, {"p08_open": open_years}, "SELECT region, yr, sum(n_orders) AS n_orders FROM {p08_open} GROUP BY region, yr"
    )


# ------------------------------------------------------------------------ joins


@query(
    "j01_inner_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority, l_quantity, l_extendedprice FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey""",
)
def j01(spark: Spark, d: str) -> DataFrame:
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority", "l_quantity", "l_extendedprice")
    )


@query(
    "j02_left_join_on_filter",
    """SELECT c_custkey, count(o_orderkey) AS urgent_orders, round(coalesce(sum(o_totalprice), 0), 2) AS urgent_value
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""",
)
def j02(spark: Spark, d: str) -> DataFrame:
    # the right-hand condition filters orders before they are counted; customers all stay
    o = load(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    c = load(spark, d, "customer").select("c_custkey")
    return c.join(per, c.c_custkey == per.o_custkey, "left").select(
        "c_custkey",
        F.coalesce("n", F.lit(0)).alias("urgent_orders"),
        F.round(F.coalesce("v", F.lit(0.0)), 2).alias("urgent_value"),
    )


@query(
    "j03_full_outer",
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
    b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, a.n AS n_1995, b.n AS n_2000 FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
)
def j03(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")

    def year(y: int) -> DataFrame:
        return o.filter(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("custkey")).agg(
            F.count("*").alias(f"n_{y}")
        )

    return year(1995).join(year(2000), "custkey", "full")


@query(
    "j04_endpoint_change",
    f"""WITH {B.NY} SELECT a.unit, a.n_orders AS n_orders_start, b.n_orders AS n_orders_end, b.n_orders - a.n_orders AS n_orders_change
    FROM ny a JOIN ny b ON a.unit = b.unit AND a.yr = 1995 AND b.yr = 2000""",
)
def j04(spark: Spark, d: str) -> DataFrame:
    return J.endpoint_change(B.nation_year(spark, d), ["unit"], "yr", 1995, 2000, ["n_orders"])


@query(
    "j05_shifted_year_join",
    f"""WITH {B.NY}, y AS (SELECT yr, sum(n_orders) AS n, sum(customers) AS c FROM ny GROUP BY 1)
    SELECT a.yr, CAST(s1.n - s0.n AS BIGINT) AS orders_net, CAST(h1.c - h0.c AS BIGINT) AS customers_net
    FROM range(1996, 2001) t(yr) JOIN y a ON a.yr = t.yr LEFT JOIN y s0 ON s0.yr = a.yr - 1 LEFT JOIN y s1 ON s1.yr = a.yr
    LEFT JOIN y h0 ON h0.yr = a.yr LEFT JOIN y h1 ON h1.yr = a.yr + 1""",
)
def j05(spark: Spark, d: str) -> DataFrame:
    y = B.nation_year(spark, d).groupBy("yr").agg(F.sum("n_orders").alias("n"), F.sum("customers").alias("c"))
    # one row per year of the calendar; shifted lookups are range frames, not joins
    w = Window.orderBy("yr")
    return y.select(
        "yr",
        (F.col("n") - F.max("n").over(w.rangeBetween(-1, -1))).alias("orders_net"),
        (F.max("c").over(w.rangeBetween(1, 1)) - F.col("c")).alias("customers_net"),
    ).filter(F.col("yr").between(1996, 2000))


@query(
    "j06_small_set_product",
    """SELECT c_custkey, scenario, added, round(c_acctbal * (1 + added / 100.0), 6) AS balance FROM customer
    CROSS JOIN (VALUES (0, 'chosen'), (1, 'plus_1'), (2, 'plus_2')) t(added, scenario)""",
)
def j06(spark: Spark, d: str) -> DataFrame:
    rows = constant_rows(
        load(spark, d, "customer").select("c_custkey", "c_acctbal"),
        [(0, "chosen"), (1, "plus_1"), (2, "plus_2")],
        ["added", "scenario"],
    )
    return rows.select(
        "c_custkey", "scenario", "added", (F.col("c_acctbal") * (1 + F.col("added") / 100.0)).alias("balance")
    )


@query(
    "j07_leave_group_out",
    f"""WITH {B.SM}, g AS (SELECT DISTINCT region, grp FROM sm) SELECT g.region, g.grp AS omitted, count(s.id) AS n, CAST(sum(s.n) AS BIGINT) AS line_items
    FROM g LEFT JOIN sm s ON g.region = s.region AND g.grp <> s.grp GROUP BY 1, 2""",
)
def j07(spark: Spark, d: str) -> DataFrame:
    own = B.supplier_means(spark, d).groupBy("region", "grp").agg(F.count("*").alias("n"), F.sum("n").alias("items"))
    rest = A.leave_one_out(own, ["n", "items"], ["region"])
    return rest.select(
        "region", F.col("grp").alias("omitted"), F.col("n_rest").alias("n"), F.when(F.col("n_rest") > 0, F.col("items_rest")).alias("line_items")
    )


@query(
    "j08_computed_flag_join",
    """WITH g(flag, label) AS (VALUES (TRUE, 'with_urgent'), (FALSE, 'without_urgent')),
    c AS (SELECT c_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS u FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT label, count(c_custkey) AS customers, CAST(coalesce(sum(u), 0) AS BIGINT) AS urgent FROM g LEFT JOIN c ON (u IS NOT NULL) = flag GROUP BY 1""",
)
def j08(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.count("*").alias("u"))
    c = load(spark, d, "customer").select("c_custkey")
    flagged = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("u").isNotNull().alias("flag")).agg(
        F.count("*").alias("customers"), F.coalesce(F.sum("u"), F.lit(0)).alias("urgent")
    )
    labels = spark.createDataFrame([(True, "with_urgent"), (False, "without_urgent")], "flag boolean, label string")
    return labels.join(flagged, "flag", "left").select(
        "label", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("urgent", F.lit(0)).alias("urgent")
    )


@query(
    "j09_scalar_subqueries",
    f"""WITH {B.NY}, ok AS (SELECT * FROM ny WHERE yr < (SELECT max(yr) FROM ny))
    SELECT unit, yr, n_orders, (SELECT max(n_orders) FROM ok b WHERE b.unit = a.unit) AS best FROM ok a WHERE yr = (SELECT max(yr) FROM ok)""",
)
def j09(spark: Spark, d: str) -> DataFrame:
    return compose(
        spark,
        {"j09_ny": settle(B.nation_year(spark, d))},
        """WITH ok AS (SELECT * FROM {j09_ny} WHERE yr < (SELECT max(yr) FROM {j09_ny}))
        SELECT unit, yr, n_orders, (SELECT max(n_orders) FROM ok b WHERE b.unit = a.unit) AS best
        FROM ok a WHERE yr = (SELECT max(yr) FROM ok)""",
    )


@query(
    "j10_existence_gate",
    f"""WITH {B.NY} SELECT unit, yr, n_orders FROM ny WHERE EXISTS (SELECT 1 FROM ny WHERE n_orders > 5) AND NOT EXISTS (SELECT 1 FROM ny WHERE n_orders > 1000000000)""",
)
def j10(spark: Spark, d: str) -> DataFrame:
    ny = settle(B.nation_year(spark, d))
    gate = ny.agg((F.coalesce(F.bool_or(F.col("n_orders") > 5), F.lit(False)) & ~F.bool_or(F.col("n_orders") > 1000000000)).alias("g"))
    return ny.filter(gate.scalar()).select("unit", "yr", "n_orders")


@query(
    "j11_membership",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000
    UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996)""",
)
def j11(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter(
        (F.col("o_totalprice") > 400000) | ((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1996))
    )
    c = load(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query(
    "j12_set_difference_guard",
    """SELECT c_custkey AS custkey, 'left' AS only_in FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
    UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE year(o_orderdate) = 1997 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def j12(spark: Spark, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    o = load(spark, d, "orders").filter(F.year("o_orderdate") == 1997).select(F.col("o_custkey").alias("custkey"))
    return J.missing_keys(c, o, "custkey")


# ------------------------------------------------------------------- aggregates


@query(
    "g01_hash_aggregate",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
      min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2""",
)
def g01(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
        F.avg("l_discount").alias("avg_disc"),
    )


@query(
    "g02_conditional_pivot",
    """SELECT c_nationkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS final, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
      round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS pending_value, max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS low_max
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def g02(spark: Spark, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    s = F.col("o_orderstatus")
    per = o.groupBy("o_custkey").agg(
        F.count_if(s == "F").alias("f"),
        F.count_if(s == "O").alias("o"),
        F.sum(F.when(s == "P", F.col("o_totalprice"))).alias("p"),
        F.max(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))).alias("m"),
    )
    return per.join(c, per.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(
        F.sum("f").alias("final"), F.sum("o").alias("open"), F.round(F.sum("p"), 2).alias("pending_value"), F.max("m").alias("low_max")
    )


@query(
    "g03_published_mean",
    f"""WITH {B.NM} SELECT unit, yr, round(round(sum(nullif(n_orders, 5)), 6) / count(nullif(n_orders, 5)), 6) AS mean_orders, count(nullif(n_orders, 5)) AS months
    FROM nm GROUP BY 1, 2""",
)
def g03(spark: Spark, d: str) -> DataFrame:
    mean, n = A.published_mean(F.nullif(F.col("n_orders"), F.lit(5)))
    return B.nation_month(spark, d).groupBy("unit", "yr").agg(mean.alias("mean_orders"), n.alias("months"))


@query(
    "g04_complete_periods",
    f"WITH {B.NM} SELECT unit, yr, CAST(sum(n_orders) AS BIGINT) AS n_orders, count(n_orders) AS periods FROM nm GROUP BY 1, 2 HAVING count(n_orders) = 12",
)
def g04(spark: Spark, d: str) -> DataFrame:
    return A.complete_periods(B.nation_month(spark, d), ["unit", "yr"], "n_orders", 12)


@query(
    "g04_complete_quarters",
    f"""WITH {B.NM} SELECT unit, yr, CAST(ceil(mo / 3.0) AS INT) AS qtr, round(sum(revenue) / count(*), 6) AS revenue, count(revenue) AS periods
    FROM nm GROUP BY 1, 2, 3 HAVING count(revenue) = 3""",
)
def g04q(spark: Spark, d: str) -> DataFrame:
    nm = B.nation_month(spark, d).withColumn("qtr", F.ceil(F.col("mo") / 3.0).cast("int"))
    return A.complete_periods(nm, ["unit", "yr", "qtr"], "revenue", 3, "mean")


@query(
    "g05_closing_value",
    f"""WITH {B.NM}, m AS (SELECT unit, yr, mo, nullif(n_orders, 6) AS v FROM nm)
    SELECT unit, yr, arg_max(v, mo) AS n_orders, max(mo) AS month_used FROM m WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def g05(spark: Spark, d: str) -> DataFrame:
    nm = B.nation_month(spark, d).withColumn("n_orders", F.nullif(F.col("n_orders"), F.lit(6)))
    return A.closing_value(nm, ["unit", "yr"], "mo", "n_orders")


@query(
    "g06_local_aggregates",
    f"""WITH {B.NY} SELECT unit, yr, n_orders FROM ny UNION ALL SELECT 'TOTAL', yr, CAST(sum(n_orders) AS BIGINT) FROM ny GROUP BY yr
    UNION ALL SELECT 'NATION_1+2', yr, CASE WHEN count(*) = 2 THEN CAST(sum(n_orders) AS BIGINT) END FROM ny WHERE unit IN ('NATION_1', 'NATION_2') GROUP BY yr""",
)
def g06(spark: Spark, d: str) -> DataFrame:
    return A.with_local_aggregates(
        settle(B.nation_year(spark, d)), "unit", ["yr"], ["n_orders"], "TOTAL", {"NATION_1+2": ["NATION_1", "NATION_2"]}
    )


@query(
    "g07_recombined_ratio",
    f"WITH {B.NY} SELECT region, yr, round(sum(price * n_orders) / sum(n_orders), 6) AS price, round(sum(urgent) / sum(n_orders), 6) AS urgent_share FROM ny GROUP BY 1, 2",
)
def g07(spark: Spark, d: str) -> DataFrame:
    return B.nation_year(spark, d).groupBy("region", "yr").agg(
        A.recombined_ratio(F.col("price"), F.col("n_orders")).alias("price"),
        (F.sum("urgent") / F.sum("n_orders")).alias("urgent_share"),
    )


@query(
    "g08_all_or_nothing",
    f"""WITH {B.NM}, m AS (SELECT unit, yr, nullif(n_orders, 4) AS v, mo = 12 AND n_orders = 7 AS hidden FROM nm)
    SELECT unit, yr, CASE WHEN count(v) = count(*) AND NOT bool_or(hidden) THEN CAST(sum(v) AS BIGINT) END AS total, count(*) AS children, bool_or(hidden) AS any_hidden FROM m GROUP BY 1, 2""",
)
def g08(spark: Spark, d: str) -> DataFrame:
    m = B.nation_month(spark, d).select(
        "unit", "yr", F.nullif(F.col("n_orders"), F.lit(4)).alias("v"), ((F.col("mo") == 12) & (F.col("n_orders") == 7)).alias("hidden")
    )
    return m.groupBy("unit", "yr").agg(
        A.all_or_nothing(F.col("v"), F.col("hidden")).alias("total"),
        F.count("*").alias("children"),
        F.bool_or("hidden").alias("any_hidden"),
    )


@query(
    "g09_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY 1",
)
def g09(spark: Spark, d: str) -> DataFrame:
    # made distinct at the pair level first, so the part count runs on reduced rows
    pairs = load(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey", "l_suppkey").agg(F.lit(1).alias("one"))
    parts = pairs.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("pairs"))
    return parts.groupBy("l_returnflag").agg(F.count("*").alias("parts"), F.sum("pairs").alias("pairs"))


@query(
    "g10_bool_aggregate",
    "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_final FROM lineitem GROUP BY 1",
)
def g10(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final")
    )


@query(
    "g11_ordered_labels",
    f"WITH {B.NY} SELECT unit, string_agg(DISTINCT CAST(yr AS VARCHAR), ', ' ORDER BY CAST(yr AS VARCHAR)) AS years FROM ny WHERE n_orders >= 80 GROUP BY 1",
)
def g11(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).filter(F.col("n_orders") >= 80)
    return ny.groupBy("unit").agg(A.distinct_text(F.col("yr").cast("string")).alias("years"))


@query(
    "g12_median_and_discrete",
    f"""WITH {B.SM} SELECT region, round(median(x), 6) AS median_x, round(quantile_disc(x, 0.5), 6) AS lower_x, count(*) AS n FROM sm GROUP BY 1""",
)
def g12(spark: Spark, d: str) -> DataFrame:
    return Q.quantiles(
        B.supplier_means(spark, d), ["region"], "x", {"median_x": Q.rule("averaging"), "lower_x": Q.rule("discrete", 0.5)}
    ).withColumnRenamed("total", "n")


@query(
    "g12_median_line_price",
    """SELECT l_returnflag, round(median(l_extendedprice), 6) AS median_price, quantile_disc(l_extendedprice, 0.5) AS lower_price, count(*) AS n
    FROM lineitem GROUP BY 1""",
)
def g12b(spark: Spark, d: str) -> DataFrame:
    return Q.quantiles(
        load(spark, d, "lineitem"),
        ["l_returnflag"],
        "l_extendedprice",
        {"median_price": Q.rule("averaging"), "lower_price": Q.rule("discrete", 0.5)},
    ).withColumnRenamed("total", "n")


@query(
    "g13_index_quantiles",
    """WITH s AS (SELECT c_nationkey AS nation, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1), t AS (SELECT *, len(v) AS n FROM s)
    SELECT nation, n, v[least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) + 1] AS p90, v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3, v[n // 2 + 1] AS upper_mid, v[(n - 1) // 2 + 1] AS lower_mid FROM t""",
)
def g13(spark: Spark, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    wanted = {
        "p90": Q.rule("index", 0.9),
        "q1": Q.rule("quarter"),
        "q3": Q.rule("three"),
        "upper_mid": Q.rule("upper"),
        "lower_mid": Q.rule("lower"),
    }
    return Q.quantiles(c, ["nation"], "c_acctbal", wanted).withColumnRenamed("total", "n")


WEIGHTED = f"""WITH {B.PB}, v AS (SELECT area, vintage, sum(w) AS w FROM pb WHERE w > 0 AND vintage IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT *, sum(w) OVER (PARTITION BY area ORDER BY vintage ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY area) AS tot FROM v)"""


@query(
    "g14_weighted_lower_median",
    f"{WEIGHTED} SELECT area, CAST(min(vintage) FILTER (WHERE 2 * cum >= tot) AS DOUBLE) AS median_vintage, CAST(max(tot) AS BIGINT) AS total FROM c GROUP BY 1",
)
def g14(spark: Spark, d: str) -> DataFrame:
    return Q.quantiles(
        B.buildings(spark, d), ["area"], "vintage", {"median_vintage": Q.rule("discrete", 0.5)}, weight="w"
    )


@query(
    "g15_repeated_median",
    f"""WITH {B.PB}, r AS (SELECT area, vintage, unnest(range(w)) AS k FROM pb WHERE w > 0 AND vintage IS NOT NULL)
    SELECT area, median(vintage) AS median_vintage, count(*) AS total FROM r GROUP BY 1""",
)
def g15(spark: Spark, d: str) -> DataFrame:
    return Q.quantiles(B.buildings(spark, d), ["area"], "vintage", {"median_vintage": Q.rule("averaging")}, weight="w")


@query(
    "g16_weighted_cuts",
    f"""{WEIGHTED}, n AS (SELECT *, lead(vintage) OVER (PARTITION BY area ORDER BY vintage) AS nxt FROM c),
    f AS (SELECT area, q, min(CASE WHEN cum = q * tot AND nxt IS NOT NULL THEN (vintage + nxt) / 2.0 WHEN cum > q * tot OR (cum = q * tot) THEN vintage END) AS cut
      FROM n, (VALUES (0.25), (0.5), (0.75)) t(q) WHERE cum >= q * tot GROUP BY 1, 2)
    SELECT area, CAST(max(cut) FILTER (WHERE q = 0.25) AS DOUBLE) AS c25, CAST(max(cut) FILTER (WHERE q = 0.5) AS DOUBLE) AS c50, CAST(max(cut) FILTER (WHERE q = 0.75) AS DOUBLE) AS c75 FROM f GROUP BY 1""",
)
def g16(spark: Spark, d: str) -> DataFrame:
    return Q.weighted_cuts(
        B.buildings(spark, d), ["area"], "vintage", "w", {"c25": 0.25, "c50": 0.5, "c75": 0.75}
    ).drop("total")


@query(
    "g17_share_of_total",
    """SELECT p_type, count(*) AS n, round(round(sum(p_retailprice), 2) / sum(round(sum(p_retailprice), 2)) OVER (), 6) AS share FROM part GROUP BY 1""",
)
def g17(spark: Spark, d: str) -> DataFrame:
    by = load(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("v"))
    return A.share_of_total(by, "v", "share").drop("v")


@query(
    "g18_guarded_correlation",
    f"""WITH {B.SM} SELECT grp, count(*) AS n, CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS r,
      round(stddev_pop(x), 6) AS spread_x FROM sm GROUP BY 1""",
)
def g18(spark: Spark, d: str) -> DataFrame:
    return B.supplier_means(spark, d).groupBy("grp").agg(
        F.count("*").alias("n"), A.guarded_corr("x", "y").alias("r"), F.stddev_pop("x").alias("spread_x")
    )


@query(
    "g19_single_match_only",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderpriority = '1-URGENT') = 1 THEN max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') END AS urgent_price
    FROM orders GROUP BY 1""",
)
def g19(spark: Spark, d: str) -> DataFrame:
    hit = F.col("o_orderpriority") == "1-URGENT"
    return load(spark, d, "orders").groupBy("o_custkey").agg(A.only_if_single(hit, F.col("o_totalprice")).alias("urgent_price"))


@query(
    "g20_cross_tabulation",
    f"""WITH {B.PB}, t AS (SELECT kind, count(*) FILTER (WHERE w < 25) AS low, count(*) FILTER (WHERE w BETWEEN 25 AND 34) AS mid, count(*) FILTER (WHERE w > 34) AS high FROM pb GROUP BY 1)
    SELECT kind, low, mid, high, low + mid + high AS row_total, round(100.0 * low / nullif(low + mid + high, 0), 6) AS low_row_pct, round(100.0 * low / nullif(sum(low) OVER (), 0), 6) AS low_col_pct,
     round(100.0 * mid / nullif(low + mid + high, 0), 6) AS mid_row_pct, round(100.0 * mid / nullif(sum(mid) OVER (), 0), 6) AS mid_col_pct,
     round(100.0 * high / nullif(low + mid + high, 0), 6) AS high_row_pct, round(100.0 * high / nullif(sum(high) OVER (), 0), 6) AS high_col_pct FROM t""",
)
def g20(spark: Spark, d: str) -> DataFrame:
    b = B.buildings(spark, d).withColumn("use", F.when(F.col("w") < 25, "low").when(F.col("w") < 35, "mid").otherwise("high"))
    return A.cross_tab(b, "kind", "use", ["low", "mid", "high"])


@query(
    "g22_leave_one_out",
    f"""WITH {B.NY}, e AS (SELECT unit, region, max(n_orders) FILTER (WHERE yr = 1995) AS a, max(n_orders) FILTER (WHERE yr = 2000) AS b FROM ny GROUP BY 1, 2),
    t AS (SELECT *, sum(a) OVER (PARTITION BY region) - a AS ar, sum(b) OVER (PARTITION BY region) - b AS br FROM e)
    SELECT region, round(min(100.0 * (br / nullif(ar, 0) - 1)), 6) AS change_min, round(max(100.0 * (br / nullif(ar, 0) - 1)), 6) AS change_max FROM t GROUP BY 1""",
)
def g22(spark: Spark, d: str) -> DataFrame:
    e = J.endpoint_change(B.nation_year(spark, d), ["unit", "region"], "yr", 1995, 2000, ["n_orders"])
    rest = A.leave_one_out(e, ["n_orders_start", "n_orders_end"], ["region"])
    change = 100.0 * (ratio(F.col("n_orders_end_rest"), F.col("n_orders_start_rest")) - 1)
    return rest.groupBy("region").agg(F.min(change).alias("change_min"), F.max(change).alias("change_max"))


@query(
    "g23_share_above",
    "SELECT c_mktsegment, round(100.0 * count(*) FILTER (WHERE c_acctbal >= 5000) / count(*), 6) AS pct_above FROM customer GROUP BY 1",
)
def g23(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(
        (100.0 * F.count_if(F.col("c_acctbal") >= 5000) / F.count("*")).alias("pct_above")
    )


@query(
    "g24_coverage_grid",
    f"""WITH {B.NM}, g AS (SELECT DISTINCT n_name AS unit, m.slot FROM nation, range(1, 85) m(slot)), o AS (SELECT unit, (yr - 1995) * 12 + mo AS slot, nullif(n_orders, 3) AS v FROM nm)
    SELECT g.unit, count(*) AS cells_expected, count(v) AS cells_observed, count(*) - count(v) AS cells_missing, CAST(sum(v) AS BIGINT) AS v FROM g LEFT JOIN o ON g.unit = o.unit AND g.slot = o.slot GROUP BY 1""",
)
def g24(spark: Spark, d: str) -> DataFrame:
    obs = B.nation_month(spark, d).select(
        "unit", ((F.col("yr") - 1995) * 12 + F.col("mo")).alias("slot"), F.nullif(F.col("n_orders"), F.lit(3)).alias("v")
    )
    return A.coverage_cells(obs, B.places(spark, d), "unit", F.sequence(F.lit(1), F.lit(84)), "slot", "v")


# ---------------------------------------------------------------------- windows


@query(
    "w01_latest_row",
    """SELECT o_custkey, CAST(o_orderdate AS VARCHAR)[1:10] AS last_day, o_orderkey, o_totalprice FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def w01(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    last = P.latest_row(o, ["o_custkey"], "at", ["o_totalprice"])
    return last.select(
        "o_custkey", F.date_format("at.o_orderdate", "yyyy-MM-dd").alias("last_day"), F.col("at.o_orderkey").alias("o_orderkey"), "o_totalprice"
    )


@query(
    "w02_average_rank",
    f"""WITH {B.SM} SELECT id, region, rank() OVER (PARTITION BY region ORDER BY y) + (count(*) OVER (PARTITION BY region, y) - 1) / 2.0::DOUBLE AS rank_y,
    rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rank_x FROM sm""",
)
def w02(spark: Spark, d: str) -> DataFrame:
    sm = B.supplier_means(spark, d).select("id", "region", "x", "y")
    both = Q.rank_values(Q.rank_values(sm, ["region"], "y", "rank_y"), [], "x", "rank_x")
    return both.select("id", "region", "rank_y", "rank_x")


@query(
    "w02_rank_order_prices",
    """SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0::DOUBLE AS rank_price FROM orders""",
)
def w02b(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return Q.rank_values(o, ["o_orderpriority"], "o_totalprice", "rank_price").select("o_orderkey", "rank_price")


@query(
    "w03_first_position_rank",
    """SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size)::DOUBLE AS size_rank FROM part""",
)
def w03(spark: Spark, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return Q.rank_values(p, ["p_brand"], "p_size", "size_rank", method="first").select("p_partkey", "size_rank")


@query(
    "w04_mean_subtraction",
    "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS above_mean FROM customer",
)
def w04(spark: Spark, d: str) -> DataFrame:
    from parcelbook.operators.correlation import centred

    c = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return centred(c, ["c_nationkey"], {"above_mean": "c_acctbal"}).select("c_custkey", "above_mean")


@query(
    "w05_running_sum",
    f"WITH {B.NM} SELECT unit, yr, mo, CAST(sum(n_orders) OVER (PARTITION BY unit ORDER BY yr, mo ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock FROM nm",
)
def w05(spark: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("unit").orderBy("yr", "mo").rowsBetween(Window.unboundedPreceding, 0)
    return B.nation_month(spark, d).select("unit", "yr", "mo", F.sum("n_orders").over(w).alias("stock"))


CUST_YEAR = """cy AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INT) AS yr, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
  lg AS (SELECT *, lag(v) OVER w AS pv, lag(yr) OVER w AS py FROM cy WINDOW w AS (PARTITION BY cust ORDER BY yr))"""


def _cust_year(spark: Spark, d: str) -> DataFrame:
    return B.customer_year(spark, d).select(F.col("o_custkey").alias("cust"), "yr", F.round("rev", 2).alias("v"))


@query(
    "w06_consecutive_change",
    f"""WITH {CUST_YEAR} SELECT cust, yr, CASE WHEN yr - py = 1 THEN round((v - pv) / nullif(pv, 0) * 100, 6) END AS pct,
    CASE WHEN yr - py = 1 THEN round(v - pv, 6) END AS diff, CASE WHEN yr - py = 1 THEN round(v / nullif(pv, 0), 6) END AS times FROM lg""",
)
def w06(spark: Spark, d: str) -> DataFrame:
    cy = _cust_year(spark, d)
    return cy.select(
        "cust",
        "yr",
        P.change(["cust"], "yr", "v", "pct").alias("pct"),
        P.change(["cust"], "yr", "v", "diff").alias("diff"),
        P.change(["cust"], "yr", "v", "ratio").alias("times"),
    )


@query(
    "w07_loose_lag",
    f"WITH {CUST_YEAR} SELECT cust, yr, round(v - pv, 6) AS diff FROM lg",
)
def w07(spark: Spark, d: str) -> DataFrame:
    return _cust_year(spark, d).select("cust", "yr", P.change(["cust"], "yr", "v", "diff", strict=False).alias("diff"))


@query(
    "w08_calendar_lags",
    f"""WITH q AS (SELECT o_custkey AS cust, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS slot, count(*) AS v FROM orders GROUP BY 1, 2),
    c AS (SELECT slot, row_number() OVER (ORDER BY slot) AS idx FROM (SELECT DISTINCT slot FROM q)), i AS (SELECT q.cust, q.v, c.idx FROM q JOIN c USING (slot))
    SELECT a.cust, CAST(a.idx AS INT) AS idx, a.v, b.v AS lag1, e.v AS lag4 FROM i a LEFT JOIN i b ON a.cust = b.cust AND b.idx = a.idx - 1 LEFT JOIN i e ON a.cust = e.cust AND e.idx = a.idx - 4""",
)
def w08(spark: Spark, d: str) -> DataFrame:
    slot = (F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")
    q = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust"), slot.alias("slot")).agg(F.count("*").alias("v"))
    return P.calendar_lags(P.calendar_index(q, "slot", "idx"), ["cust"], "idx", "v", [1, 4]).drop("slot")


@query(
    "w09_terciles",
    f"""WITH {B.SM}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY x, id) AS p, count(*) OVER (PARTITION BY region) AS n0 FROM sm)
    SELECT id, region, CASE WHEN p <= n0 // 3 THEN 'lowest' WHEN p > n0 - n0 // 3 THEN 'highest' ELSE 'middle' END AS third FROM r""",
)
def w09(spark: Spark, d: str) -> DataFrame:
    return Q.terciles(B.supplier_means(spark, d).select("id", "region", "x"), ["region"], "x", "id", "third").select(
        "id", "region", "third"
    )


@query(
    "w09_quartile_by_cut",
    f"""WITH v AS (SELECT list_sort(list(p_retailprice)) AS a, count(*) AS n FROM part) SELECT p_partkey, CAST(CASE WHEN p_retailprice <= a[n // 4 + 1] THEN 1
    WHEN p_retailprice <= a[n // 2 + 1] THEN 2 WHEN p_retailprice <= a[3 * n // 4 + 1] THEN 3 ELSE 4 END AS INT) AS quartile FROM part, v""",
)
def w09b(spark: Spark, d: str) -> DataFrame:
    p = load(spark, d, "part")
    cuts = Q.quantiles(p, [], "p_retailprice", {"a": Q.rule("quarter"), "b": Q.rule("upper"), "c": Q.rule("three")})
    three = list(cuts.select("a", "b", "c").first())
    return p.select("p_partkey", Q.group_by_cuts(F.col("p_retailprice"), three).alias("quartile"))


@query(
    "w10_projection_residuals",
    f"""WITH {B.SM}, c AS (SELECT id, grp, x - avg(x) OVER (PARTITION BY grp) AS dx, z - avg(z) OVER (PARTITION BY grp) AS dz FROM sm),
    b AS (SELECT *, sum(dx * dz) OVER (PARTITION BY grp) / nullif(sum(dz * dz) OVER (PARTITION BY grp), 0) AS b FROM c) SELECT id, grp, round(dx - b * dz, 4) AS ex FROM b""",
)
def w10(spark: Spark, d: str) -> DataFrame:
    from parcelbook.operators.correlation import centred

    c = centred(B.supplier_means(spark, d), ["grp"], {"dx": "x", "dz": "z"}).select("id", "grp", "dx", "dz")
    slope = c.groupBy("grp").agg(
        (F.sum(F.col("dx") * F.col("dz")) / F.nullif(F.sum(F.col("dz") * F.col("dz")), F.lit(0.0))).alias("b")
    )
    return c.join(slope, "grp").select("id", "grp", F.round(F.col("dx") - F.col("b") * F.col("dz"), 4).alias("ex"))


@query(
    "w11_peak_then_top",
    f"""WITH {B.ST}, t AS (SELECT origin, yr, sum(stock) AS v FROM st GROUP BY 1, 2), l AS (SELECT *, v - lag(v) OVER (PARTITION BY origin ORDER BY yr) AS net FROM t),
    p AS (SELECT origin, yr, net, row_number() OVER (PARTITION BY origin ORDER BY net DESC, yr) AS rn FROM l WHERE net IS NOT NULL) SELECT origin, yr, net FROM p WHERE rn = 1 ORDER BY net DESC, origin LIMIT 3""",
)
def w11(spark: Spark, d: str) -> DataFrame:
    t = B.segment_stock(spark, d).groupBy("origin", "yr").agg(F.sum("stock").alias("v"))
    net = t.withColumn("net", P.change(["origin"], "yr", "v", "diff"))
    return P.peak(net, ["origin"], "yr", "net").orderBy(F.desc("net"), "origin").limit(3)


@query(
    "w12_month_gaps",
    """WITH m AS (SELECT DISTINCT o_custkey AS cust, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS idx FROM orders),
    l AS (SELECT *, lag(idx) OVER (PARTITION BY cust ORDER BY idx) AS previous_index FROM m) SELECT cust, idx, previous_index FROM l WHERE idx - previous_index <> 1""",
)
def w12(spark: Spark, d: str) -> DataFrame:
    idx = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    m = load(spark, d, "orders").select(F.col("o_custkey").alias("cust"), idx.cast("int").alias("idx")).distinct()
    return P.gaps(m, ["cust"], "idx")


# ------------------------------------------------------------------ order, sets


@query(
    "o01_ordered_nulls_last",
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END, nullif(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_custkey) AS place
    FROM customer""",
)
def o01(spark: Spark, d: str) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    first = F.when(F.col("c_mktsegment") == "MACHINERY", 0).otherwise(1)
    rows = load(spark, d, "customer").select("c_custkey", segment.alias("segment"), first.alias("f"))
    return Q.places(rows, [F.col("f"), F.desc_nulls_last("segment"), F.col("c_custkey")], "place").select("c_custkey", "segment", F.col("place").cast("long").alias("place"))


@query(
    "o02_top_and_bottom",
    """(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
    UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)""",
)
def o02(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).withColumn("side", F.lit("top"))
    low = o.orderBy("o_totalprice", "o_orderkey").limit(5).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


@query(
    "o02_top_per_group",
    """SELECT c_nationkey, c_custkey, c_acctbal, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position <= 5""",
)
def o02b(spark: Spark, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return A.largest(c, ["c_nationkey"], "c_acctbal", "c_custkey", 5)


@query(
    "o03_concentration",
    f"""WITH {B.NY}, g AS (SELECT region, unit, max(n_orders) FILTER (WHERE yr = 2000) - max(n_orders) FILTER (WHERE yr = 1996) AS gap FROM ny GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY gap DESC NULLS LAST, unit) AS rn FROM g)
    SELECT region, CAST(sum(gap) FILTER (WHERE gap > 0) AS BIGINT) AS positive_sum, count(*) FILTER (WHERE gap < 0) AS negative_units, CAST(sum(gap) FILTER (WHERE gap > 0 AND rn <= 2) AS BIGINT) AS top_sum,
      round(sum(gap) FILTER (WHERE gap > 0 AND rn <= 2) / sum(gap) FILTER (WHERE gap > 0), 6) AS top_share FROM r GROUP BY 1""",
)
def o03(spark: Spark, d: str) -> DataFrame:
    e = J.endpoint_change(B.nation_year(spark, d), ["region", "unit"], "yr", 1996, 2000, ["n_orders"])
    return A.concentration(e, ["region"], "n_orders_change", "unit", 2)


@query(
    "o03_concentration_members",
    f"""WITH {B.NY}, g AS (SELECT region, unit, CAST(max(n_orders) FILTER (WHERE yr = 2000) - max(n_orders) FILTER (WHERE yr = 1996) AS BIGINT) AS gap FROM ny GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY gap DESC NULLS LAST, unit) AS rn FROM g)
    SELECT region, unit, gap, CASE WHEN gap > 0 THEN 'top' ELSE 'negative' END AS role FROM r WHERE (gap > 0 AND rn <= 2) OR gap < 0""",
)
def o03b(spark: Spark, d: str) -> DataFrame:
    e = J.endpoint_change(B.nation_year(spark, d), ["region", "unit"], "yr", 1996, 2000, ["n_orders"])
    return A.concentration_members(settle(e.select("region", "unit", F.col("n_orders_change").alias("gap"))), ["region"], "gap", "unit", 2)


@query(
    "u01_stack_measures",
    f"""WITH {B.NY} SELECT unit, yr, 'orders' AS measure, CAST(n_orders AS DOUBLE) AS value FROM ny UNION ALL SELECT unit, yr, 'customers', CAST(customers AS DOUBLE) FROM ny
    UNION ALL SELECT unit, yr, 'price', round(price, 6) FROM ny""",
)
def u01(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).select(
        "unit", "yr", F.col("n_orders").cast("double").alias("orders"), F.col("customers").cast("double").alias("customers"), "price"
    )
    return ny.unpivot(["unit", "yr"], ["orders", "customers", "price"], "measure", "value")


@query(
    "u02_union_distinct",
    "SELECT c_nationkey AS nation, c_acctbal > 5000 AS rich FROM customer UNION SELECT s_nationkey, s_acctbal > 5000 FROM supplier",
)
def u02(spark: Spark, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 5000).alias("rich"))
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 5000).alias("rich"))
    return c.union(s).distinct()


@query(
    "u03_literal_rows",
    f"""WITH k(code, label) AS (VALUES ('1-URGENT', 'urgent'), ('5-LOW', 'low'), ('9-NONE', 'none')) SELECT k.label, count(o_orderkey) AS n FROM k LEFT JOIN orders ON o_orderpriority = k.code GROUP BY 1""",
)
def u03(spark: Spark, d: str) -> DataFrame:
    k = spark.sql("SELECT * FROM VALUES ('1-URGENT', 'urgent'), ('5-LOW', 'low'), ('9-NONE', 'none') AS t(code, label)")
    n = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))
    return k.join(n, "code", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "u04_integer_series",
    """WITH b AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INT) AS a, CAST(max(year(o_orderdate)) AS INT) AS z FROM orders GROUP BY 1) SELECT o_custkey, CAST(unnest(range(a, z)) AS INT) AS yr FROM b""",
)
def u04(spark: Spark, d: str) -> DataFrame:
    b = load(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("z"))
    # half-open range; ``sequence`` would count down, so an empty range is guarded
    return b.filter(F.col("a") < F.col("z")).select("o_custkey", F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("yr"))


@query(
    "u05_key_intersection",
    "SELECT o_custkey AS cust FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000",
)
def u05(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y"))
    return o.filter("y = 1995").select("cust").intersect(o.filter("y = 2000").select("cust"))
