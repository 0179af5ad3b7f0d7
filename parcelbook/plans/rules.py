"""Data-quality rules over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.functions.numbers import finite
from parcelbook.operators import quality as QL
from parcelbook.plans import base as B
from parcelbook.plans.registry import query
from parcelbook.session import settle, spread
from parcelbook.sources import manifest as MF
from parcelbook.sources.tables import load

Spark = SparkSession


@query(
    "q01_additive_identity",
    """WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b, count(*) AS total FROM orders GROUP BY 1) SELECT o_custkey, a, b, total, a + b - total AS gap FROM s WHERE abs(a + b - total) > 3""",
)
def q01(spark: Spark, d: str) -> DataFrame:
    s = load(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"), F.count("*").alias("total")
    )
    return QL.additive_breaks(s, ["a", "b"], "total", 3)


@query(
    "q02_hierarchy",
    f"""WITH {B.NM}, p AS (SELECT region, yr, sum(n_orders) + CASE WHEN region = 'ASIA' AND yr = 1998 THEN 4 WHEN region = 'AFRICA' AND yr = 1996 THEN -2 ELSE 0 END AS published FROM nm GROUP BY 1, 2), l AS (SELECT region, yr, sum(n_orders) AS leaf_sum FROM nm GROUP BY 1, 2)
    SELECT region, yr, CAST(leaf_sum AS BIGINT) AS leaf_sum, CAST(published AS BIGINT) AS published, CAST(leaf_sum - published AS DOUBLE) AS gap FROM l JOIN p USING (region, yr) WHERE leaf_sum <> published AND NOT (region = 'AFRICA' AND yr = 1996)""",
)
def q02(spark: Spark, d: str) -> DataFrame:
    nm = settle(B.nation_month(spark, d))
    off = F.when((F.col("region") == "ASIA") & (F.col("yr") == 1998), 4).when((F.col("region") == "AFRICA") & (F.col("yr") == 1996), -2).otherwise(0)
    published = nm.groupBy("region", "yr").agg(F.sum("n_orders").alias("n")).select("region", "yr", (F.col("n") + off).alias("n_orders"))
    return QL.hierarchy_breaks(nm, published, "region", ["yr"], "n_orders", known=[("AFRICA", 1996)])


@query(
    "q03_grid_completeness",
    f"""WITH {B.UD}, g AS (SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events)) SELECT g.user_id, CAST(g.day AS VARCHAR) AS day FROM g ANTI JOIN ud ON g.user_id = ud.user_id AND g.day = ud.day""",
)
def q03(spark: Spark, d: str) -> DataFrame:
    seen = B.user_day(spark, d).select("user_id", "day")
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    grid = seen.select("user_id").distinct().select("user_id", F.explode(days).alias("day"))
    return QL.missing_cells(grid, seen, ["user_id", "day"]).withColumn("day", F.col("day").cast("string"))


@query(
    "q04_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) = 1 AS identical FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def q04(spark: Spark, d: str) -> DataFrame:
    return QL.duplicate_keys(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query(
    "q05_value_rules",
    """SELECT c_custkey AS id, 'negative_balance' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'over_limit' FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT c_custkey, 'unknown_segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')""",
)
def q05(spark: Spark, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    rules = {
        "not_finite": finite(b),
        "negative_balance": b >= 0,
        "over_limit": b <= 9900,
        "unknown_segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD"),
    }
    return QL.value_rules(load(spark, d, "customer").withColumnRenamed("c_custkey", "id"), "id", rules)


@query("q05_unknown_labels", "SELECT o_orderpriority, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def q05b(spark: Spark, d: str) -> DataFrame:
    return QL.unknown_labels(load(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "q06_base_identity",
    f"""WITH {B.NY}, b AS (SELECT unit, max(price) FILTER (WHERE yr = 1997) AS p FROM ny GROUP BY 1), i AS (SELECT ny.unit, yr, 100 * price / b.p AS idx FROM ny JOIN b ON ny.unit = b.unit) SELECT unit, round(max(idx) FILTER (WHERE yr = 1997), 6) AS base_value, count(idx) AS periods, abs(max(idx) FILTER (WHERE yr = 1997) - 100) <= 1e-9 AS passed FROM i GROUP BY 1""",
)
def q06(spark: Spark, d: str) -> DataFrame:
    ny = settle(B.nation_year(spark, d))
    base = ny.groupBy("unit").agg(F.max(F.when(F.col("yr") == 1997, F.col("price"))).alias("p"))
    idx = ny.join(base, "unit").withColumn("idx", 100 * F.col("price") / F.col("p"))
    at = F.max(F.when(F.col("yr") == 1997, F.col("idx")))
    return idx.groupBy("unit").agg(at.alias("base_value"), F.count("idx").alias("periods"), (F.abs(at - 100) <= 1e-9).alias("passed"))


@query(
    "q07_anchor_gap",
    f"""WITH {B.NY}, g AS (SELECT unit, 100.0 * abs(n_orders - customers) / nullif(CAST(customers AS DOUBLE), 0) AS g FROM ny WHERE yr = 1999) SELECT round(max(g), 6) AS worst_pct, arg_max(unit, (g, unit)) AS worst_unit, count(*) AS covered, max(g) <= 80 AND count(*) = 25 AS passed FROM g""",
)
def q07(spark: Spark, d: str) -> DataFrame:
    y = settle(B.nation_year(spark, d)).filter("yr = 1999")
    return QL.anchor_gap(y.select("unit", F.col("n_orders").alias("v")), y.select("unit", F.col("customers").alias("v")), "unit", "v", 25, 80.0)


@query(
    "q08_headline_agreement",
    """WITH c AS (SELECT 'orders' AS metric, 'status' AS cut, sum(n) AS v FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'orders', 'priority', sum(n) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'orders', 'lines', count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 'parts', 'brand', count(*) FROM part) SELECT metric, count(*) AS sources, CAST(max(v) - min(v) AS BIGINT) AS spread, CASE WHEN count(*) < 2 THEN 'single_source' WHEN max(v) - min(v) > 0.15 THEN 'disagree' ELSE 'ok' END AS verdict FROM c GROUP BY 1""",
)
def q08(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")

    def total(df: DataFrame, metric: str, by: str) -> DataFrame:
        return df.groupBy(by).agg(F.count("*").alias("n")).agg(F.sum("n").alias("v")).withColumn("metric", F.lit(metric))

    lines = load(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("v")).withColumn("metric", F.lit("orders"))
    cuts = total(o, "orders", "o_orderstatus").unionByName(total(o, "orders", "o_orderpriority")).unionByName(lines)
    return QL.headline_agreement(cuts.unionByName(total(load(spark, d, "part"), "parts", "p_brand")), "metric", "v", 0.15)


@query(
    "q09_share_identity",
    f"""WITH s AS (SELECT c_nationkey AS grp, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT grp, CASE WHEN n = 97 THEN NULL ELSE floor(100.0 * n / sum(n) OVER (PARTITION BY grp)) + CASE WHEN grp % 2 = 0 THEN 0 ELSE 0.4 END END AS share FROM s)
    SELECT grp, count(*) AS cells, count(*) - count(share) AS missing, round(sum(share), 6)::DOUBLE AS share_sum, CASE WHEN count(share) < count(*) THEN 'checks_skipped' WHEN abs(sum(share) - 100) > 0.06 * count(*) THEN 'fail' ELSE 'ok' END AS verdict FROM p GROUP BY 1""",
)
def q09(spark: Spark, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    per = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    s = per.join(c, per.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("grp"), "o_orderpriority").agg(F.sum("n").alias("n"))
    t = s.groupBy("grp").agg(F.sum("n").alias("t"))
    share = F.floor(100.0 * F.col("n") / F.col("t")) + F.when(F.col("grp") % 2 == 0, 0.0).otherwise(0.4)
    return QL.share_identity(s.join(t, "grp").withColumn("share", F.when(F.col("n") != 97, share)), ["grp"], "share")


@query(
    "q10_era_completeness",
    f"WITH {B.NY}, v AS (SELECT yr, CASE WHEN yr >= 1998 THEN nullif(n_orders, 90) END AS v FROM ny) SELECT count(*) FILTER (WHERE yr < 1998 AND v IS NOT NULL) AS filled_before, count(*) FILTER (WHERE yr >= 1998 AND v IS NULL) AS empty_after, count(*) FILTER (WHERE (yr < 1998) = (v IS NOT NULL)) = 0 AS passed FROM v",
)
def q10(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).withColumn("v", F.when(F.col("yr") >= 1998, F.nullif(F.col("n_orders"), F.lit(90))))
    return QL.era_completeness(ny, "yr", "v", 1998)


def _claims() -> list[QL.Claim]:
    """Six hundred claims on three tables; some do not hold."""
    out = [
        QL.Claim("priorities", "orders", "count(DISTINCT o_orderpriority)", 5),
        QL.Claim("mean_discount", "lineitem", "avg(l_discount)", 0.05, 0.001),
        QL.Claim("segments", "customer", "count(DISTINCT c_mktsegment)", 6),
        QL.Claim("nothing", "customer", "max(c_acctbal)", 0, 1, "c_nationkey = -1"),
    ]
    for n in range(25):
        out += [QL.Claim(f"customers_{n}_{s}", "customer", "count(*)", 3 * s, 2, f"c_nationkey = {n} AND c_custkey % 8 = {s}") for s in range(8)]
    for status in ("F", "O", "P"):
        out += [QL.Claim(f"price_{status}_{m}", "orders", "avg(o_totalprice)", 250000, 20000, f"o_orderstatus = '{status}' AND month(o_orderdate) = {m} AND o_orderkey % 5 = {k}") for m in range(1, 13) for k in range(5)]
    for yr in range(1995, 2002):
        out += [QL.Claim(f"discount_{yr}_{q}", "lineitem", "avg(l_discount)", 0.05, 0.002, f"year(l_shipdate) = {yr} AND l_quantity = {q}") for q in range(1, 32)]
    return out


def _claim_sql(c: QL.Claim) -> str:
    found = f"{c.aggregate}{f' FILTER (WHERE {c.where})' if c.where else ''}::DOUBLE"
    return f"SELECT '{c.label}' AS label, {float(c.expected)}::DOUBLE AS expected, {found} AS found, {float(c.tol)}::DOUBLE AS tol FROM {c.source}"


@query("q11_claim_audit", f"SELECT label, expected, round(found, 6) AS found, tol, CASE WHEN abs(found - expected) <= tol THEN 'ok' ELSE 'fail' END AS verdict FROM ({' UNION ALL '.join(map(_claim_sql, _claims()))})")
def q11(spark: Spark, d: str) -> DataFrame:
    return QL.check_claims({name: load(spark, d, name) for name in ("orders", "lineitem", "customer")}, _claims())


@query("q12_freshness_key", "SELECT * FROM (VALUES ('nation_year', 0::BIGINT, 2::BIGINT, 'fresh'), ('era_profile', 1::BIGINT, 1::BIGINT, 'stale')) AS t(output, changed_inputs, inputs, state)")
def q12(spark: Spark, d: str) -> DataFrame:
    """Two outputs stamped with input hashes, one of them before an input changed."""
    paths = [f"{d}/{t}.parquet" for t in ("orders", "customer", "part")]
    part = F.col("file") == "part.parquet"
    stamped = F.when(part, F.reverse("sha256")).otherwise(F.col("sha256"))
    stamps = MF.by_source(MF.pins_of(spark, paths)).select(F.when(part, "era_profile").otherwise("nation_year").alias("output"), "file", stamped.alias("sha256"))
    return MF.stale_outputs(stamps, MF.by_source(MF.file_hashes(spark, paths)))


@query(
    "q13_exact_recompute",
    f"""WITH {B.NY}, a AS (SELECT unit, yr, CASE WHEN yr = 1999 AND unit = 'NATION_4' THEN n_orders + 1 ELSE n_orders END AS n_orders FROM ny), b AS (SELECT unit, yr, n_orders FROM ny) SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'fresh' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def q13(spark: Spark, d: str) -> DataFrame:
    fresh = settle(B.nation_year(spark, d)).select("unit", "yr", "n_orders")
    changed = F.when((F.col("yr") == 1999) & (F.col("unit") == "NATION_4"), F.col("n_orders") + 1).otherwise(F.col("n_orders"))
    return QL.table_difference(fresh.withColumn("n_orders", changed), fresh)


#: Numbers that texts may state without a claim.
ALLOWED = [99.0, 4711.0]


@query(
    "q14_numbers_in_text",
    rf"""WITH p AS (SELECT doc_id, array_to_string(list_filter(str_split(text, '`'), lambda x, i: i % 2 = 1), ' ') AS t FROM documents),
    w AS (SELECT doc_id, unnest(str_split_regex(translate(regexp_replace(t, '(^|\n)[ \t]*[0-9]+[.][ \t]+', ' ', 'g'), '{QL._MARKS[0]}', '{QL._MARKS[1]}'), '\s+')) AS w FROM p),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(w, '{QL._OPEN.replace("'", "''")}', ''), '{QL._CLOSE.replace("'", "''")}', '') AS w FROM w WHERE instr(w, '://') = 0),
    e AS (SELECT doc_id, unnest(CASE WHEN regexp_matches(w, '{QL._DATE}') THEN [] WHEN regexp_matches(w, '{QL._RANGE}') THEN list_filter(str_split(w, '-'), lambda x: x <> '') ELSE [w] END) AS t FROM c),
    n AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '{QL._GROUPED}') THEN replace(regexp_replace(t, '[kM%y]$', ''), ',', '') WHEN regexp_matches(t, '{QL._PLAIN}') THEN regexp_replace(t, '[kM%y]$', '')
      WHEN regexp_matches(t, '{QL._COMMA}') THEN replace(regexp_replace(t, '[kM%y]$', ''), ',', '.') END AS d, CASE right(t, 1) WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 ELSE 1.0 END AS s FROM e),
    v AS (SELECT doc_id, try_cast(d AS DOUBLE) * s AS value, 0.5 * pow(10.0, -(CASE WHEN instr(d, '.') > 0 THEN length(d) - instr(d, '.') ELSE 0 END)) * s AS slack FROM n WHERE d IS NOT NULL AND NOT regexp_matches(t, '^[+-]?[0-9]$') AND NOT regexp_matches(t, '^[+-]?[0-9]+y$'))
    SELECT doc_id, count(*) AS unmatched, round(sum(log10(1 + abs(value))), 4) AS log_sum FROM v WHERE value IS NOT NULL AND NOT (value = floor(value) AND value BETWEEN 1990 AND 2030) AND abs(value - {ALLOWED[0]}) > 1e-9 AND abs(value - {ALLOWED[1]}) > 1e-9
      AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_size * 1.0 AS claim FROM part) k WHERE abs(value - claim) <= 0.05 + slack) GROUP BY 1""",
)
def q14(spark: Spark, d: str) -> DataFrame:
    """Numbers of whole documents that match no claim (claims: catalogue sizes) and are not allowed."""
    # numbers are few next to the texts: extract once, then probe
    numbers = settle(QL.text_numbers(spread(load(spark, d, "documents")), ["doc_id"], "text"))
    claims = load(spark, d, "part").select((F.col("p_size") * 1.0).alias("claim"), F.lit(0.05).alias("tol")).distinct()
    return QL.unexplained(numbers, claims, ALLOWED).groupBy("doc_id").agg(F.count("*").alias("unmatched"), F.round(F.sum(F.log10(1 + F.abs("value"))), 4).alias("log_sum"))


@query(
    "q15_coverage_report",
    f"""WITH {B.NY} SELECT 'panel' AS table_name, count(*) AS rows, min(yr) AS first_year, max(yr) AS last_year, count(*) - count(nullif(n_orders, 90)) AS nulls FROM ny
    UNION ALL SELECT 'orders', count(*), CAST(min(year(o_orderdate)) AS INT), CAST(max(year(o_orderdate)) AS INT), count(*) - count(o_totalprice) FROM orders
    UNION ALL SELECT 'lineitem', count(*), CAST(min(year(l_shipdate)) AS INT), CAST(max(year(l_shipdate)) AS INT), count(*) - count(l_quantity) FROM lineitem""",
)
def q15(spark: Spark, d: str) -> DataFrame:
    ny = B.nation_year(spark, d).withColumn("n", F.nullif(F.col("n_orders"), F.lit(90)))
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("yr"), "o_totalprice")
    li = load(spark, d, "lineitem").select(F.year("l_shipdate").alias("yr"), "l_quantity")
    return QL.coverage_report({"panel": (ny, "yr", ["n"]), "orders": (o, "yr", ["o_totalprice"]), "lineitem": (li, "yr", ["l_quantity"])})
