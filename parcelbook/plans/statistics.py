"""Correlations, regressions, instruments, bootstraps, shift-share and survey cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.functions import buckets as BK
from parcelbook.functions.numbers import ratio
from parcelbook.operators import aggregates as A
from parcelbook.operators import bootstrap as BS
from parcelbook.operators import correlation as C
from parcelbook.operators import joins as J
from parcelbook.operators import periods as P
from parcelbook.operators import regression as R
from parcelbook.operators import shiftshare as SS
from parcelbook.operators import survey as V
from parcelbook.plans import base as B
from parcelbook.plans import panel_sql as PS
from parcelbook.plans.registry import query
from parcelbook.session import settle
from parcelbook.sources.tables import load

Spark = SparkSession


def rank_sql(by: str, col: str) -> str:
    p = f"PARTITION BY {by}" if by else ""
    sep = f"{by}, " if by else ""
    return f"(rank() OVER ({p} ORDER BY {col}) + (count(*) OVER (PARTITION BY {sep}{col}) - 1) / 2.0)::DOUBLE"


def corr_sql(x: str, y: str, least: int = 2) -> str:
    return f"CASE WHEN count(*) >= {least} AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN round(corr({x}, {y}), 6) END"


# ------------------------------------------------------------------ correlation


@query("e01_pearson", f"WITH {B.SM} SELECT region, count(*) AS n, {corr_sql('x', 'y', 3)} AS r FROM sm GROUP BY 1")
def e01(spark: Spark, d: str) -> DataFrame:
    return B.supplier_means(spark, d).groupBy("region").agg(F.count("*").alias("n"), A.guarded_corr("x", "y", 3).alias("r"))


@query(
    "e02_spearman",
    f"WITH {B.SM}, r AS (SELECT region, {rank_sql('region', 'x')} AS rx, {rank_sql('region', 'y')} AS ry FROM sm) SELECT region, count(*) AS n, {corr_sql('rx', 'ry', 3)} AS spearman FROM r GROUP BY 1",
)
def e02(spark: Spark, d: str) -> DataFrame:
    return C.spearman(B.supplier_means(spark, d), ["region"], "x", "y")


@query(
    "e03_fisher_interval",
    f"""WITH {B.SM}, c AS (SELECT region, count(*) AS n, {corr_sql('x', 'y', 3)} AS r FROM sm GROUP BY 1)
    SELECT region, n, CASE WHEN n >= 4 AND abs(r) < 1 THEN round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) END AS lo, CASE WHEN n >= 4 AND abs(r) < 1 THEN round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) END AS hi,
    CASE WHEN abs(r) < 1 AND n > 2 THEN round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) END AS t FROM c""",
)
def e03(spark: Spark, d: str) -> DataFrame:
    c = B.supplier_means(spark, d).groupBy("region").agg(F.count("*").alias("n"), F.round(A.guarded_corr("x", "y", 3), 6).alias("r"))
    lo, hi = C.fisher_interval(F.col("r"), F.col("n"))
    return c.select("region", "n", lo.alias("lo"), hi.alias("hi"), C.t_of_correlation(F.col("r"), F.col("n")).alias("t"))


WINDOWS = [(1995, 1997), (1997, 2000), (1995, 2000)]


@query(
    "e04_windowed_correlations",
    f"""WITH {B.NY}, w(a, z) AS (VALUES (1995, 1997), (1997, 2000), (1995, 2000)), c AS (SELECT a, z, unit, max(n_orders) FILTER (WHERE yr = a) AS o0, max(n_orders) FILTER (WHERE yr = z) AS o1, max(price) FILTER (WHERE yr = a) AS p0, max(price) FILTER (WHERE yr = z) AS p1 FROM ny JOIN w ON yr IN (a, z) GROUP BY 1, 2, 3),
    g AS (SELECT CAST(a AS VARCHAR) || '-' || CAST(z AS VARCHAR) AS win, (o1 - o0) / CAST(o0 AS DOUBLE) * 100 AS x, (p1 - p0) / p0 * 100 AS y FROM c UNION ALL SELECT 'pooled', (o1 - o0) / CAST(o0 AS DOUBLE) * 100, (p1 - p0) / p0 * 100 FROM c),
    r AS (SELECT *, {rank_sql('win', 'x')} AS rx, {rank_sql('win', 'y')} AS ry FROM g) SELECT win, count(*) AS n, {corr_sql('x', 'y', 3)} AS pearson, {corr_sql('rx', 'ry', 3)} AS spearman FROM r GROUP BY 1""",
)
def e04(spark: Spark, d: str) -> DataFrame:
    changes = C.windowed_changes(settle(B.nation_year(spark, d)), ["unit"], "yr", ["n_orders", "price"], WINDOWS)
    label = F.concat_ws("-", F.col("w_start").cast("string"), F.col("w_end").cast("string"))
    both = changes.withColumn("win", F.explode(F.array(label, F.lit("pooled"))))
    pearson = both.groupBy("win").agg(A.guarded_corr("n_orders_pct", "price_pct", 3).alias("pearson"))
    return C.spearman(both, ["win"], "n_orders_pct", "price_pct").join(pearson, "win")


CENTRED = f"""{B.SM}, r AS (SELECT *, {rank_sql('', 'x')} AS rx, {rank_sql('', 'y')} AS ry, {rank_sql('', 'z')} AS rz FROM sm),
  c AS (SELECT *, rx - avg(rx) OVER g AS dx, ry - avg(ry) OVER g AS dy, rz - avg(rz) OVER g AS dz, count(*) OVER g AS ng FROM r WINDOW g AS (PARTITION BY grp))"""


@query(
    "e05_group_centred_ranks",
    f"WITH {CENTRED} SELECT count(*) AS n, count(DISTINCT grp) AS groups, count(*) FILTER (WHERE ng = 1) AS singletons, {corr_sql('x', 'y')} AS pearson, {corr_sql('rx', 'ry')} AS spearman, {corr_sql('dx', 'dy')} AS centred FROM c",
)
def e05(spark: Spark, d: str) -> DataFrame:
    return C.group_centred(B.supplier_means(spark, d), [], "grp", "x", "y")


@query(
    "e06_partial_rank",
    f"""WITH {CENTRED}, p AS (SELECT *, sum(dx * dz) OVER () / sum(dz * dz) OVER () AS bx, sum(dy * dz) OVER () / sum(dz * dz) OVER () AS byy FROM c), e AS (SELECT *, dx - bx * dz AS ex, dy - byy * dz AS ey FROM p)
    SELECT count(*) AS n, count(DISTINCT grp) AS groups, {corr_sql('rx', 'ry')} AS spearman, {corr_sql('dx', 'dy')} AS centred, round(corr(ex, ey), 6) AS partial, 'descriptive' AS state FROM e""",
)
def e06(spark: Spark, d: str) -> DataFrame:
    return C.partial_rank(B.supplier_means(spark, d), [], "grp", "x", "y", "z")


@query(
    "e07_omit_group_spearman",
    f"""WITH {B.SM}, g AS (SELECT DISTINCT region, grp AS omitted FROM sm), s AS (SELECT g.region, g.omitted, x, y FROM g LEFT JOIN sm ON g.region = sm.region AND g.omitted <> sm.grp), r AS (SELECT *, {rank_sql('region, omitted', 'x')} AS rx, {rank_sql('region, omitted', 'y')} AS ry FROM s)
    SELECT region, omitted, count(x) AS n, {corr_sql('rx', 'ry')} AS spearman FROM r GROUP BY 1, 2""",
)
def e07(spark: Spark, d: str) -> DataFrame:
    """Rank correlations without one nation at a time; no row is repeated."""
    return C.omission_spearman(B.supplier_means(spark, d), ["region"], "grp", "omitted", "x", "y")


@query(
    "e07_omit_region_partial",
    f"""WITH {B.SM}, g AS (SELECT DISTINCT region AS omitted FROM sm), s AS (SELECT g.omitted, sm.* FROM g JOIN sm ON g.omitted <> sm.region), r AS (SELECT *, {rank_sql('omitted', 'x')} AS rx, {rank_sql('omitted', 'y')} AS ry, {rank_sql('omitted', 'z')} AS rz FROM s),
    c AS (SELECT *, rx - avg(rx) OVER w AS dx, ry - avg(ry) OVER w AS dy, rz - avg(rz) OVER w AS dz FROM r WINDOW w AS (PARTITION BY omitted, grp)), b AS (SELECT *, sum(dx * dz) OVER o / sum(dz * dz) OVER o AS bx, sum(dy * dz) OVER o / sum(dz * dz) OVER o AS byy FROM c WINDOW o AS (PARTITION BY omitted))
    SELECT omitted, count(*) AS n, round(corr(dx - bx * dz, dy - byy * dz), 6) AS partial FROM b GROUP BY 1""",
)
def e07b(spark: Spark, d: str) -> DataFrame:
    return C.omission_partial(B.supplier_means(spark, d), [], "region", "omitted", "grp", "x", "y", "z")


@query(
    "e08_unit_demeaning",
    f"WITH {B.SY} SELECT id, yr, round(y - avg(y) OVER w, 6) AS y, round(disc - avg(disc) OVER w, 6) AS disc FROM sy WINDOW w AS (PARTITION BY id)",
)
def e08(spark: Spark, d: str) -> DataFrame:
    return R.demean(B.supplier_year(spark, d).select("id", "yr", "y", "disc"), "id", ["y", "disc"])


@query(
    "e09_two_way_within",
    f"""WITH {B.SY}, u AS (SELECT * FROM sy WHERE NOT (id % 7 = 3 AND yr = 1998)) SELECT id, yr, round(y - avg(y) OVER w, 6) AS y, round((yr = 1996)::INT - avg((yr = 1996)::INT) OVER w, 6) AS d1996, round((yr = 2001)::INT - avg((yr = 2001)::INT) OVER w, 6) AS d2001 FROM u WINDOW w AS (PARTITION BY id)""",
)
def e09(spark: Spark, d: str) -> DataFrame:
    # an unbalanced panel: some unit-years are absent
    sy = B.supplier_year(spark, d).filter(~((F.col("id") % 7 == 3) & (F.col("yr") == 1998)))
    out, dummies = R.within(sy.select("id", "yr", "y"), "id", ["yr"], ["y"])
    return out.select("id", "yr", "y", F.col(dummies[0]).alias("d1996"), F.col(dummies[-1]).alias("d2001"))


# ------------------------------------------------------------------- regression

ONE_REG = f"""{B.SY}, m AS (SELECT id, cl, y - avg(y) OVER w AS yy, disc - avg(disc) OVER w AS x, tax - avg(tax) OVER w AS z FROM sy WINDOW w AS (PARTITION BY id)),
  k AS (SELECT count(*) AS n, count(DISTINCT cl) AS g, sum(x * yy) / sum(x * x) AS b, sum(x * x) AS xx, sum(z * x) AS zx, sum(z * yy) / sum(z * x) AS tau, sum(z * z) AS zz, sum(z * x) / sum(z * z) AS pi, sum(z * yy) / sum(z * z) AS rf FROM m),
  f AS (SELECT *, g / (g - 1.0) * (n - 1.0) / (n - 1) AS cc FROM k)"""


def _one_regressor(spark: Spark, d: str) -> R.Moments:
    sy = R.demean(B.supplier_year(spark, d).select("id", "cl", "y", "disc", "tax"), "id", ["y", "disc", "tax"])
    return R.cluster_moments(sy, ["y", "disc", "tax"], "cl")


@query(
    "e10_clustered_ols",
    f"""WITH {ONE_REG}, s AS (SELECT cl, sum(x * (yy - b * x)) AS s FROM m, f GROUP BY 1) SELECT 'disc' AS term, round(max(b), 6) AS b, round(sqrt(sum(s * s) * max(cc)) / max(xx), 6) AS se, CAST(max(n) AS BIGINT) AS n, CAST(max(g) AS BIGINT) AS clusters FROM s, f""",
)
def e10(spark: Spark, d: str) -> DataFrame:
    m = _one_regressor(spark, d)
    return R.coefficient_table(m, R.ols(m, ["disc"], "y"), ["disc"]).select("term", "b", "se", "n", "clusters")


SUPPLIER_LAGS = f"{B.SY}, lg AS MATERIALIZED (SELECT *, lag(disc) OVER w AS l_disc, lag(qty) OVER w AS l_qty FROM sy WINDOW w AS (PARTITION BY id ORDER BY yr))"
E11 = {"s0": ["disc"], "s1": ["disc", "tax", "qty"], "s2": ["disc", "tax", "qty", "l_disc", "l_qty"], "s3": ["disc", "l_disc"]}


def fits_sql(head: str, fits: list[tuple[str, str, list[str], list[str], dict, str]]) -> str:
    """SQL of two-way fits: (name, sample, regressors, carried columns, periods, trend) each."""
    ctes, selects = [head], []
    for name, sample, regressors, keys, periods, trend in fits:
        ctes.append(f"{name}x AS MATERIALIZED ({sample})")
        within, dummies = PS.within(f"{name}w", f"{name}x", keys[0], ["cl"], ["y", *regressors], periods, trend)
        extra = f"(SELECT count(DISTINCT {keys[0]}) FROM {name}x)" if trend else "0"
        body, select = PS.fit(name, f"{name}w", "y", regressors, dummies, regressors, extra, name)
        ctes += [within, body]
        selects.append(select)
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(selects)}"


@query(
    "e11_panel_specifications",
    fits_sql(SUPPLIER_LAGS, [(s, f"SELECT * FROM lg WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ['y', *regs])}", regs, ["id"], {"yr": (PS.YEARS, 1)}, "") for s, regs in E11.items()]),
)
def e11(spark: Spark, d: str) -> DataFrame:
    """Four specifications with controls and lags, each on its own complete cases, from one pass."""
    sy = B.supplier_year(spark, d)
    lags = sy.withColumns({f"l_{v}": P.previous(["id"], "yr", v, strict=False) for v in ("disc", "qty")})
    return R.panel_fits(lags, "id", ["yr"], "cl", [R.Spec(s, "y", regs) for s, regs in E11.items()])


@query(
    "e12_two_dummy_sets",
    fits_sql(
        "pa AS MATERIALIZED (SELECT l_suppkey AS id, any_value(s_nationkey) AS cl, CAST(year(l_shipdate) AS INT) AS yr, CAST(quarter(l_shipdate) AS INT) AS q, ln(avg(l_extendedprice)) AS y, avg(l_discount) AS disc, avg(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 3, 4)",
        [("quarterly", "SELECT * FROM pa", ["disc", "qty"], ["id"], {"yr": (PS.YEARS, 1), "q": (range(1, 5), 1)}, "")],
    ),
)
def e12(spark: Spark, d: str) -> DataFrame:
    """Quarterly panel with year and season dummies, both demeaned by unit."""
    li = load(spark, d, "lineitem")
    by = li.groupBy("l_suppkey", F.year("l_shipdate").alias("yr"), F.quarter("l_shipdate").alias("q")).agg(
        F.log(F.avg("l_extendedprice")).alias("y"), F.avg("l_discount").alias("disc"), F.avg("l_quantity").alias("qty")
    )
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cl"))
    panel = by.join(s, by.l_suppkey == s.s_suppkey)
    return R.panel_fit(panel, "y", ["disc", "qty"], "l_suppkey", ["yr", "q"], "cl", spec="quarterly")


_E13_NAMES, _E13_MARKS = PS.marks({"yr": (PS.YEARS, 1)}, "sy")
_E13_BODY, _E13_SELECT = PS.fit("f", "x", "y", ["disc10", "_const"], _E13_NAMES, ["disc10", "_const"])


@query("e13_cross_section_year_effects", f"WITH {B.SY}, x AS MATERIALIZED (SELECT cl, y, disc / 0.1 AS disc10, 1.0::DOUBLE AS _const, {_E13_MARKS} FROM sy), {_E13_BODY} {_E13_SELECT}")
def e13(spark: Spark, d: str) -> DataFrame:
    """Regressor per 0.1 with constant and year effects, no unit effects."""
    sy = settle(B.supplier_year(spark, d)).withColumn("disc10", F.col("disc") / 0.1)
    design, extra = R.year_effects(sy, "yr")
    m = R.cluster_moments(design, ["disc10", *extra, "y"], "cl")
    return R.coefficient_table(m, R.ols(m, ["disc10", *extra], "y"), ["disc10", "_const"])


@query(
    "e14_trends_and_interaction",
    fits_sql(
        f"{B.SY}, si AS MATERIALIZED (SELECT *, disc * bal / 1000 AS disc_x_bal FROM sy)",
        [
            ("trends", "SELECT * FROM si", ["disc"], ["id"], {"yr": (PS.YEARS, 2)}, "yr"),
            ("interaction", "SELECT * FROM si", ["disc", "disc_x_bal"], ["id"], {"yr": (PS.YEARS, 1)}, ""),
            ("drop_two", "SELECT * FROM si WHERE cl NOT IN (3, 7)", ["disc"], ["id"], {"yr": (PS.YEARS, 1)}, ""),
            ("late", "SELECT * FROM si WHERE yr >= 1998", ["disc"], ["id"], {"yr": (PS.YEARS, 1)}, ""),
        ],
    ),
)
def e14(spark: Spark, d: str) -> DataFrame:
    """Unit trends, an interaction, a sample without two clusters and a sub-period, from one pass."""
    sy = B.supplier_year(spark, d).withColumn("disc_x_bal", F.col("disc") * F.col("bal") / 1000)
    return R.panel_fits(
        sy,
        "id",
        ["yr"],
        "cl",
        [
            R.Spec("trends", "y", ["disc"], trend="yr"),
            R.Spec("interaction", "y", ["disc", "disc_x_bal"]),
            R.Spec("drop_two", "y", ["disc"], ~F.col("cl").isin(3, 7)),
            R.Spec("late", "y", ["disc"], F.col("yr") >= 1998),
        ],
    )


_E15_WITHIN, _E15_DUMMIES = PS.within("w", "sy", "id", ["cl"], ["y", "disc", "tax"], {"yr": (PS.YEARS, 1)})
SEED, SEED_AR = 20261006, 20261007


@query(
    "e15_wild_bootstrap_t",
    f"WITH {B.SY}, {_E15_WITHIN}, {PS.wild('t', 'w', 'disc', 'y', '0.0', [*_E15_DUMMIES, 'tax'], 'SELECT 0.0::DOUBLE AS candidate', 999, SEED)} SELECT *, 'disc' AS term FROM ({PS.summary('t', 999, SEED, {'t_lo': 0.025, 't_hi': 0.975})})",
)
def e15(spark: Spark, d: str) -> DataFrame:
    sy = settle(B.supplier_year(spark, d).select("id", "cl", "yr", "y", "disc", "tax"))
    design, dummies = R.within(sy, "id", ["yr"], ["y", "disc", "tax"])
    x = ["disc", "tax", *dummies]
    return BS.wild_t(R.cluster_moments(design, [*x, "y"], "cl"), x, "y", "disc", reps=999, seed=SEED)


GRID = [round(-3 + 0.25 * i, 2) for i in range(25)]
GRID_SQL = "SELECT round(-3 + 0.25 * i, 2)::DOUBLE AS candidate FROM (SELECT unnest(range(0, 25, {step})) AS i)"


@query(
    "e16_inversion_grid",
    f"WITH {ONE_REG}, {PS.wild('t', 'm', 'x', 'yy', 'x', ['z'], GRID_SQL.format(step=1), 399, SEED)} SELECT *, p >= 0.05 AS keep FROM ({PS.summary('t', 399, SEED)})",
)
def e16(spark: Spark, d: str) -> DataFrame:
    m = _one_regressor(spark, d)
    return BS.wild_inversion(m, ["disc", "tax"], "y", "disc", GRID, reps=399, seed=SEED)


@query(
    "e17_two_stage",
    f"""WITH {ONE_REG}, s AS (SELECT cl, sum(z * (yy - tau * x)) AS s FROM m, f GROUP BY 1) SELECT 'disc' AS term, round(max(tau), 6) AS b, round(sqrt(sum(s * s) * max(cc)) / abs(max(zx)), 6) AS se, CAST(max(n) AS BIGINT) AS n, CAST(max(g) AS BIGINT) AS clusters FROM s, f""",
)
def e17(spark: Spark, d: str) -> DataFrame:
    m = _one_regressor(spark, d)
    return R.coefficient_table(m, R.two_stage(m, "y", "disc", [], ["tax"]), ["disc"]).select("term", "b", "se", "n", "clusters")


@query(
    "e18_first_stage_f",
    f"""WITH {ONE_REG}, s AS (SELECT cl, sum(z * (x - pi * z)) AS s FROM m, f GROUP BY 1) SELECT round(power(max(pi), 2) / (sum(s * s) * max(cc) / power(max(zz), 2)), 6) AS first_stage_f FROM s, f""",
)
def e18(spark: Spark, d: str) -> DataFrame:
    f = R.first_stage_f(_one_regressor(spark, d), "disc", [], ["tax"])
    return spark.createDataFrame([(f,)], "first_stage_f double")


@query(
    "e19_anderson_rubin",
    f"""WITH {ONE_REG}, h AS (SELECT round(-3 + 0.25 * i, 2)::DOUBLE AS b0 FROM range(25) t(i)), s AS (SELECT b0, cl, sum(z * ((yy - b0 * x) - (rf - b0 * pi) * z)) AS s FROM m, f, h GROUP BY 1, 2)
    SELECT b0 AS candidate, round(power(max(rf) - b0 * max(pi), 2) / (sum(s * s) * max(cc) / power(max(zz), 2)), 5) AS statistic, power(max(rf) - b0 * max(pi), 2) / (sum(s * s) * max(cc) / power(max(zz), 2)) < 10 AS keep FROM s, f GROUP BY b0""",
)
def e19(spark: Spark, d: str) -> DataFrame:
    ar = R.anderson_rubin(_one_regressor(spark, d), "y", "disc", [], ["tax"], GRID)
    return ar.withColumn("statistic", F.round("statistic", 5))


@query(
    "e20_wild_anderson_rubin",
    f"WITH {B.SY}, m AS (SELECT cl, y - avg(y) OVER w AS yy, disc - avg(disc) OVER w AS d, tax - avg(tax) OVER w AS z, qty - avg(qty) OVER w AS c FROM sy WINDOW w AS (PARTITION BY id)), {PS.wild('t', 'm', 'z', 'yy', 'd', ['c'], GRID_SQL.format(step=4), 299, SEED_AR, square=True)} SELECT *, observed < critical AS keep FROM ({PS.summary('t', 299, SEED_AR, {'critical': 0.95})})",
)
def e20(spark: Spark, d: str) -> DataFrame:
    sy = B.supplier_year(spark, d).select("id", "cl", "y", "disc", "tax", "qty")
    m = R.cluster_moments(R.demean(sy, "id", ["y", "disc", "tax", "qty"]), ["y", "disc", "tax", "qty"], "cl")
    return BS.wild_anderson_rubin(m, "y", "disc", ["qty"], ["tax"], GRID[::4], reps=299, seed=SEED_AR)


SHIFT = f"""{B.ST}, w AS (SELECT unit, origin, sum(CASE WHEN yr = 1995 THEN stock ELSE 0 END) AS base, sum(CASE WHEN yr = 2000 THEN stock ELSE 0 END) AS e FROM st WHERE yr IN (1995, 2000) GROUP BY 1, 2),
  t AS (SELECT origin, sum(base) AS b, sum(e) AS e FROM w GROUP BY 1), u AS (SELECT unit, sum(base) AS b FROM w GROUP BY 1)"""


@query("e21_national_growth", f"WITH {SHIFT} SELECT w.unit, w.origin, round(CASE WHEN t.b - base = 0 THEN 0 ELSE ((t.e - w.e) - (t.b - base)) / (t.b - base) END, 6) AS growth FROM w JOIN t ON w.origin = t.origin")
def e21(spark: Spark, d: str) -> DataFrame:
    wide = SS.two_years(B.segment_stock(spark, d), "unit", "origin", "yr", "stock", 1995, 2000)
    return SS.national_growth(wide, "origin", True).select("unit", "origin", "growth")


@query("e22_base_shares", f"WITH {SHIFT} SELECT w.unit, origin, round(base / u.b, 6) AS share FROM w JOIN u ON w.unit = u.unit")
def e22(spark: Spark, d: str) -> DataFrame:
    wide = SS.two_years(B.segment_stock(spark, d), "unit", "origin", "yr", "stock", 1995, 2000)
    return SS.base_shares(wide, "unit").select("unit", "origin", "share")


@query(
    "e23_predicted_shock",
    f"""WITH {SHIFT}, g AS (SELECT w.*, u.b AS ub, ((t.e - w.e) - (t.b - base)) / (t.b - base) AS g FROM w JOIN t ON w.origin = t.origin JOIN u ON w.unit = u.unit)
    SELECT unit, round(sum(base / ub * g), 6) AS shock, round(sum(base * g), 6) AS predicted_change, sum(base) AS base_stock, round(1000 * sum(base * g) / sum(base), 6) AS per_1000 FROM g GROUP BY 1""",
)
def e23(spark: Spark, d: str) -> DataFrame:
    shock = SS.predicted_shock(B.segment_stock(spark, d), "unit", "origin", "yr", "stock", 1995, 2000)
    return shock.withColumn("per_1000", ratio(F.col("predicted_change"), F.col("base_stock"), scale=1000.0))


@query(
    "e24_band_containment",
    """WITH g AS (SELECT l_suppkey AS id, round(sum(l_discount), 2) / count(*) AS b, stddev_samp(l_discount) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1) SELECT id, round(b - 1.96 * se, 6) AS lo, round(b + 1.96 * se, 6) AS hi, b - 1.96 * se >= 0.045 AND b + 1.96 * se <= 0.055 AS inside FROM g""",
)
def e24(spark: Spark, d: str) -> DataFrame:
    g = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        (F.round(F.sum("l_discount"), 2) / F.count("*")).alias("b"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se")
    )
    lo, hi = F.col("b") - 1.96 * F.col("se"), F.col("b") + 1.96 * F.col("se")
    return g.select("id", lo.alias("lo"), hi.alias("hi"), ((lo >= 0.045) & (hi <= 0.055)).alias("inside"))


@query(
    "e25_inversion_summary",
    f"""WITH {ONE_REG}, {PS.wild('t', 'm', 'x', 'yy', 'x', [], GRID_SQL.format(step=1), 199, SEED)}, {PS.wild('u', 'm', 'x', 'yy', 'x', ['z'], GRID_SQL.format(step=1), 199, SEED)},
    a AS (SELECT 'bivariate' AS model, candidate, p >= 0.05 AS keep FROM ({PS.summary('t', 199, SEED)}) UNION ALL SELECT 'with_tax', candidate, p >= 0.05 FROM ({PS.summary('u', 199, SEED)})),
    b AS (SELECT *, min(candidate) FILTER (WHERE keep) OVER w AS lo, max(candidate) FILTER (WHERE keep) OVER w AS hi FROM a WINDOW w AS (PARTITION BY model))
    SELECT model, min(lo) AS accepted_min, max(hi) AS accepted_max, count(*) FILTER (WHERE keep) AS accepted, count(*) AS tested, concat_ws(';', CASE WHEN count(*) FILTER (WHERE keep) = 0 THEN '{BS.NONE_ACCEPTED}' END, CASE WHEN bool_or(keep AND candidate = -3) THEN '{BS.OPEN_BELOW}' END,
      CASE WHEN bool_or(keep AND candidate = 3) THEN '{BS.OPEN_ABOVE}' END, CASE WHEN bool_or(NOT keep AND candidate > lo AND candidate < hi) THEN '{BS.DISJOINT}' END) AS warnings FROM b GROUP BY 1""",
)
def e25(spark: Spark, d: str) -> DataFrame:
    """Tested grids of two models reduced to accepted range, count and warnings."""
    m = _one_regressor(spark, d)
    one = BS.wild_inversion(m, ["disc"], "y", "disc", GRID, reps=199, seed=SEED).withColumn("model", F.lit("bivariate"))
    two = BS.wild_inversion(m, ["disc", "tax"], "y", "disc", GRID, reps=199, seed=SEED).withColumn("model", F.lit("with_tax"))
    return BS.inversion_summary(one.unionByName(two), ["model"], (GRID[0], GRID[-1]))


@query(
    "e26_correlation_study",
    f"""WITH {B.NY}, e AS (SELECT unit, region, max(n_orders) FILTER (WHERE yr = 1995) AS a, max(n_orders) FILTER (WHERE yr = 2000) AS b, max(price) FILTER (WHERE yr = 1995) AS p, max(price) FILTER (WHERE yr = 2000) AS q, max(urgent) FILTER (WHERE yr = 2000) AS u FROM ny GROUP BY 1, 2),
    s AS (SELECT 'growth_price' AS study, CAST(b - a AS DOUBLE) / a AS x, (q - p) / p AS y FROM e UNION ALL SELECT 'urgent_price', CAST(u AS DOUBLE) / b, q FROM e), r AS (SELECT *, {rank_sql('study', 'x')} AS rx, {rank_sql('study', 'y')} AS ry FROM s)
    SELECT study, count(*) AS n, {corr_sql('x', 'y', 3)} AS pearson, {corr_sql('rx', 'ry', 3)} AS spearman FROM r GROUP BY 1""",
)
def e26(spark: Spark, d: str) -> DataFrame:
    e = J.endpoint_change(settle(B.nation_year(spark, d)), ["unit"], "yr", 1995, 2000, ["n_orders", "price", "urgent"])
    growth = e.select(
        F.lit("growth_price").alias("study"), ratio(F.col("n_orders_change"), F.col("n_orders_start")).alias("x"), ratio(F.col("price_change"), F.col("price_start")).alias("y")
    )
    urgent = e.select(F.lit("urgent_price").alias("study"), ratio(F.col("urgent_end"), F.col("n_orders_end")).alias("x"), F.col("price_end").alias("y"))
    pairs = growth.unionByName(urgent)
    pearson = pairs.groupBy("study").agg(A.guarded_corr("x", "y", 3).alias("pearson"))
    return C.spearman(pairs, ["study"], "x", "y").join(pearson, "study")


# ----------------------------------------------------------------------- survey


@query(
    "v01_linkage_rules",
    """WITH p AS (SELECT l_orderkey AS hid, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT o_orderkey AS hid, 1 + o_orderkey % 6 AS members FROM orders)
    SELECT 'duplicate_key' AS rule, 0 AS violations UNION ALL SELECT 'universe_mismatch', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000
    UNION ALL SELECT 'member_count_mismatch', count(*) FROM h LEFT JOIN p USING (hid) WHERE coalesce(n, 0) <> members UNION ALL SELECT 'weight_not_positive', count(*) FROM lineitem WHERE NOT l_quantity - 2 > 0""",
)
def v01(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders").withColumnRenamed("o_orderkey", "hid")
    register = o.filter(~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))).select("hid")
    homes = o.select("hid", (1 + F.col("hid") % 6).alias("members"))
    people = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("hid"), (F.col("l_quantity") - 2).alias("wt"))
    return V.linkage_problems(register, homes, people, "hid", "members", "wt")


EQ = f"""{B.PS}, pa AS (SELECT *, CASE WHEN age = -1 THEN 0 ELSE age END AS a0 FROM ps), sc AS (SELECT hid, 1 + 0.5 * (count(*) FILTER (WHERE a0 >= 14) - 1) + 0.3 * count(*) FILTER (WHERE a0 < 14) AS scale, count(*) FILTER (WHERE a0 >= 14) AS adults FROM pa GROUP BY 1),
  eq AS (SELECT pa.*, round(income / scale::DOUBLE, 8) AS eqv FROM pa JOIN sc USING (hid) WHERE adults > 0)"""


def _eq(spark: Spark, d: str) -> DataFrame:
    """Persons with their equivalised income, settled, as the poverty line and its users read it.

    The household's scale needs its members' ages alone, so lines are grouped before any join.
    """
    age = F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_linenumber") * 13)
    members = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("hid"), BK.reference_age(age).alias("a0"))
    scale = V.household_scale(members, "hid", "a0")
    persons = B.persons(spark, d).withColumn("a0", BK.reference_age(F.col("age")))
    eqv = F.round(V.equivalised(F.col("income"), F.col("adults"), F.col("children")), 8)
    return settle(persons.join(scale.filter("adults > 0"), "hid").withColumn("eqv", eqv))


@query("v02_equivalised_income", f"WITH {EQ} SELECT hid, round(max(eqv), 6) AS eqv, count(*) AS persons FROM eq GROUP BY 1")
def v02(spark: Spark, d: str) -> DataFrame:
    return _eq(spark, d).groupBy("hid").agg(F.max("eqv").alias("eqv"), F.count("*").alias("persons"))


BURDEN = "CASE WHEN 12 * cost - allowance <= 0 THEN FALSE WHEN income - allowance <= 0 THEN TRUE ELSE 12 * cost - allowance > 0.4 * (income - allowance) END"


@query("v03_burden_rules", f"WITH {B.PS} SELECT tenure, count(cost) AS valid, count(*) FILTER (WHERE {BURDEN}) AS burdened, CAST(sum(wt) FILTER (WHERE {BURDEN}) AS DOUBLE) AS weight FROM ps GROUP BY 1")
def v03(spark: Spark, d: str) -> DataFrame:
    hit = V.overburdened(F.col("cost"), F.col("income"), F.col("allowance"))
    return B.persons(spark, d).withColumn("hit", hit).groupBy("tenure").agg(
        F.count("cost").alias("valid"), F.count_if("hit").alias("burdened"), F.sum(F.when(F.col("hit"), F.col("wt"))).alias("weight")
    )


def cut_sql(q: float, src: str) -> str:
    return f"(SELECT min(CASE WHEN cum = {q} * tot AND nxt IS NOT NULL THEN (eqv + nxt) / 2 ELSE eqv END) FROM (SELECT eqv, lead(eqv) OVER (ORDER BY eqv) AS nxt, cum, tot FROM {src}) WHERE cum >= {q} * tot)"


CUM = "SELECT eqv, sum(sum(wt)) OVER (ORDER BY eqv ROWS UNBOUNDED PRECEDING) AS cum, sum(sum(wt)) OVER () AS tot FROM eq"


@query("v04_poverty_line", f"WITH {EQ}, al AS MATERIALIZED ({CUM} GROUP BY eqv) SELECT CASE WHEN eqv < 0.6 * {cut_sql(0.5, 'al')} THEN 'B_60' ELSE 'A_60' END AS poverty, count(*) AS persons, sum(wt) AS weight FROM eq GROUP BY 1")
def v04(spark: Spark, d: str) -> DataFrame:
    eq = _eq(spark, d)
    line = V.poverty_line(eq.select("eqv", "wt"), "eqv", "wt")
    return eq.groupBy(F.when(F.col("eqv") < line, "B_60").otherwise("A_60").alias("poverty")).agg(
        F.count("*").alias("persons"), F.sum("wt").alias("weight")
    )


@query(
    "v05_weighted_quintiles",
    f"""WITH {EQ}, el AS MATERIALIZED ({CUM} WHERE cost IS NOT NULL GROUP BY eqv), c AS MATERIALIZED (SELECT {cut_sql(0.2, 'el')} AS a, {cut_sql(0.4, 'el')} AS b, {cut_sql(0.6, 'el')} AS c, {cut_sql(0.8, 'el')} AS d)
    SELECT CAST(1 + (eqv > a)::INT + (eqv > b)::INT + (eqv > c)::INT + (eqv > d)::INT AS INT) AS quintile, count(*) AS persons, sum(wt) AS weight FROM eq, c WHERE cost IS NOT NULL GROUP BY 1""",
)
def v05(spark: Spark, d: str) -> DataFrame:
    valid = _eq(spark, d).filter(F.col("cost").isNotNull()).select("eqv", "wt")
    return valid.groupBy(V.quintile(valid, "eqv", "wt").alias("quintile")).agg(F.count("*").alias("persons"), F.sum("wt").alias("weight"))


@query(
    "v06_group_rates",
    f"""WITH {B.PS}, a AS (SELECT *, CASE WHEN age = -1 THEN 0 ELSE age END AS a0, {BURDEN} AS hit FROM ps WHERE cost IS NOT NULL), g AS (SELECT 'tenure' AS breakdown, 'TOTAL' AS code, hit, wt FROM a UNION ALL SELECT 'tenure', tenure, hit, wt FROM a UNION ALL SELECT 'age', 'TOTAL', hit, wt FROM a
    UNION ALL SELECT 'age', 'Y18-24', hit, wt FROM a WHERE a0 BETWEEN 18 AND 24 UNION ALL SELECT 'age', 'Y25-29', hit, wt FROM a WHERE a0 BETWEEN 25 AND 29 UNION ALL SELECT 'age', 'Y18-64', hit, wt FROM a WHERE a0 BETWEEN 18 AND 64 UNION ALL SELECT 'age', 'Y_GE65', hit, wt FROM a WHERE a0 >= 65)
    SELECT breakdown, code, round(100.0 * sum(CASE WHEN hit THEN wt ELSE 0 END) / sum(wt), 6) AS rate_pct, sum(wt) AS person_weight, count(*) AS sample_persons FROM g GROUP BY 1, 2""",
)
def v06(spark: Spark, d: str) -> DataFrame:
    return _rates(spark, d)


def _rates(spark: Spark, d: str) -> DataFrame:
    ps = B.persons(spark, d).filter(F.col("cost").isNotNull()).withColumn("hit", V.overburdened(F.col("cost"), F.col("income"), F.col("allowance")))

    def member(breakdown: str, code):
        return F.struct(F.lit(breakdown).alias("breakdown"), code.alias("code"))

    ages = F.transform(BK.age_groups(BK.reference_age(F.col("age"))), lambda g: member("age", g))
    groups = F.concat(F.array(member("tenure", F.lit("TOTAL")), member("tenure", F.col("tenure"))), ages)
    return V.group_rates(ps, groups, "hit", "wt")


COHORT = "CASE WHEN a0 < 18 THEN 'Y_LT18' WHEN a0 <= 24 THEN 'Y18-24' WHEN a0 <= 29 THEN 'Y25-29' WHEN a0 <= 64 THEN 'Y30-64' ELSE 'Y_GE65' END"
DIMS = {
    "age_code": ["Y_LT18", "Y18-24", "Y25-29", "Y30-64", "Y_GE65"],
    "poverty": ["A_60", "B_60"],
    "tenure": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "9-NONE", "4-NOT SPECIFIED"],
}
CELLS = f"""{EQ}, al AS MATERIALIZED ({CUM} GROUP BY eqv), ln AS MATERIALIZED (SELECT 0.6 * {cut_sql(0.5, 'al')} AS line), b AS (SELECT hid, wt, {COHORT} AS age_code, CASE WHEN eqv < line THEN 'B_60' ELSE 'A_60' END AS poverty, tenure, cost IS NOT NULL AS valid, coalesce({BURDEN}, FALSE) AS hit FROM eq, ln),
  cu AS (SELECT coalesce(age_code, 'TOTAL') AS age_code, coalesce(poverty, 'TOTAL') AS poverty, coalesce(tenure, 'TOTAL') AS tenure, count(*) AS target_persons, count(*) FILTER (WHERE valid) AS valid_persons, count(DISTINCT hid) AS target_households, count(DISTINCT hid) FILTER (WHERE valid) AS valid_households,
    sum(wt) AS target_weight, coalesce(sum(wt) FILTER (WHERE valid), 0) AS valid_weight, coalesce(sum(wt) FILTER (WHERE valid AND hit), 0) AS bw FROM b GROUP BY CUBE (age_code, poverty, tenure)),
  gr AS (SELECT a AS age_code, p AS poverty, t AS tenure FROM (SELECT unnest(['TOTAL', 'Y_LT18', 'Y18-24', 'Y25-29', 'Y30-64', 'Y_GE65']) AS a), (SELECT unnest(['TOTAL', 'A_60', 'B_60']) AS p), (SELECT unnest(['TOTAL', '1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', '9-NONE', '4-NOT SPECIFIED']) AS t)),
  ce AS (SELECT gr.*, coalesce(target_persons, 0) AS target_persons, coalesce(valid_persons, 0) AS valid_persons, coalesce(target_households, 0) AS target_households, coalesce(valid_households, 0) AS valid_households, coalesce(target_weight, 0)::DOUBLE AS target_weight, coalesce(valid_weight, 0)::DOUBLE AS valid_weight, coalesce(bw, 0)::DOUBLE AS bw FROM gr LEFT JOIN cu USING (age_code, poverty, tenure)),
  gm AS (SELECT *, CASE WHEN target_weight > 0 THEN least(1, greatest(0, (target_weight - valid_weight) / target_weight)) END AS ms FROM ce),
  gt AS (SELECT *, CASE WHEN target_persons > 0 AND valid_persons > 0 THEN concat_ws(';', CASE WHEN valid_persons < 50 THEN 'less_than_50_valid_persons' END, CASE WHEN valid_households < 30 THEN 'less_than_30_valid_households' END, CASE WHEN ms > 0.05 + 1e-12 THEN 'over_5pct_weighted_cost_loss' END) ELSE '' END AS reasons FROM gm),
  gs AS (SELECT *, CASE WHEN target_persons = 0 THEN 'empty' WHEN valid_persons = 0 THEN 'no_valid_cost' WHEN reasons <> '' THEN 'suppressed' ELSE 'available' END AS status FROM gt)"""


def _cells(spark: Spark, d: str, valid_share: bool) -> DataFrame:
    eq = _eq(spark, d)
    line = V.poverty_line(eq.select("eqv", "wt"), "eqv", "wt")
    people = eq.select(
        "hid",
        "wt",
        BK.band(F.col("a0"), BK.COHORTS).alias("age_code"),
        F.when(F.col("eqv") < line, "B_60").otherwise("A_60").alias("poverty"),
        "tenure",
        (F.lit(valid_share) | F.col("cost").isNotNull()).alias("valid"),
        F.coalesce(V.overburdened(F.col("cost"), F.col("income"), F.col("allowance")), F.lit(False)).alias("hit"),
    )
    return V.cell_cube(people, DIMS, "hid", "wt", "valid", "hit")


@query("g21_cell_cube", f"WITH {CELLS} SELECT age_code, poverty, tenure, target_persons, valid_persons, target_households, valid_households, target_weight, valid_weight FROM ce")
def g21(spark: Spark, d: str) -> DataFrame:
    return _cells(spark, d, False).drop("_bw")


@query(
    "v07_disclosure_gate",
    f"WITH {CELLS} SELECT age_code, poverty, tenure, status, reasons, round(100 * ms, 6) AS missing_pct, CASE WHEN status = 'available' THEN round(100 * bw / valid_weight, 6) END AS rate_pct FROM gs",
)
def v07(spark: Spark, d: str) -> DataFrame:
    return V.disclosure_gate(_cells(spark, d, False)).select("age_code", "poverty", "tenure", "status", "reasons", "missing_pct", "rate_pct")


@query(
    "v08_margin_suppression",
    f"""WITH {CELLS.replace("cost IS NOT NULL AS valid", "TRUE AS valid")} SELECT age_code, poverty, tenure, CASE WHEN 'TOTAL' IN (age_code, poverty, tenure) AND status IN ('available', 'suppressed') THEN 'marginal_not_published' ELSE status END AS status,
    CASE WHEN 'TOTAL' IN (age_code, poverty, tenure) AND status IN ('available', 'suppressed') THEN concat_ws(';', nullif(reasons, ''), 'overlapping_marginal_rate_not_published') ELSE reasons END AS reasons,
    CASE WHEN status = 'available' AND 'TOTAL' NOT IN (age_code, poverty, tenure) THEN round(100 * bw / valid_weight, 6) END AS rate_pct FROM gs""",
)
def v08(spark: Spark, d: str) -> DataFrame:
    out = V.withhold_margins(V.disclosure_gate(_cells(spark, d, True)), list(DIMS))
    return out.select("age_code", "poverty", "tenure", "status", "reasons", "rate_pct")


@query("v09_flag_frequencies", "SELECT 'l_returnflag' AS field, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def v09(spark: Spark, d: str) -> DataFrame:
    return V.flag_frequencies(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "v10_benchmark_match",
    f"""WITH {B.PS}, g AS (SELECT 'tenure' AS breakdown, tenure AS code, 100.0 * sum(CASE WHEN {BURDEN} THEN wt ELSE 0 END) / sum(wt) AS rate FROM ps WHERE cost IS NOT NULL GROUP BY 2)
    SELECT breakdown, code, round(rate, 1) + CASE WHEN code = '5-LOW' THEN 0.2 ELSE 0 END AS published_pct, round(rate, 6) AS computed_pct, abs(rate - (round(rate, 1) + CASE WHEN code = '5-LOW' THEN 0.2 ELSE 0 END)) <= 0.05 + 1e-9 AS matches FROM g""",
)
def v10(spark: Spark, d: str) -> DataFrame:
    computed = _rates(spark, d).filter((F.col("breakdown") == "tenure") & (F.col("code") != "TOTAL"))
    published = computed.select(
        "breakdown", "code", (F.round("rate_pct", 1) + F.when(F.col("code") == "5-LOW", 0.2).otherwise(0.0)).alias("rate_pct")
    )
    return V.benchmark_matches(computed, published, ["breakdown", "code"])
