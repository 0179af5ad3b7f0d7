"""Clustered linear models from per-cluster cross products.

One Spark aggregate turns the rows into one cross-product row per cluster. All that
follows (coefficients, CR1V covariance, instruments, Anderson-Rubin sets, bootstraps)
is algebra on those rows: sums over clusters run in Spark, only k x k totals reach
the driver. No step sees the raw data twice and none holds all clusters at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelbook.operators.aggregates import vector_sum
from parcelbook.operators.order_stats import null_safe_join
from parcelbook.session import settle

ONE = "_one"
#: Rows whose square matrices a task holds at once.
ROWS = 1024


# ------------------------------------------------------------- design columns


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def levels(df: DataFrame, column: str) -> list:
    """Sorted distinct labels of a calendar or season column (bounded by the calendar)."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def demean(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """Columns replaced by their deviation from the unit mean."""
    means = df.groupBy(unit).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = null_safe_join(df, means, [unit])
    return joined.select(
        *[c for c in df.columns if c not in columns],
        *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns],
    )


def within(
    df: DataFrame,
    unit: str,
    periods: list[str],
    columns: list[str],
    trend: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Two-way within transform; returns the frame and its dummy column names.

    Values *and* period dummies are demeaned by unit: the dummy of period t becomes
    ``(p == t) - n(u, t) / n(u)``. With ``trend`` a line per unit is removed as well;
    the common trend then lies in the span, so one more dummy is dropped.
    """
    dummies: list[tuple[str, Column]] = []
    for i, p in enumerate(periods):
        skip = 2 if trend and i == 0 else 1
        for j, level in enumerate(levels(df, p)[skip:]):
            dummies.append((f"_d{i}_{j}", F.when(F.col(p) == level, 1.0).otherwise(0.0)))
    full = df.select("*", *[c.alias(n) for n, c in dummies])
    names = [n for n, _ in dummies]
    if not trend:
        return demean(full, unit, [*columns, *names]), names
    t0 = df.agg(F.min(trend)).scalar()
    full = full.withColumn("_t", (F.col(trend) - t0).cast("double"))
    every = [*columns, *names]
    stats = full.groupBy(unit).agg(
        F.count("*").alias("_n"),
        F.sum("_t").alias("_st"),
        F.sum(F.col("_t") * F.col("_t")).alias("_stt"),
        *[F.sum(c).alias(f"_s_{c}") for c in every],
        *[F.sum(F.col("_t") * F.col(c)).alias(f"_x_{c}") for c in every],
    )
    joined = null_safe_join(full, stats, [unit])
    stt = F.nullif(F.col("_stt") - F.col("_st") * F.col("_st") / F.col("_n"), F.lit(0.0))

    def residual(c: str) -> Column:
        slope = (F.col(f"_x_{c}") - F.col("_st") * F.col(f"_s_{c}") / F.col("_n")) / stt
        centred = F.col(c) - F.col(f"_s_{c}") / F.col("_n")
        return centred - F.coalesce(slope, F.lit(0.0)) * (F.col("_t") - F.col("_st") / F.col("_n"))

    return (
        joined.select(*[c for c in df.columns if c not in columns], *[residual(c).alias(c) for c in every]),
        names,
    )


def year_effects(df: DataFrame, period: str) -> tuple[DataFrame, list[str]]:
    """A constant and raw period dummies (first level dropped)."""
    marks = [
        F.when(F.col(period) == level, 1.0).otherwise(0.0).alias(f"_y{j}")
        for j, level in enumerate(levels(df, period)[1:])
    ]
    names = ["_const", *[f"_y{j}" for j in range(len(marks))]]
    return df.select("*", F.lit(1.0).alias("_const"), *marks), names


# ------------------------------------------------------------- cluster moments


@dataclass
class Moments:
    """Per-cluster upper-triangle cross products of ``columns`` (last one is ONE)."""

    table: DataFrame
    columns: list[str]
    rows: int
    clusters: int
    total: np.ndarray
    absorbed: int = 0
    where: dict[str, int] = field(default_factory=dict)

    def at(self, names: list[str]) -> list[int]:
        return [self.where[n] for n in names]

    def block(self, left: list[str], right: list[str]) -> np.ndarray:
        return self.total[np.ix_(self.at(left), self.at(right))]

    def correction(self, k: int) -> float:
        n, g, k = self.rows, self.clusters, k + self.absorbed
        return g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else 1.0


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    """Stacked upper triangles (rows, p(p+1)/2) -> symmetric (rows, p, p)."""
    i, j = np.triu_indices(p)
    out = np.zeros((flat.shape[0], p, p))
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def pieces(batches: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """Batches cut to at most ``rows`` rows, so that a task's matrices stay as small however full batches are."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def cluster_moments(df: DataFrame, columns: list[str], cluster: str, absorbed: int = 0) -> Moments:
    """Aggregate rows to one cross-product row per cluster and settle it."""
    cols = list(dict.fromkeys([*columns, ONE]))
    wide = df.select(
        F.col(cluster).alias("cluster"),
        *[F.col(c).cast("double").alias(c) for c in cols if c != ONE],
        F.lit(1.0).alias(ONE),
    )
    p = len(cols)
    products = [F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in zip(*np.triu_indices(p), strict=True)]
    table = settle(
        wide.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*products).alias("m"))
        .withColumn("key", F.xxhash64("cluster"))
    )
    size = p * (p + 1) // 2

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, g, acc = 0, 0, np.zeros(size)
        for batch in batches:
            if len(batch):
                n, g = n + int(batch["n"].sum()), g + len(batch)
                acc += np.stack(batch["m"].to_numpy()).sum(axis=0)
        yield pd.DataFrame({"n": [n], "g": [g], "m": [acc]})

    # one row per task comes back: counts and a k x k triangle
    rows = table.select("n", "m").mapInPandas(totals, "n long, g long, m array<double>").collect()
    if not sum(r["n"] for r in rows):
        raise ValueError("no rows to fit")
    total = _square(np.sum([r["m"] for r in rows], axis=0)[None, :], p)[0]
    n, g = sum(r["n"] for r in rows), sum(r["g"] for r in rows)
    return Moments(table, cols, n, g, total, absorbed, {c: i for i, c in enumerate(cols)})


def sum_over_clusters(m: Moments, width: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(moments, keys)`` over all batches of clusters (``width`` numbers)."""
    p = len(m.columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(width)
        for b in batches:
            if len(b):
                acc += part(_square(np.stack(b["m"].to_numpy()), p), b["key"].to_numpy())
        yield pd.DataFrame({"i": np.arange(width), "v": acc})

    rows = (
        m.table.select("key", "m").mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    )
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a cross-product matrix; a singular design is an error."""
    d = np.sqrt(np.abs(np.diag(a)))
    if not np.all(d > 0):
        raise ValueError("singular design matrix")
    scaled = a / np.outer(d, d)
    if np.linalg.cond(scaled) > 1e12:
        raise ValueError("singular design matrix")
    return np.linalg.inv(scaled) / np.outer(d, d)


# ------------------------------------------------------------------ estimators


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    k: int
    clusters: int
    r2: float

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))


def sandwich(m: Moments, left: list[str], y: str, x: list[str], beta: np.ndarray) -> np.ndarray:
    """Sum over clusters of score outer products, score = left'(y - x beta)."""
    li, xi, yi = m.at(left), m.at(x), m.where[y]
    k = len(left)

    def part(mm: np.ndarray, _keys: np.ndarray) -> np.ndarray:
        s = mm[:, li, yi] - mm[:, li][:, :, xi] @ beta
        return (s.T @ s).ravel()

    return sum_over_clusters(m, k * k, part).reshape(k, k)


def ols(m: Moments, x: list[str], y: str) -> Fit:
    """Least squares with CR1V covariance (equals HC1 when clusters are single rows)."""
    bread = inverse(m.block(x, x))
    return fitted(m, x, y, bread, sandwich(m, x, y, x, bread @ m.block(x, [y])[:, 0]))


def fitted(m: Moments, x: list[str], y: str, bread: np.ndarray, meat: np.ndarray) -> Fit:
    """The fit whose score products are known."""
    xy = m.block(x, [y])[:, 0]
    beta = bread @ xy
    cov = bread @ meat @ bread * m.correction(len(x))
    yy = m.block([y], [y])[0, 0]
    sse = yy - 2 * beta @ xy + beta @ m.block(x, x) @ beta
    sst = yy - m.block([y], [ONE])[0, 0] ** 2 / m.rows
    r2 = 1 - sse / sst if sst else 0.0
    return Fit(list(x), beta, cov, m.rows, len(x) + m.absorbed, m.clusters, float(r2))


def two_stage(m: Moments, y: str, d: str, w: list[str], z: list[str]) -> Fit:
    """Exactly identified IV; the right bread is transposed because Z'X is not symmetric."""
    if len(z) != 1:
        raise ValueError("exactly one instrument is needed")
    x, zw = [d, *w], [*z, *w]
    zx = m.block(zw, x)
    if np.linalg.cond(zx / np.sqrt(np.outer(np.diag(m.block(zw, zw)), np.diag(m.block(x, x))))) > 1e12:
        raise ValueError("singular design matrix")
    bread = np.linalg.inv(zx)
    beta = bread @ m.block(zw, [y])[:, 0]
    cov = bread @ sandwich(m, zw, y, x, beta) @ bread.T * m.correction(len(x))
    return Fit(x, beta, cov, m.rows, len(x) + m.absorbed, m.clusters, float("nan"))


def wald(beta: np.ndarray, cov: np.ndarray, select: int) -> float:
    """Wald statistic of the first ``select`` coefficients over their number."""
    block = cov[:select, :select]
    if np.linalg.matrix_rank(block) < select:
        return 0.0
    return float(beta[:select] @ np.linalg.solve(block, beta[:select]) / select)


def first_stage_f(m: Moments, d: str, w: list[str], z: list[str]) -> float:
    """Cluster-robust F of the excluded instruments."""
    fit = ols(m, [*z, *w], d)
    return wald(fit.beta, fit.cov, len(z))


def anderson_rubin(m: Moments, y: str, d: str, w: list[str], z: list[str], grid: list[float], cut: float = 10.0) -> DataFrame:
    """Statistic and acceptance of every candidate effect.

    Scores are linear in the candidate, so two fits and three score products give the
    covariance at every grid point.
    """
    x = [*z, *w]
    xi, yi, di = m.at(x), m.where[y], m.where[d]
    k = len(x)
    bread = inverse(m.block(x, x))
    by, bd = bread @ m.block(x, [y])[:, 0], bread @ m.block(x, [d])[:, 0]

    def part(mm: np.ndarray, _keys: np.ndarray) -> np.ndarray:
        xx = mm[:, xi][:, :, xi]
        u = mm[:, xi, yi] - xx @ by
        v = mm[:, xi, di] - xx @ bd
        return np.concatenate([(u.T @ u).ravel(), (u.T @ v).ravel(), (v.T @ v).ravel()])

    uu, uv, vv = sum_over_clusters(m, 3 * k * k, part).reshape(3, k, k)
    rows = []
    for b0 in grid:
        meat = uu - b0 * (uv + uv.T) + b0 * b0 * vv
        cov = bread @ meat @ bread * m.correction(k)
        f = wald(by - b0 * bd, cov, len(z))
        rows.append((float(b0), f, bool(f < cut)))
    return m.table.sparkSession.createDataFrame(rows, "candidate double, statistic double, keep boolean")


COEFFICIENTS = "term string, b double, se double, t double, lo95 double, hi95 double, n long, k int, clusters long, r2 double"


def coefficient_rows(fit: Fit, shown: list[str]) -> list[tuple]:
    rows = []
    for term in shown:
        i = fit.terms.index(term)
        b, s = float(fit.beta[i]), float(fit.se[i])
        rows.append((term, b, s, b / s if s > 0 else None, b - 1.96 * s, b + 1.96 * s, fit.n, fit.k, fit.clusters, fit.r2))
    return rows


def coefficient_table(m: Moments, fit: Fit, shown: list[str], **labels: str) -> DataFrame:
    """Tidy table of the shown terms with t and the normal interval."""
    df = m.table.sparkSession.createDataFrame(coefficient_rows(fit, shown), COEFFICIENTS)
    for name, value in labels.items():
        df = df.withColumn(name, F.lit(value))
    return df


# ------------------------------------------------------------ many panel models


@dataclass(frozen=True)
class Spec:
    """One two-way panel model: its columns, the rows it is fitted on and whether units have trends."""

    name: str
    y: str
    regressors: list[str]
    sample: Column | None = None
    trend: str | None = None


def unit_products(df: DataFrame, unit: str, periods: list[str], cluster: str, specs: list[Spec]) -> tuple[DataFrame, list[str], dict[str, list[tuple[str, object]]]]:
    """(spec, unit, cluster, n, m): raw cross products of each model's complete cases, from one pass.

    Rows are grouped by unit, cluster and the set of models that use them, so a row is
    multiplied out once however many models there are. Values are taken from their overall
    mean first, which keeps the later subtraction of unit means accurate.
    """
    values = list(dict.fromkeys(c for s in specs for c in [s.y, *s.regressors]))
    trends = list(dict.fromkeys(s.trend for s in specs if s.trend))
    if len(trends) > 1:
        raise ValueError("all unit trends must follow one column")
    member = F.lit(0).cast("long")
    for i, s in enumerate(specs):
        complete = s.sample if s.sample is not None else F.lit(True)
        for c in [s.y, *s.regressors]:
            complete = complete & F.col(c).isNotNull()
        member = member.bitwiseOR(F.when(complete, F.lit(1 << i)).otherwise(F.lit(0)))
    picked = df.select(
        F.col(unit).alias("_unit"),
        F.col(cluster).alias("_cluster"),
        *[F.col(p).alias(f"_p{i}") for i, p in enumerate(periods)],
        *[F.col(t).cast("double").alias("_trend") for t in trends],
        *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)],
        member.alias("_models"),
    )
    # read for its calendar and means, then for its products
    rows = settle(picked.filter("_models > 0"))
    numbers = [*[f"_v{i}" for i in range(len(values))], *["_trend"] * bool(trends)]
    facts = rows.agg(*[F.avg(c).alias(c) for c in numbers], *[F.sort_array(F.collect_set(f"_p{i}")).alias(f"_p{i}") for i in range(len(periods))]).first()
    marks = {p: [(f"_d{i}_{j}", level) for j, level in enumerate(facts[f"_p{i}"])] for i, p in enumerate(periods)}
    columns = [(c, F.col(c) - (facts[c] or 0.0)) for c in numbers]
    for i, p in enumerate(periods):
        columns += [(name, F.when(F.col(f"_p{i}") == level, 1.0).otherwise(0.0)) for name, level in marks[p]]
    columns.append((ONE, F.lit(1.0)))
    wide = rows.select("_unit", "_cluster", "_models", *[c.alias(name) for name, c in columns])
    names = [name for name, _ in columns]
    triangle = list(zip(*np.triu_indices(len(names)), strict=True))
    product = F.expr(f"array({', '.join(f'coalesce({names[i]} * {names[j]}, 0D)' for i, j in triangle)})")
    own = wide.select("_unit", "_cluster", "_models", product.alias("m")).groupBy("_unit", "_cluster", "_models").agg(vector_sum("m").alias("m"))
    used = F.filter(F.array(*[F.lit(i) for i in range(len(specs))]), lambda i: F.col("_models").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    dealt = own.select(F.explode(used).alias("spec"), "_unit", "_cluster", "m").repartition("spec", "_unit")
    summed = dealt.groupBy("spec", "_unit", "_cluster").agg(vector_sum("m").alias("m"))
    labels = dict(zip([f"_v{i}" for i in range(len(values))], values, strict=True))
    return summed, [labels.get(n, n) for n in names], marks


def within_moments(df: DataFrame, unit: str, periods: list[str], cluster: str, specs: list[Spec]) -> tuple[DataFrame, dict[str, tuple[Moments, list[str]]]]:
    """Cluster moments after unit means (and unit trends) are taken off: of all models together, and of each with its dummies.

    With S the sums of a unit's rows in one cluster, n their number, and U and N those of
    the whole unit, the products of deviations are S_xz - U_x S_z / N - S_x U_z / N +
    n U_x U_z / N^2; a unit's line goes the same way. No second look at the rows is needed.
    """
    summed, names, marks = unit_products(df, unit, periods, cluster, specs)
    p = len(names)
    at = {c: i for i, c in enumerate(names)}
    i, j = np.triu_indices(p)
    flat = {(a, b): k for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True))}
    one, trend = p - 1, at.get("_trend")
    # products with the constant and with the trend, whose sums over the unit are needed
    wanted = [flat[c, one] for c in range(p)] + ([flat[min(c, trend), max(c, trend)] for c in range(p)] if trend is not None else [])
    whole = Window.partitionBy("spec", "_unit")
    picked = F.transform(F.lit(wanted), lambda k: F.get("m", k))
    of_unit = summed.select("spec", F.col("_cluster").alias("cluster"), "m", vector_sum(picked, whole).alias("u"), F.count("*").over(whole).alias("shares"))
    with_trend = np.array([s.trend is not None for s in specs])

    def deviations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            s = _square(np.stack(batch["m"].to_numpy()), p)
            u, ut = np.split(np.stack(batch["u"].to_numpy()), [p], axis=1)
            n, own, total = s[:, one, one], s[:, :, one], u[:, one]
            mean = u / total[:, None]
            w = s - mean[:, :, None] * own[:, None, :] - own[:, :, None] * mean[:, None, :] + n[:, None, None] * mean[:, :, None] * mean[:, None, :]
            if trend is not None:
                lined = with_trend[batch["spec"].to_numpy()]
                joint = ut - u * mean[:, [trend]]
                spread = joint[:, trend]
                slope = np.where((lined & (spread > 1e-9))[:, None], joint / np.where(spread > 1e-9, spread, 1.0)[:, None], 0.0)
                wt = w[:, :, trend]
                w = w - slope[:, :, None] * wt[:, None, :] - wt[:, :, None] * slope[:, None, :] + w[:, trend, trend][:, None, None] * slope[:, :, None] * slope[:, None, :]
            w[:, one, :] = w[:, :, one] = 0.0
            w[:, one, one] = n
            kept = np.concatenate([w[:, i, j], own, (1.0 / batch["shares"].to_numpy())[:, None]], axis=1)
            yield pd.DataFrame({"spec": batch["spec"].to_numpy(), "cluster": batch["cluster"].to_numpy(), "w": list(kept)})

    kind = summed.schema["_cluster"].dataType.simpleString()
    parts = of_unit.mapInPandas(deviations, f"spec int, cluster {kind}, w array<double>")
    table = settle(parts.groupBy("spec", "cluster").agg(vector_sum("w").alias("w")))
    # one row for each model comes back
    totals = {r.spec: (r.g, np.array(r.w)) for r in table.groupBy("spec").agg(F.count("*").alias("g"), vector_sum("w").alias("w")).collect()}
    out = {}
    for number, spec in enumerate(specs):
        if number not in totals:
            raise ValueError(f"no rows to fit {spec.name}")
        clusters, w = totals[number]
        square, raw = _square(w[None, : len(i)], p)[0], w[len(i) : -1]
        dummies = []
        for place_no, period in enumerate(periods):
            present = [name for name, _ in marks[period] if raw[at[name]] > 0]
            # the common trend lies in the span of unit trends, so one more dummy goes
            dummies += present[2 if spec.trend and place_no == 0 else 1 :]
        own = table.filter(F.col("spec") == number).select("cluster", F.slice("w", 1, len(i)).alias("m"), F.xxhash64("cluster").alias("key"))
        out[spec.name] = (Moments(own, names, round(square[one, one]), clusters, square, round(w[-1]) if spec.trend else 0, at), dummies)
    return table.select("spec", F.slice("w", 1, len(i)).alias("m")), out


def panel_fits(df: DataFrame, unit: str, periods: list[str], cluster: str, specs: list[Spec]) -> DataFrame:
    """Tidy coefficients of several two-way panel models, each on its own complete cases.

    The score products of all models are added up in one job.
    """
    together, moments = within_moments(df, unit, periods, cluster, specs)
    models = [(s, m, [*s.regressors, *dummies]) for s, (m, dummies) in zip(specs, moments.values(), strict=True)]
    bread = [inverse(m.block(x, x)) for _, m, x in models]
    beta = [b @ m.block(x, [s.y])[:, 0] for b, (s, m, x) in zip(bread, models, strict=True)]
    places = [(m.at(x), m.where[s.y], len(m.columns)) for s, m, x in models]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = [np.zeros((len(x), len(x))) for x, _, _ in places]
        for batch in pieces(batches):
            for number, own in batch.groupby("spec"):
                x, y, p = places[number]
                mm = _square(np.stack(own["m"].to_numpy()), p)
                s = mm[:, x, y] - mm[:, x][:, :, x] @ beta[number]
                acc[number] += s.T @ s
        yield pd.DataFrame({"spec": range(len(acc)), "s": [a.ravel() for a in acc]})

    meat = {r.spec: np.array(r.s) for r in together.mapInPandas(scores, "spec int, s array<double>").groupBy("spec").agg(vector_sum("s").alias("s")).collect()}
    rows = []
    for i, (s, m, x) in enumerate(models):
        fit = fitted(m, x, s.y, bread[i], meat[i].reshape(len(x), len(x)))
        rows += [(*row, s.name) for row in coefficient_rows(fit, s.regressors)]
    return df.sparkSession.createDataFrame(rows, f"{COEFFICIENTS}, spec string")


def panel_fit(
    df: DataFrame,
    y: str,
    regressors: list[str],
    unit: str,
    periods: list[str],
    cluster: str,
    trend: str | None = None,
    spec: str = "spec",
) -> DataFrame:
    """Two-way panel regression on the complete cases of one specification."""
    return panel_fits(df, unit, periods, cluster, [Spec(spec, y, regressors, None, trend)])
