"""Many panel models from one pass against dense fits of each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelbook.operators import regression as R


def dense(x, y, cl, absorbed=0):
    bread = np.linalg.inv(x.T @ x)
    b = bread @ x.T @ y
    e = y - x @ b
    s = np.array([x[cl == g].T @ e[cl == g] for g in np.unique(cl)])
    n, k, g = len(y), x.shape[1] + absorbed, len(np.unique(cl))
    return b, np.sqrt(np.diag(bread @ (s.T @ s) @ bread) * g / (g - 1) * (n - 1) / (n - k)), 1 - e @ e / (y @ y)


def panel(seed=5, units=14, periods=7, nested=True):
    rng = np.random.default_rng(seed)
    u, t = np.repeat(np.arange(units), periods), np.tile(np.arange(periods), units)
    keep = rng.random(len(u)) > 0.1
    u, t = u[keep], t[keep]
    x, z = rng.normal(size=len(u)) + u, rng.normal(size=len(u))
    y = 1e4 + 1.5 * x - z + u + 0.3 * t + 0.2 * u * t + rng.normal(size=len(u))
    cl = u % 5 if nested else (u + t) % 5
    z = [None if rng.random() < 0.2 else float(v) for v in z]
    return [(int(a), int(b), int(c), float(d), w, float(e)) for a, b, c, d, w, e in zip(u, t, cl, x, z, y, strict=True)]


def by_hand(rows, regressors, trend=False, sample=lambda r: True):
    names = {"x": 3, "z": 4}
    rows = [r for r in rows if sample(r) and all(r[names[c]] is not None for c in regressors)]
    u, t, cl, y = (np.array([r[i] for r in rows], float) for i in (0, 1, 2, 5))
    du = (u[:, None] == np.unique(u)).astype(float)
    absorb = np.column_stack([du, du * t[:, None]]) if trend else du
    off = lambda a: a - absorb @ np.linalg.pinv(absorb) @ a
    marks = (t[:, None] == np.unique(t)[2 if trend else 1 :]).astype(float)
    x = off(np.column_stack([*[np.array([r[names[c]] for r in rows], float) for c in regressors], marks]))
    b, se, r2 = dense(x, off(y), cl, len(np.unique(u)) if trend else 0)
    return b[: len(regressors)], se[: len(regressors)], r2, len(rows)


@pytest.mark.parametrize("nested", [True, False])
def test_models_of_one_pass_equal_dense_fits(spark, nested):
    rows = panel(nested=nested)
    # a repeated period, a row without any model and a unit seen once
    rows += [(99, 3, 2, 5.0, 1.0, 1e4), (1, 2, 1 if nested else 3, 0.5, None, 1e4 + 3), (2, 2, 2 if nested else 4, None, None, 1.0)]
    df = spark.createDataFrame(rows, "u int, t int, c int, x double, z double, y double")
    specs = [
        R.Spec("plain", "y", ["x"]),
        R.Spec("both", "y", ["x", "z"]),
        R.Spec("lines", "y", ["x", "z"], trend="t"),
        R.Spec("late", "y", ["z"], F.col("t") >= 2),
        R.Spec("drop", "y", ["x"], ~F.col("c").isin(1)),
    ]
    got = {(r.spec, r.term): r for r in R.panel_fits(df, "u", ["t"], "c", specs).collect()}
    checks = {"lines": {"trend": True}, "late": {"sample": lambda r: r[1] >= 2}, "drop": {"sample": lambda r: r[2] != 1}}
    for s in specs:
        good = [r for r in rows if r[3] is not None]
        b, se, r2, n = by_hand(good, s.regressors, **checks.get(s.name, {}))
        for i, term in enumerate(s.regressors):
            r = got[s.name, term]
            assert np.isclose(r.b, b[i], rtol=1e-7) and np.isclose(r.se, se[i], rtol=1e-7) and np.isclose(r.r2, r2, rtol=1e-6) and r.n == n, (s.name, term)


def test_two_period_sets_and_empty_sample(spark):
    rng = np.random.default_rng(1)
    rows = [(u, yr, q, u % 3, float(rng.normal()), float(rng.normal())) for u in range(9) for yr in range(4) for q in range(1, 5)]
    df = spark.createDataFrame(rows, "u int, yr int, q int, c int, x double, y double")
    r = R.panel_fit(df, "y", ["x"], "u", ["yr", "q"], "c").first()
    a = np.array(rows, float)
    du = (a[:, :1] == np.unique(a[:, 0])).astype(float)
    off = lambda m: m - du @ np.linalg.pinv(du) @ m
    x = off(np.column_stack([a[:, 4], a[:, 1:2] == np.arange(1, 4), a[:, 2:3] == np.arange(2, 5)]))
    b, se, _ = dense(x, off(a[:, 5]), a[:, 3])
    assert np.isclose(r.b, b[0]) and np.isclose(r.se, se[0]) and r.k == 7
    with pytest.raises(ValueError, match="no rows"):
        R.panel_fit(df.filter("u < 0"), "y", ["x"], "u", ["yr"], "c")


def test_one_scan_serves_all_models(spark, tmp_path):
    spark.createDataFrame(panel(), "u int, t int, c int, x double, z double, y double").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    specs = [R.Spec(f"s{i}", "y", regs) for i, regs in enumerate((["x"], ["z"], ["x", "z"]))]
    summed, names, _ = R.unit_products(df, "u", ["t"], "c", specs)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "parquet" not in plan.lower()
    assert len(names) == 3 + 7 + 1


def test_matrices_of_a_batch_are_held_in_pieces():
    whole = pd.DataFrame({"i": range(2500)})
    cut = list(R.pieces(iter([whole, whole.iloc[:0], whole.iloc[:7]])))
    assert [len(c) for c in cut] == [1024, 1024, 452, 7] and [*pd.concat(cut)["i"]] == [*range(2500), *range(7)]
