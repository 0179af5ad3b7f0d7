"""Estimators against dense numpy formulas and exact identities."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelbook.operators import bootstrap as BS
from parcelbook.operators import regression as R


def frame(spark, cols):
    names = list(cols)
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in t) for t in zip(*cols.values(), strict=True)]
    kinds = {"i": "long", "f": "double", "U": "string"}
    ddl = ", ".join(f"{n} {kinds[np.asarray(cols[n]).dtype.kind]}" for n in names)
    return spark.createDataFrame(rows, ddl)


def dense(x, y, cl, z=None, absorbed=0):
    z = x if z is None else z
    bread = np.linalg.inv(z.T @ x)
    b = bread @ z.T @ y
    e = y - x @ b
    groups = np.unique(cl)
    s = np.array([z[cl == g].T @ e[cl == g] for g in groups])
    n, k, g = len(y), x.shape[1] + absorbed, len(groups)
    c = g / (g - 1) * (n - 1) / (n - k)
    return b, np.sqrt(np.diag(bread @ (s.T @ s) @ bread.T) * c)


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(11)
    n = 120
    cl = rng.integers(0, 12, n)
    z, w = rng.normal(size=n), rng.normal(size=n)
    u = rng.normal(size=n) + 0.3 * cl
    d = 0.8 * z + 0.4 * w + u
    y = 2.0 * d - w + u + rng.normal(size=n)
    return {"y": y, "d": d, "w": w, "z": z, "one": np.ones(n), "cl": cl, "id": np.arange(n)}


def test_ols_and_hc1(spark, toy):
    df = frame(spark, toy)
    x = np.column_stack([toy["d"], toy["w"], toy["one"]])
    m = R.cluster_moments(df, ["d", "w", "one", "y"], "cl")
    fit = R.ols(m, ["d", "w", "one"], "y")
    b, se = dense(x, toy["y"], toy["cl"])
    assert np.allclose(fit.beta, b, rtol=1e-9) and np.allclose(fit.se, se, rtol=1e-9)
    # clusters of one row reproduce the heteroskedastic formula
    single = R.ols(R.cluster_moments(df, ["d", "w", "one", "y"], "id"), ["d", "w", "one"], "y")
    e = toy["y"] - x @ b
    bread = np.linalg.inv(x.T @ x)
    n, k = x.shape
    hc1 = np.sqrt(np.diag(bread @ (x.T * e**2) @ x @ bread) * n / (n - k))
    assert np.allclose(single.se, hc1, rtol=1e-9)


def test_two_stage_and_first_stage(spark, toy):
    df = frame(spark, toy)
    m = R.cluster_moments(df, ["d", "w", "z", "one", "y"], "cl")
    fit = R.two_stage(m, "y", "d", ["w", "one"], ["z"])
    x = np.column_stack([toy["d"], toy["w"], toy["one"]])
    zz = np.column_stack([toy["z"], toy["w"], toy["one"]])
    b, se = dense(x, toy["y"], toy["cl"], zz)
    assert np.allclose(fit.beta, b) and np.allclose(fit.se, se)
    same = R.two_stage(m, "y", "d", ["w", "one"], ["d"])
    plain = R.ols(m, ["d", "w", "one"], "y")
    assert np.allclose(same.beta, plain.beta) and np.allclose(same.se, plain.se)
    bz, sez = dense(zz, toy["d"], toy["cl"])
    assert np.isclose(R.first_stage_f(m, "d", ["w", "one"], ["z"]), (bz[0] / sez[0]) ** 2)


def test_anderson_rubin_matches_direct_fits(spark, toy):
    m = R.cluster_moments(frame(spark, toy), ["d", "w", "z", "one", "y"], "cl")
    zz = np.column_stack([toy["z"], toy["w"], toy["one"]])
    for r in R.anderson_rubin(m, "y", "d", ["w", "one"], ["z"], [0.0, 1.5, 2.0]).collect():
        b, se = dense(zz, toy["y"] - r["candidate"] * toy["d"], toy["cl"])
        assert np.isclose(r["statistic"], (b[0] / se[0]) ** 2)


def panel():
    rng = np.random.default_rng(7)
    u, t = np.repeat(np.arange(9), 8), np.tile(np.arange(8), 9)
    keep = rng.random(72) > 0.12
    u, t = u[keep], t[keep]
    x = rng.normal(size=len(u)) + u
    return {"u": u, "t": t, "x": x, "y": 1.5 * x + u + 0.3 * t + 0.2 * u * t + rng.normal(size=len(u))}


def test_within_equals_dummies(spark):
    p = panel()
    got = R.panel_fit(frame(spark, p), "y", ["x"], "u", ["t"], "u").first()
    du = (p["u"][:, None] == np.unique(p["u"])).astype(float)
    dt = (p["t"][:, None] == np.unique(p["t"])[1:]).astype(float)
    b = np.linalg.lstsq(np.column_stack([p["x"], du, dt]), p["y"], rcond=None)[0]
    assert np.isclose(got["b"], b[0]) and got["n"] == len(p["y"]) and got["k"] == 8


def test_unit_trends_equal_explicit_trend_columns(spark):
    p = panel()
    got = R.panel_fit(frame(spark, p), "y", ["x"], "u", ["t"], "u", trend="t").first()
    units = np.unique(p["u"])
    du = (p["u"][:, None] == units).astype(float)
    dt = (p["t"][:, None] == np.unique(p["t"])[1:]).astype(float)
    tr = du[:, 1:] * p["t"][:, None]
    demean = lambda a: a - du @ np.linalg.pinv(du) @ a
    x = demean(np.column_stack([p["x"], dt, tr]))
    b, se = dense(x, demean(p["y"]), p["u"])
    assert np.isclose(got["b"], b[0]) and np.isclose(got["se"], se[0]) and got["k"] == x.shape[1]


def test_singular_design_is_an_error(spark, toy):
    df = frame(spark, toy).withColumn("twice", F.col("d") * 2)
    m = R.cluster_moments(df, ["d", "twice", "y"], "cl")
    with pytest.raises(ValueError, match="singular"):
        R.ols(m, ["d", "twice"], "y")


def brute_t(x, y, cl, j, v):
    """Replicate statistic by refitting the full model on y* = X0 b0 + v e0."""
    keep = [c for c in range(x.shape[1]) if c != j]
    f0 = x[:, keep] @ np.linalg.lstsq(x[:, keep], y, rcond=None)[0]
    b, se = dense(x, f0 + v * (y - f0), cl)
    return b[j] / se[j]


def test_wild_statistics_equal_refits(spark, toy):
    m = R.cluster_moments(frame(spark, toy), ["d", "w", "one", "y"], "cl")
    draws = {r["rep"]: r["statistic"] for r in BS.replicate_statistics(m, ["d", "w", "one"], "y", ["d"], None, [0.0], 20, 5).collect()}
    x = np.column_stack([toy["d"], toy["w"], toy["one"]])
    for rep in (0, 1, 7, 20):
        v = np.array([sign(5, rep, c) for c in toy["cl"]])
        assert np.isclose(draws[rep], brute_t(x, toy["y"], toy["cl"], 0, v), rtol=1e-7)


def sign(seed, rep, cluster):
    """The drawing rule, bit by bit."""
    digest = int(hashlib.md5(f"{seed}:{rep // 128}:{cluster}".encode()).hexdigest(), 16)
    return 1 if rep == 0 or digest >> (127 - rep % 128) & 1 else -1


def test_signs_follow_the_rule_in_every_block():
    v = BS.signs(["a", "7", ""], 300, 9)
    assert v.shape == (301, 3) and v.tolist() == [[sign(9, r, c) for c in ("a", "7", "")] for r in range(301)]
    assert abs(BS.signs([str(i) for i in range(200)], 499, 1)[1:].mean()) < 0.02


def test_inversion_shares_draws_and_is_deterministic(spark, toy):
    m = R.cluster_moments(frame(spark, toy), ["d", "w", "one", "y"], "cl")
    x = ["d", "w", "one"]
    zero = BS.wild_t(m, x, "y", "d", reps=99, seed=3).first()
    grid = {r["candidate"]: r for r in BS.wild_inversion(m, x, "y", "d", [0.0, 2.0, 2.5], reps=99, seed=3).collect()}
    again = {r["candidate"]: r["p"] for r in BS.wild_inversion(m, x, "y", "d", [0.0, 2.0, 2.5], reps=99, seed=3).collect()}
    assert np.isclose(zero["p"], grid[0.0]["p"]) and np.isclose(zero["observed"], grid[0.0]["observed"])
    assert {k: r["p"] for k, r in grid.items()} == again
    assert grid[0.0]["p"] <= 0.02 and all(0 < r["p"] <= 1 for r in grid.values())


def test_wild_ar_with_two_instruments_matches_refits(spark, toy):
    t = dict(toy)
    t["z2"] = np.random.default_rng(2).normal(size=len(t["y"])) + t["z"] * 0.2
    m = R.cluster_moments(frame(spark, t), ["d", "w", "z", "z2", "one", "y"], "cl")
    draws = BS.replicate_statistics(m, ["z", "z2", "w", "one"], "y", ["z", "z2"], "d", [1.0], 3, 9)
    got = {r["rep"]: r["statistic"] for r in draws.collect()}
    x = np.column_stack([t["z"], t["z2"], t["w"], t["one"]])
    e = t["y"] - t["d"]
    bread = np.linalg.inv(x.T @ x)
    b = bread @ x.T @ e
    r = e - x @ b
    groups = np.unique(t["cl"])
    s = np.array([x[t["cl"] == g].T @ r[t["cl"] == g] for g in groups])
    n, k, g = len(e), 4, len(groups)
    v = bread @ (s.T @ s) @ bread * g / (g - 1) * (n - 1) / (n - k)
    assert np.isclose(got[0], b[:2] @ np.linalg.solve(v[:2, :2], b[:2]) / 2)


def test_inversion_summary_warnings(spark):
    rows = [("a", c, k) for c, k in zip([0.0, 1.0, 2.0, 3.0], [True, False, True, False], strict=True)] + [("b", c, False) for c in [0.0, 1.0, 2.0, 3.0]]
    df = spark.createDataFrame(rows, "model string, candidate double, keep boolean")
    got = {r["model"]: r for r in BS.inversion_summary(df, ["model"], (0.0, 3.0)).collect()}
    assert got["a"]["warnings"] == "accepted_set_may_extend_below_grid;disjoint_accepted_set" and got["a"]["accepted"] == 2
    assert got["b"]["warnings"] == "no_candidate_accepted_at_this_resolution" and got["b"]["accepted_min"] is None
