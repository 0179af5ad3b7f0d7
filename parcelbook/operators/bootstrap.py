"""Wild cluster bootstraps on per-cluster cross products.

With the null imposed, a replicate draws one sign v_g per cluster. Writing
b_g = X_g'r0 (restricted residual), N_g = B_z X_g'X_g and r_g = B_z b_g, where B_z are
the tested rows of inv(X'X), a replicate needs only

    delta = B sum_g v_g b_g          and          sum_g v_g r_g (x) N_g

so every task reduces its clusters to one small row per replicate and candidate, and
replicates never need all clusters in one place. Signs are bits of
md5("seed:block:cluster"), so all candidates share the same draws, a lost task repeats
them exactly, and any engine that has md5 can draw them too. Replicate 0 has all signs
+1, which is the observed statistic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelbook.operators.regression import Moments, _square, inverse, sum_over_clusters
from parcelbook.session import settle

_REP_BLOCK, BITS = 256, 128
# fixed values: warnings of a tested grid
NONE_ACCEPTED = "no_candidate_accepted_at_this_resolution"
OPEN_BELOW = "accepted_set_may_extend_below_grid"
OPEN_ABOVE = "accepted_set_may_extend_above_grid"
DISJOINT = "disjoint_accepted_set"


def signs(clusters: list[str], reps: int, seed: int) -> np.ndarray:
    """+1 / -1 as (replicate, cluster) for replicates 0 to ``reps``; replicate 0 is all +1.

    The sign of replicate r is +1 where bit r % 128, from the first digit on, of
    md5("seed:r div 128:cluster") is set.
    """
    blocks = range(reps // BITS + 1)
    drawn = b"".join(hashlib.md5(f"{seed}:{b}:{c}".encode(), usedforsecurity=False).digest() for c in clusters for b in blocks)
    bits = np.unpackbits(np.frombuffer(drawn, np.uint8)).reshape(len(clusters), -1)[:, : reps + 1]
    v = 2 * bits.T.astype(np.int8) - 1
    v[0] = 1
    return v


def replicate_statistics(
    m: Moments,
    x: list[str],
    y: str,
    tested: list[str],
    moved: str | None,
    candidates: list[float],
    reps: int,
    seed: int,
) -> DataFrame:
    """(candidate, rep, statistic): signed t for one tested term, Wald F for several.

    The response of a candidate c is ``y - c * moved``.
    """
    order = [*tested, *[c for c in x if c not in tested]]
    k, kz, nc = len(order), len(tested), len(candidates)
    xi, yi = m.at(order), m.where[y]
    mi = m.where[moved] if moved else None
    p = len(m.columns)
    xx, xy = m.block(order, order), m.block(order, [y])[:, 0]
    xm = m.block(order, [moved])[:, 0] if moved else np.zeros(k)
    bread = inverse(xx)
    bz = bread[:kz]
    keep = slice(kz, k)
    gamma = np.zeros((nc, k))
    if k > kz:
        solver = inverse(xx[keep, keep])
        for c, value in enumerate(candidates):
            gamma[c, keep] = solver @ (xy - value * xm)[keep]
    cand = np.array(candidates, dtype=float)

    def pieces(mm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gx = mm[:, xi][:, :, xi]
        gy = mm[:, xi, yi]
        gm = mm[:, xi, mi] if mi is not None else np.zeros_like(gy)
        # restricted residual scores per cluster and candidate
        b = gy[:, None, :] - cand[None, :, None] * gm[:, None, :] - np.einsum("gij,cj->gci", gx, gamma)
        n = np.einsum("zi,gij->gzj", bz, gx)
        return b, np.einsum("zi,gci->gcz", bz, b), n

    def constants(mm: np.ndarray, _keys: np.ndarray) -> np.ndarray:
        _, r, n = pieces(mm)
        return np.concatenate(
            [np.einsum("gcz,gcq->czq", r, r).ravel(), np.einsum("gzi,gqj->zqij", n, n).ravel()]
        )

    flat = sum_over_clusters(m, nc * kz * kz + kz * kz * k * k, constants)
    rr = flat[: nc * kz * kz].reshape(nc, kz, kz)
    nn = flat[nc * kz * kz :].reshape(kz, kz, k, k)
    width = k + kz * kz * k
    scale = m.correction(k)

    def reduce_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((reps + 1, nc * width))
        seen = False
        for batch in batches:
            if not len(batch):
                continue
            seen = True
            b, r, n = pieces(_square(np.stack(batch["m"].to_numpy()), p))
            rn = np.einsum("gcz,gqj->gczqj", r, n).reshape(len(batch), nc, kz * kz * k)
            terms = np.concatenate([b, rn], axis=2).reshape(len(batch), nc * width)
            v = signs(batch["label"].tolist(), reps, seed)
            for lo in range(0, reps + 1, _REP_BLOCK):
                acc[lo : lo + _REP_BLOCK] += v[lo : lo + _REP_BLOCK].astype(np.float64) @ terms
        if seen:
            stacked = acc.reshape(reps + 1, nc, width)
            for c in range(nc):
                yield pd.DataFrame(
                    {"cand": c, "rep": np.arange(reps + 1), "s": list(stacked[:, c, :])}
                )

    # few clusters need few tasks: each task emits one row per replicate
    tasks = max(1, min(m.table.rdd.getNumPartitions(), m.clusters // 64))
    partial = (
        m.table.select(F.coalesce(F.col("cluster").cast("string"), F.lit("")).alias("label"), "m").coalesce(tasks).mapInPandas(reduce_clusters, "cand int, rep int, s array<double>")
    )
    summed = partial.groupBy("cand", "rep").agg(
        F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")
    )

    def statistic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.stack(batch["s"].to_numpy())
            c = batch["cand"].to_numpy()
            delta = s[:, :k] @ bread.T
            rn = s[:, k:].reshape(-1, kz, kz, k)
            cross = np.einsum("rzqj,rj->rzq", rn, delta)
            quad = np.einsum("zqij,ri,rj->rzq", nn, delta, delta)
            v = scale * (rr[c] - cross - cross.transpose(0, 2, 1) + quad)
            top = delta[:, :kz]
            if kz == 1:
                var = v[:, 0, 0]
                se = np.sqrt(np.where(var > 1e-24, var, 0.0))
                out = np.divide(top[:, 0], se, out=np.zeros(len(se)), where=se > 1e-12)
            else:
                out = np.array([
                    float(t @ np.linalg.solve(a, t)) / kz if np.linalg.matrix_rank(a) == kz else 0.0
                    for t, a in zip(top, v, strict=True)
                ])
            yield pd.DataFrame({"candidate": cand[c], "rep": batch["rep"], "statistic": out})

    return summed.mapInPandas(statistic, "candidate double, rep int, statistic double")


def summarise(draws: DataFrame, reps: int, seed: int, levels: dict[str, float]) -> DataFrame:
    """Observed value, finite-replicate p and index quantiles of the draws per candidate.

    The sorted array holds ``reps`` numbers, a parameter of the call.
    """
    star = F.when(F.col("rep") > 0, F.col("statistic"))
    base = settle(draws).groupBy("candidate").agg(
        F.max(F.when(F.col("rep") == 0, F.col("statistic"))).alias("observed"),
        F.sort_array(F.collect_list(star)).alias("_sorted"),
    )
    # a draw that repeats the observed signs ties with it, in whatever order the sums were taken
    extreme = F.size(F.filter("_sorted", lambda t: F.abs(t) >= F.abs(F.col("observed")) * (1 - 1e-9)))
    out = base.withColumn("p", (extreme + 1) / F.lit(float(reps + 1)))
    for name, q in levels.items():
        out = out.withColumn(name, F.col("_sorted")[min(reps - 1, int(q * reps))])
    return out.drop("_sorted").withColumn("reps", F.lit(reps)).withColumn("seed", F.lit(seed))


def wild_t(m: Moments, x: list[str], y: str, term: str, reps: int = 999, seed: int = 20261006) -> DataFrame:
    """Bootstrap-t of one coefficient under a zero null."""
    draws = replicate_statistics(m, x, y, [term], None, [0.0], reps, seed)
    return summarise(draws, reps, seed, {"t_lo": 0.025, "t_hi": 0.975}).withColumn("term", F.lit(term))


def wild_inversion(
    m: Moments, x: list[str], y: str, term: str, grid: list[float], reps: int = 999, seed: int = 20261006, alpha: float = 0.05
) -> DataFrame:
    """p of every candidate value of one coefficient with shared draws."""
    draws = replicate_statistics(m, x, y, [term], term, grid, reps, seed)
    return summarise(draws, reps, seed, {}).withColumn("keep", F.col("p") >= alpha)


def wild_anderson_rubin(
    m: Moments, y: str, d: str, w: list[str], z: list[str], grid: list[float], reps: int = 299, seed: int = 20261007, alpha: float = 0.05
) -> DataFrame:
    """Anderson-Rubin set whose critical value is bootstrapped at every grid point."""
    draws = replicate_statistics(m, [*z, *w], y, z, d, grid, reps, seed)
    if len(z) == 1:
        draws = draws.withColumn("statistic", F.col("statistic") * F.col("statistic"))
    out = summarise(draws, reps, seed, {"critical": 1 - alpha})
    return out.withColumn("keep", F.col("observed") < F.col("critical"))


def inversion_summary(tested: DataFrame, by: list[str], grid_bounds: tuple[float, float]) -> DataFrame:
    """Accepted range, count and warnings of each model's tested grid."""
    lo, hi = grid_bounds
    kept = F.col("keep")
    agg = tested.groupBy(*by).agg(
        F.min(F.when(kept, F.col("candidate"))).alias("accepted_min"),
        F.max(F.when(kept, F.col("candidate"))).alias("accepted_max"),
        F.count_if(kept).alias("accepted"),
        F.count("*").alias("tested"),
        F.coalesce(F.bool_or(kept & (F.col("candidate") == lo)), F.lit(False)).alias("_low"),
        F.coalesce(F.bool_or(kept & (F.col("candidate") == hi)), F.lit(False)).alias("_high"),
        F.sort_array(F.collect_list(F.struct("candidate", "keep"))).alias("_grid"),
    )
    # a gap: some refused candidate lies between two accepted ones
    gap = F.exists(
        "_grid",
        lambda g: ~g["keep"] & (g["candidate"] > F.col("accepted_min")) & (g["candidate"] < F.col("accepted_max")),
    )
    return agg.withColumn(
        "warnings",
        F.concat_ws(
            ";",
            F.when(F.col("accepted") == 0, NONE_ACCEPTED),
            F.when(F.col("_low"), OPEN_BELOW),
            F.when(F.col("_high"), OPEN_ABOVE),
            F.when(gap, DISJOINT),
        ),
    ).drop("_low", "_high", "_grid")
