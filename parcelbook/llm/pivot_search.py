"""Exact top-k inner products by pivot tables: distances to pivots bound every score from above."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, table
from parcelbook.llm.hard_negatives import WHOLE_SQL
from parcelbook.llm.vector_blocks import LOW, best_of, blocks, first, over_grid, products, whole_numbers

PIVOTS, SAMPLE = 32, 2000
#: Queries bounded at once; candidates evaluated in the first round, doubled in each further one.
SLICE, ROUND = 32, 256
#: Share of a group's rows above which the rest is evaluated by one matrix product.
DENSE = 0.25


def norms(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64))


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots; what the narrower side lacks counts as zero."""
    width = min(v.shape[1], pivots.shape[1])
    apart = norms(v)[:, None] + norms(pivots)[None] - 2 * v[:, :width].astype(np.float64) @ pivots[:, :width].astype(np.float64).T
    return np.sqrt(np.maximum(apart, 0))


def farthest(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots of the sample, each the farthest from those before it."""
    chosen = [0]
    apart = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        at = int(apart.argmax())
        if apart[at] <= 0:
            break
        chosen.append(at)
        apart = np.minimum(apart, distances(sample, sample[at : at + 1])[:, 0])
    return sample[chosen]


def choose_pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots from the ``sample`` rows of smallest id hash: the only rows that reach the driver.

    Any pivots give exact results; these only decide how tight the bounds are.
    """
    held = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    width = max([1, *map(len, held)])
    return farthest(np.array([[*v, *[0] * (width - len(v))] for v in held], np.int64).reshape(len(held), width), count) if held else np.zeros((1, 1), np.int64)


def upper_bounds(q_norm: np.ndarray, q_table: np.ndarray, norm: np.ndarray, by_pivot: np.ndarray) -> np.ndarray:
    """No score of a query with a row exceeds this.

    |q - x| is at least |d(q, p) - d(x, p)| for every pivot, and the inner product is
    (|q|^2 + |x|^2 - |q - x|^2) / 2. Slack covers the rounding of the 32-bit tables.
    """
    least = np.zeros((len(q_norm), len(norm)), np.float32)
    spare = np.empty_like(least)
    for p in range(len(by_pivot)):
        np.subtract(q_table[:, p : p + 1], by_pivot[p][None], out=spare)
        np.abs(spare, out=spare)
        np.maximum(least, spare, out=least)
    slack = 1e-6 * float(max(q_table.max(initial=0), by_pivot.max(initial=0)))
    apart = np.maximum(least.astype(np.float64) - slack, 0)
    both = q_norm[:, None] + norm[None]
    return (both - apart * apart) / 2 + 1e-9 * both + 1


def nearest(q: np.ndarray, own: np.ndarray, bound: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, score, id) of the ``k`` best rows of each query, and how many scores were computed.

    Candidates are evaluated in the order of their bounds until no bound reaches the k-th
    best score. A query whose first round leaves more than DENSE of the rows goes through
    one matrix product with the like, which skips nothing and so is exact too.
    """
    bound = np.where(own[:, None] == ids[None], -np.inf, bound)
    parts, dense, evaluated = [], [], 0
    for i in range(len(q)):
        step = min(ROUND, len(ids))
        at = np.argpartition(-bound[i], step - 1)[:step]
        at = at[np.isfinite(bound[i][at])]
        score = products(q[i : i + 1], v[at])[0]
        kth = np.partition(score, len(score) - k)[-k] if len(score) >= k else LOW
        evaluated += len(at)
        done = np.zeros(len(ids), bool)
        done[at] = True
        left = np.flatnonzero((bound[i] >= kth) & ~done & np.isfinite(bound[i]))
        if len(left) > DENSE * len(ids):
            dense.append(i)
            continue
        left = left[np.argsort(-bound[i][left], kind="stable")]
        lo = 0
        while lo < len(left) and bound[i][left[lo]] >= kth:
            now = left[lo : lo + step]
            more = products(q[i : i + 1], v[now])[0]
            evaluated += len(now)
            at, score = np.append(at, now), np.append(score, more)
            kth = np.partition(score, len(score) - k)[-k] if len(score) >= k else LOW
            lo, step = lo + step, 2 * step
        _, best = best_of(np.full(len(at), i), score, ids[at], k, np.arange(len(at)))
        parts.append((np.full(len(best), i), score[best], ids[at[best]]))
    if dense:
        s = products(q[dense], v)
        s[own[dense][:, None] == ids[None]] = LOW
        r, c = first(s, ids, k)
        parts.append((np.array(dense)[r], s[r, c], ids[c]))
        evaluated += s.size
    out = [np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]) for j in range(3)]
    return out[0], out[1], out[2], evaluated


def search(vectors: DataFrame, every: int, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best inner products of floor(256 * x).

    Queries are the ids that ``every`` divides, candidates all rows but the query's own;
    ties go to smaller ids. Each row carries its distances to the pivots. Where vectors lie
    in no clusters the bounds rule out little, and most scores are computed.

    Rows with a null id, vector or component, or a non-finite one, take no part; rows that
    share an id count as one (``whole_numbers``); an empty table gives no rows.
    """
    rows = whole_numbers(vectors)
    chosen = choose_pivots(rows, pivots, sample)

    def pivot_table(v: np.ndarray) -> list[np.ndarray]:
        return [distances(v, chosen).astype(np.float32)]

    def visit(a: list[np.ndarray], group: list[list[np.ndarray]]) -> pa.Table:
        ids, width = np.concatenate([g[0] for g in group]), max(g[1].shape[1] for g in group)
        v = np.concatenate([np.pad(g[1], ((0, 0), (0, width - g[1].shape[1]))) for g in group])
        norm, by_pivot = norms(v), np.ascontiguousarray(np.concatenate([g[2] for g in group]).T)
        q_norm = norms(a[1])
        parts = []
        for lo in range(0, len(a[0]), SLICE):
            s = slice(lo, lo + SLICE)
            bound = upper_bounds(q_norm[s], a[2][s], norm, by_pivot)
            i, score, best, _ = nearest(a[1][s], a[0][s], bound, v, ids, k)
            parts.append((a[0][s][i], score, best))
        query, score, best = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"query_id": query, "vec_id": best, "score": score})

    asked = blocks(whole_numbers(vectors.where(F.col("vec_id") % every == 0)), make=pivot_table)
    pairs = over_grid(asked, blocks(rows, make=pivot_table), visit, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows for every fiftieth vector among all."""
    return search(table(spark, folder, "embeddings"), 50)


QUERIES: dict[str, Query] = {"op13_pivot_search": op13_pivot_search}
ORACLES: dict[str, str] = {
    "op13_pivot_search": f"""WITH x AS MATERIALIZED ({WHOLE_SQL.format(more="", where="")}),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
