"""Connected components of a table of links, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelbook.llm.common import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Large-star and small-star steps in turn: a node's larger neighbours, then its smaller
    ones, are linked to the smallest neighbour, until nothing changes; each node then
    links to its root alone. Minima are combined before the shuffle and links of a hub
    meet it in a join that adaptive execution can split; each round is written to the
    shared folder.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(ends.where("a > b").distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(new)
        drop_stored(edges)
        edges = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
