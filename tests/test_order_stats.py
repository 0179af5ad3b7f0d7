"""Ranks and quantiles against brute force, with the splitting of large groups forced."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from parcelbook.operators import order_stats as Q


def data(seed=1, n=400):
    rng = random.Random(seed)
    # one group holds most rows; many ties
    return [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), float(rng.randint(0, 60)), rng.randint(0, 4)) for i in range(n)]


@pytest.mark.parametrize("pieces", [None, 5])
def test_average_and_first_rank(spark, pieces):
    rows = data()
    df = spark.createDataFrame(rows, "id int, g string, v double, w int")
    got = {r["id"]: (r["a"], r["f"]) for r in Q.rank_values(Q.rank_values(df, ["g"], "v", "a", pieces=pieces), ["g"], "v", "f", "first", pieces=pieces).collect()}
    for i, g, v, _ in rows:
        peers = [x[2] for x in rows if x[1] == g]
        less, same = sum(p < v for p in peers), sum(p == v for p in peers)
        assert got[i] == (less + (same + 1) / 2, less + 1)


@pytest.mark.parametrize("pieces", [None, 5])
def test_global_rank(spark, pieces):
    rows = data(2)
    df = spark.createDataFrame(rows, "id int, g string, v double, w int")
    got = {r["id"]: r["a"] for r in Q.rank_values(df, [], "v", "a", pieces=pieces).collect()}
    for i, _, v, _ in rows:
        assert got[i] == sum(x[2] < v for x in rows) + (sum(x[2] == v for x in rows) + 1) / 2


@pytest.mark.parametrize("pieces", [None, 5])
def test_quantile_rules(spark, pieces):
    rows = data(3)
    df = spark.createDataFrame(rows, "id int, g string, v double, w int")
    wanted = {k: Q.rule(k) for k in ("averaging", "upper", "lower", "quarter", "three")} | {"p90": Q.rule("index", 0.9), "disc": Q.rule("discrete", 0.5)}
    got = {r["g"]: r.asDict() for r in Q.quantiles(df, ["g"], "v", wanted, pieces=pieces).collect()}
    weighted = {r["g"]: r.asDict() for r in Q.quantiles(df, ["g"], "v", {"m": Q.rule("averaging"), "d": Q.rule("discrete", 0.5)}, weight="w", pieces=pieces).collect()}
    for g in {r[1] for r in rows}:
        s = sorted(r[2] for r in rows if r[1] == g)
        n = len(s)
        o = got[g]
        assert o["total"] == n
        assert (o["averaging"], o["upper"], o["lower"], o["quarter"], o["three"]) == (statistics.median(s), s[n // 2], s[(n - 1) // 2], s[n // 4], s[3 * n // 4])
        assert o["p90"] == s[min(n - 1, int(n * 0.9))] and o["disc"] == statistics.median_low(s)
        rep = sorted(r[2] for r in rows if r[1] == g for _ in range(r[3]))
        assert weighted[g]["m"] == statistics.median(rep) and weighted[g]["d"] == statistics.median_low(rep)


def test_weighted_cut_midpoint(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (4.0, 2.0), (9.0, -1.0)], "v double, w double")
    r = Q.weighted_cuts(df, [], "v", "w", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.5, 3.0, 4.0)


@pytest.mark.parametrize("pieces", [None, 5])
def test_null_groups_and_null_values(spark, pieces):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", 2.0), (None, 3.0)], "g string, v double")
    got = sorted(((r["g"], r["v"], r["k"]) for r in Q.rank_values(df, ["g"], "v", "k", pieces=pieces).collect()), key=str)
    assert got == sorted([(None, 1.0, 1.0), (None, None, None), ("a", 2.0, 1.0), (None, 3.0, 2.0)], key=str)


def test_terciles_middle_takes_the_rest(spark):
    df = spark.createDataFrame([(i, "g", float(i // 2)) for i in range(8)], "id int, g string, v double")
    got = {r["id"]: r["t"] for r in Q.terciles(df, ["g"], "v", "id", "t").collect()}
    assert [got[i] for i in range(8)] == ["lowest"] * 2 + ["middle"] * 4 + ["highest"] * 2


def test_group_by_cuts_ties_go_down(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(Q.group_by_cuts(F.col("v"), [1.0, 2.0, 3.0])).collect()] == [1, 2, 3, 3, 4]


@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,3)", "timestamp"])
def test_ranks_of_every_ordered_type_in_forced_ranges(spark, kind):
    days = [f"20{10 + i % 7}-0{1 + i % 9}-1{i % 5}" for i in range(60)]
    cast = F.col("d") if kind in ("string", "date", "timestamp") else F.translate("d", "-", "")
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d string").select("id", "d", cast.cast(kind).alias("v"))
    got = {r.id: r.k for r in Q.rank_values(df, [], "v", "k", "first", pieces=7).collect()}
    assert all(got[i] == 1 + sum(x < d for x in days) for i, d in enumerate(days))


def test_places_of_all_rows(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("s"))
    got = [(r.s, r.k) for r in sorted(Q.places(df, [F.desc_nulls_last("s"), F.col("k")], "place").collect(), key=lambda r: r.place)]
    assert got == sorted(got, key=lambda t: (t[0] is None, -(t[0] or 0), t[1])) and len(got) == 1000


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_brackets_narrow_to_the_same_values(spark, monkeypatch, by):
    from parcelbook.operators import selection

    monkeypatch.setattr(selection, "LAST_ROWS", 10)
    monkeypatch.setattr(selection, "BINS", 24)
    rng = random.Random(8)
    odd = [0.0, -1e300, 1e300, 1e-300, 5.0, 5.0 + 1e-12]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 9), rng.choice(odd), float(rng.randint(0, 9))]), rng.randint(0, 3)) for _ in range(900)]
    rows += [("c", 1, None, 1)]
    df = spark.createDataFrame(rows, "g string, h int, v double, w int").repartition(3)
    wanted = {k: Q.rule(k) for k in ("averaging", "upper", "quarter", "three")} | {"p90": Q.rule("index", 0.9), "d": Q.rule("discrete", 0.25)}
    shown = ["total", *wanted]
    key = lambda r: tuple(r[c] for c in by)
    for weight in (None, "w"):
        narrow = {key(r): [r[c] for c in shown] for r in Q.quantiles(df, by, "v", wanted, weight=weight).collect()}
        ranged = {key(r): [r[c] for c in shown] for r in Q.quantiles(df, by, "v", wanted, weight=weight, pieces=3).collect()}
        assert narrow == ranged and len(narrow) == (1 if not by else len({key(dict(zip("ghvw", r, strict=True))) for r in rows if r[2] is not None}))
    fractions = {"a": 0.1, "b": 0.5, "c": 0.9}
    cuts = {key(r): [r[c] for c in ("total", *fractions)] for r in Q.weighted_cuts(df, by, "v", "w", fractions).collect()}
    assert cuts == {key(r): [r[c] for c in ("total", *fractions)] for r in Q.weighted_cuts(df, by, "v", "w", fractions, pieces=3).collect()}


@pytest.mark.parametrize("values", [[1, 2, 2, 10**17 + 1, 10**17 + 2, 10**17 + 3], [], [None], [7]])
def test_brackets_of_whole_numbers_and_nothing(spark, monkeypatch, values):
    from parcelbook.operators import selection

    monkeypatch.setattr(selection, "LAST_ROWS", 0)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    wanted = {"m": Q.rule("upper"), "q": Q.rule("three")}
    assert [tuple(r) for r in Q.quantiles(df, [], "v", wanted).collect()] == [tuple(r) for r in Q.quantiles(df, [], "v", wanted, pieces=2).collect()]


def test_brackets_shuffle_histograms_only(spark):
    from parcelbook.operators import selection

    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    rows = selection._in_brackets(df, ["g"], "v", F.lit(1), {((g,), 0.2, 0.4): selection.Bracket(0.2, 0.4, 0, 1) for g in range(3)})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
