"""Null, duplicate, gap and empty-group rules of joins, aggregates, periods and quality rules."""

import pytest
from pyspark.sql import functions as F

from parcelbook.operators import aggregates as A
from parcelbook.operators import correlation as C
from parcelbook.operators import joins as J
from parcelbook.operators import measures as M
from parcelbook.operators import order_stats as Q
from parcelbook.operators import periods as P
from parcelbook.operators import quality as QL
from parcelbook.operators import shiftshare as SS
from parcelbook.operators import survey as V


def test_unique_match_reasons(spark, rows):
    left = spark.createDataFrame([("a", "Bruc"), ("b", "Roca"), ("c", "Vic"), ("d", "Olot"), ("e", "Pals")], "k string, name string")
    right = spark.createDataFrame([("a", "Bruc, El", 5.0), ("b", "Roca", 1.0), ("b", "Roca", 2.0), ("c", "Vic (provincia)", 3.0), ("d", "Olot", 0.0)], "k string, label string, v double")
    assert rows(J.unique_match(left, right, "k", "name", "label", "v"), "k", "status", "value") == [
        ("a", "valid", 5.0), ("b", "duplicate", None), ("c", "label_mismatch", None), ("d", "nonpositive", None), ("e", "missing", None)]


def test_homonyms_and_crosswalk(spark, rows):
    df = spark.createDataFrame([("k", "X", 1), ("k", "Y", 2), ("m", "Z", 3)], "key string, name string, a int")
    assert rows(J.quarantine_homonyms(df, ["key"], "name", ["a"]), "key", "a") == [("k", None), ("k", None), ("m", 3)]
    a = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3), ("r", 4)], "key string, ca int")
    b = spark.createDataFrame([("p", 9), ("q", 8), ("s", 7)], "key string, cb int")
    assert rows(J.crosswalk_check(a, b, "key", "ca", "cb"), "key", "pair_status") == [("p", "ok"), ("q", "duplicate"), ("r", "missing_right"), ("s", "missing_left")]


@pytest.mark.parametrize("width", [1.0, 7.0])
def test_tolerance_antijoin_is_exact(spark, width):
    nums = spark.createDataFrame([(v, 0.25) for v in (0.0, 9.74, 9.75, 10.3, 10.76, -3.0, 10.0, 10.0)], "v double, s double")
    claims = spark.createDataFrame([(10.0, 0.5), (-3.2, 0.1)], "c double, t double")
    got = sorted(r["v"] for r in J.unmatched_numbers(nums, claims, "v", "s", "c", "t", width).collect())
    assert got == sorted(v for v in (0.0, 9.74, 9.75, 10.3, 10.76, -3.0, 10.0, 10.0) if not any(abs(v - c) <= t + 0.25 for c, t in ((10.0, 0.5), (-3.2, 0.1))))


def test_all_or_nothing_and_single(spark, rows):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", None, False), ("c", 4, True)], "g string, v int, h boolean")
    agg = df.groupBy("g").agg(A.all_or_nothing(F.col("v"), F.col("h")).alias("t"), A.only_if_single(F.col("v") > 0, F.col("v")).alias("s"))
    assert rows(agg, "g", "t", "s") == [("a", 3, None), ("b", None, 1), ("c", None, 4)]


def test_merged_unit_needs_all_members(spark, rows):
    df = spark.createDataFrame([("x", 1, 5), ("y", 1, 6), ("x", 2, 7)], "u string, t int, v int")
    got = rows(A.with_local_aggregates(df, "u", ["t"], ["v"], "ALL", {"x+y": ["x", "y"]}).filter("u = 'x+y'"), "t", "v")
    assert got == [(1, 11), (2, None)]


def test_guarded_corr(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("c", 3.0, 1.0), ("c", 3.0, 2.0), ("c", None, 5.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(A.guarded_corr("x", "y").alias("r")).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None and got["c"] is None


def test_largest_splits_hot_groups(spark):
    df = spark.range(500).select(F.lit("hot").alias("g"), F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("v"))
    got = [(r["v"], r["k"], r["position"]) for r in A.largest(df, ["g"], "v", "k", 7, salt=8).orderBy("position").collect()]
    want = sorted(((i % 50, i) for i in range(500)), key=lambda t: (-t[0], t[1]))[:7]
    assert got == [(float(v), k, i + 1) for i, (v, k) in enumerate(want)]


def test_two_lag_conventions(spark, rows):
    df = spark.createDataFrame([("u", 1, 10.0), ("u", 2, 20.0), ("u", 4, 30.0), ("w", 1, 0.0), ("w", 2, 5.0)], "u string, t int, v double")
    out = df.select("u", "t", P.change(["u"], "t", "v", "pct").alias("s"), P.change(["u"], "t", "v", "pct", strict=False).alias("l"))
    assert rows(out) == [("u", 1, None, None), ("u", 2, 100.0, 100.0), ("u", 4, None, 50.0), ("w", 1, None, None), ("w", 2, None, None)]
    lags = P.calendar_lags(df, ["u"], "t", "v", [2])
    assert rows(lags, "u", "t", "lag2") == [("u", 1, None), ("u", 2, None), ("u", 4, 20.0), ("w", 1, None), ("w", 2, None)]


def test_spine_and_common_support(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("b", 3, 5.0), ("b", 4, None)], "u string, t int, v double")
    units = spark.createDataFrame([("a",)], "u string")
    assert rows(P.spine(df, units, ["u"], "t", F.lit(1), F.lit(3)), "t", "v") == [(1, 1.0), (2, None), (3, 2.0)]
    assert P.spine(df, units, ["u"], "t", F.lit(3), F.lit(1)).count() == 0
    assert rows(P.common_support(df, "u", "t", "v", "a", "b"), "t", "state", "difference") == [(1, "only_a", None), (3, "both", -3.0), (4, "none", None)]


def test_complete_periods_and_closing(spark, rows):
    df = spark.createDataFrame([("u", m, 1.0) for m in range(1, 13)] + [("w", m, 1.0) for m in range(1, 12)] + [("w", 12, None)], "u string, m int, v double")
    assert rows(A.complete_periods(df, ["u"], "v", 12)) == [("u", 12.0, 12)]
    assert rows(A.closing_value(df, ["u"], "m", "v"), "u", "month_used") == [("u", 12), ("w", 11)]


def brute_spearman(pairs):
    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    import numpy as np

    return float(np.corrcoef(ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs]))[0, 1])


@pytest.mark.parametrize("pieces", [None, 3])
def test_omitting_groups_refits_ranks(spark, pieces):
    import random

    rng = random.Random(4)
    data = [("p", rng.choice("abc"), float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(40)] + [("q", "z", 1.0, 2.0)]
    df = spark.createDataFrame(data, "v string, g string, x double, y double")
    fits = C.spearman(C.omission_samples(df, ["v"], "g", "o"), ["v", "o"], "x", "y", 2, pieces=pieces)
    got = {(r["v"], r["o"]): r["spearman"] for r in C.omission_frame(df, ["v"], "g", "o").join(fits, ["v", "o"], "left").collect()}
    for o in "abc":
        assert got[("p", o)] == pytest.approx(brute_spearman([(x, y) for v, g, x, y in data if v == "p" and g != o]))
    assert ("q", "z") in got and got[("q", "z")] is None


def test_partial_rank_without_control_variation(spark):
    df = spark.createDataFrame([("g", float(i), float(i * i % 7), 1.0) for i in range(6)], "g string, x double, y double, z double")
    r = C.partial_rank(df, [], "g", "x", "y", "z").first()
    assert r["partial"] is None and r["state"] == "no variation of the control"


def test_fisher_interval_bounds(spark):
    df = spark.createDataFrame([(0.5, 30), (1.0, 30), (0.5, 3)], "r double, n int")
    got = [tuple(x) for x in df.select(*C.fisher_interval(F.col("r"), F.col("n")), C.t_of_correlation(F.col("r"), F.col("n"))).collect()]
    assert got[0][0] == pytest.approx(0.1704, abs=1e-3) and got[1][:2] == (None, None) and got[2][0] is None


def test_survey_gates_at_their_bounds(spark):
    cols = "target_persons long, valid_persons long, target_households long, valid_households long, target_weight double, valid_weight double, _bw double"
    cases = [(50, 50, 30, 30, 100.0, 95.0, 19.0), (49, 49, 30, 30, 100.0, 100.0, 5.0), (60, 60, 29, 29, 100.0, 100.0, 5.0), (60, 60, 40, 40, 100.0, 94.0, 5.0), (0, 0, 0, 0, 0.0, 0.0, 0.0), (5, 0, 5, 0, 10.0, 0.0, 0.0)]
    got = [(r["status"], r["rate_pct"], r["reasons"]) for r in V.disclosure_gate(spark.createDataFrame(cases, cols).coalesce(1)).collect()]
    assert got[0] == ("available", 20.0, "")
    assert [g[0] for g in got[1:]] == ["suppressed"] * 3 + ["empty", "no_valid_cost"] and all(g[1] is None for g in got[1:])
    assert got[1][2] == "less_than_50_valid_persons" and got[3][2] == "over_5pct_weighted_cost_loss"


def test_cell_cube_conserves_persons(spark):
    people = [(h, "a" if i % 3 else "b", "x" if h % 2 else "y", 1.5, i % 4 != 0, i % 5 == 0) for h in range(12) for i in range(1 + h % 4)]
    df = spark.createDataFrame(people, "hid int, d1 string, d2 string, w double, ok boolean, hit boolean")
    got = {(r["d1"], r["d2"]): r for r in V.cell_cube(df, {"d1": ["a", "b", "c"], "d2": ["x", "y"]}, "hid", "w", "ok", "hit").collect()}
    assert len(got) == 12 and got[("TOTAL", "TOTAL")]["target_persons"] == len(people)
    for (d1, d2), r in got.items():
        inside = [p for p in people if d1 in ("TOTAL", p[1]) and d2 in ("TOTAL", p[2])]
        assert r["target_persons"] == len(inside) and r["target_households"] == len({p[0] for p in inside})
        assert r["valid_households"] == len({p[0] for p in inside if p[4]}) and r["valid_weight"] == pytest.approx(1.5 * sum(p[4] for p in inside))


def test_burden_rule_order(spark):
    df = spark.createDataFrame([(10.0, 100.0, 200.0), (10.0, 50.0, 60.0), (10.0, 500.0, 0.0), (20.0, 500.0, 0.0), (None, 500.0, 0.0)], "c double, i double, a double")
    assert [r[0] for r in df.select(V.overburdened(F.col("c"), F.col("i"), F.col("a"))).collect()] == [False, True, False, True, None]


def test_shift_share(spark):
    rows_ = [("u", "o", 0, 10.0), ("u", "p", 0, 30.0), ("w", "o", 0, 10.0), ("w", "o", 1, 15.0), ("u", "p", 1, 60.0), ("x", "p", 0, 10.0), ("x", "p", 1, 5.0)]
    st = spark.createDataFrame(rows_, "u string, o string, t int, v double")
    got = {r["u"]: r["shock"] for r in SS.predicted_shock(st, "u", "o", "t", "v", 0, 1).collect()}
    assert got["u"] == pytest.approx(0.25 * 0.5 + 0.75 * -0.5) and got["w"] == pytest.approx(-1.0) and got["x"] == pytest.approx(1.0)


def test_quality_rules(spark, rows):
    a = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "k int, v double")
    assert rows(QL.table_difference(a, b), "k", "side") == [(1, "stored"), (3, "fresh")]
    assert rows(QL.duplicate_keys(a, ["k"])) == [(1, 2, True)]
    s = spark.createDataFrame([("g", 60.0), ("g", 40.05), ("h", 50.0), ("h", None), ("i", 99.0)], "g string, s double")
    assert rows(QL.share_identity(s, ["g"], "s"), "g", "verdict") == [("g", "ok"), ("h", "checks_skipped"), ("i", "fail")]


def test_text_numbers(spark):
    text = "About 1,147 homes (37,8 %) on 2021-05-06; rose 12k to -3.5 in 2019, see `99` and https://x.y/77 F 5. Range 2001-2025 and SHA256 15–18."
    df = spark.createDataFrame([(1, text)], "d int, t string")
    got = sorted((r["value"], r["slack"]) for r in QL.text_numbers(df, ["d"], "t").collect())
    assert (1147.0, 0.5) in got and (12000.0, 500.0) in got and (-3.5, 0.05) in [(v, round(s, 6)) for v, s in got]
    values = [v for v, _ in got]
    assert 37.8 in values and 15.0 in values and 18.0 in values
    assert not {99.0, 77.0, 5.0, 2019.0, 256.0, 2001.0, 6.0} & set(values)


def test_gap_bounds_and_national_null(spark, rows):
    created = spark.createDataFrame([("a", 10), ("b", 20)], "u string, created int")
    cells = spark.createDataFrame([("a", 4, 4, 7), ("b", 4, 3, 5)], "u string, cells_expected int, cells_observed int, observed_sum int")
    assert rows(M.bounded_gap(cells, created, "u", "ALL"), "u", "gap_upper", "gap") == [("ALL", 18, None), ("a", 3, 3), ("b", 15, None)]


def test_repeated_median_of_area_without_dates(spark):
    df = spark.createDataFrame([("a", 1950, 2), ("a", 1990, 2), ("a", None, 5), ("b", None, 3)], "area string, y int, w int")
    got = {r["area"]: r for r in M.era_profile(df, "area", "y", "w", [(0, 1960, "old"), (1961, 2100, "new")]).collect()}
    assert set(got) == {"a"} and got["a"]["median_year"] == 1970.0 and got["a"]["pct_old"] == 50.0 and got["a"]["dated"] == 4
    assert Q.quantiles(df, ["area"], "y", {"m": Q.rule("averaging")}, weight="w").count() == 1


def test_text_numbers_take_whole_words(spark):
    text = "1,147,000 homes; 12.5y and 6.2y, 18y; SHA-256, L12 `5,5` [77](http://a.b/99)\n3. about −4,5 % (1.2M), 2021-05 and 20–34 or 10-25k. ```\n88\n``` 1990s 4711 1.2.3"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string")
    got = sorted((r.value, r.slack) for r in QL.text_numbers(df, ["d"], "t").collect())
    assert got == sorted([(1147000.0, 0.5), (12.5, 0.05), (6.2, 0.05), (-4.5, 0.05), (1200000.0, 50000.0), (20.0, 0.5), (34.0, 0.5), (10.0, 0.5), (25000.0, 500.0), (4711.0, 0.5)])
    claims = spark.createDataFrame([(1147000.0, 0.0), (30.0, 5.0), (1.21e6, 0.0), (9.0, 0.0)], "claim double, tol double")
    rest = QL.unexplained(QL.text_numbers(df, ["d"], "t"), claims, [4711.0])
    assert sorted(r.value for r in rest.collect()) == [-4.5, 6.2, 10.0, 12.5, 20.0, 25000.0]


def test_prose_tokens_are_words_with_a_digit(spark):
    text = "a word −5→x7~n ²3–4 (b12), no " + "long" * 50_000 + " https://x.y/1 `8` … 9…\x0b6"
    df = spark.createDataFrame([(text,), (None,), ("no digit",)], "t string")
    assert [r[0] for r in df.select(QL.prose_tokens(F.col("t"))).collect()] == [["-5", "x7", "3", "4", "b12", "9", "6"], None, []]


def test_claims_scan_each_source_once(spark, tmp_path):
    for name in ("a", "b", "c"):
        spark.range(50).select("id", (F.col("id") % 5).alias("g"), (F.col("id") * 1.5).alias("v")).write.parquet(str(tmp_path / name))
    sources = {name: spark.read.parquet(str(tmp_path / name)) for name in ("a", "b", "c")}
    claims = [QL.Claim(f"{s} '{i}'\\", s, ["count(*)", "sum(v)", "max(v)", "count(DISTINCT g)"][i % 4], 10, 0.5, f"g = {i % 6} AND id >= {i // 40 * 10}") for s in sources for i in range(170)]
    out = QL.check_claims(sources, claims)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
    got = {r.label: r for r in out.collect()}
    assert len(got) == 510
    for c in claims:
        i = int(c.label.split("'")[1])
        ids = [x for x in range(50) if x % 5 == i % 6 and x >= i // 40 * 10]
        found = [len(ids), sum(ids) * 1.5 if ids else None, max(ids) * 1.5 if ids else None, len({x % 5 for x in ids})][i % 4]
        r = got[c.label]
        assert r.found == found and r.verdict == ("ok" if found is not None and abs(found - 10) <= 0.5 else "fail")


def test_equal_tables_shuffle_only_sums(spark, rows):
    a = spark.createDataFrame([(1, None, 0.0), (2, "x", 1.0), (2, "x", 1.0), (None, "y", 2.0)], "k int, s string, v double")
    assert QL.table_difference(a, a.repartition(3)).count() == 0
    # a value that moved to the next column, another multiplicity, a null for an empty text
    b = spark.createDataFrame([(None, "1", 0.0), (2, "x", 1.0), (None, "y", 2.0), (3, "", 1.0)], "k int, s string, v double")
    assert rows(QL.table_difference(a, b), "k", "s", "side") == sorted([(1, None, "stored"), (2, "x", "stored"), (None, "1", "fresh"), (3, "", "fresh")], key=lambda t: tuple((v is None, str(v)) for v in t))
    assert rows(QL.table_difference(a, b, buckets=1), "k", "side") == rows(QL.table_difference(a, b), "k", "side")
    big = spark.range(20_000)
    plan = QL.table_difference(big, big)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan
    assert [r.id for r in QL.table_difference(big, big.filter("id <> 777")).collect()] == [777]


def test_omission_ranks_equal_fanned_out_rows(spark, rows, monkeypatch):
    import random

    from parcelbook.operators import correlation as C

    rng = random.Random(4)
    data = [(rng.choice("pq"), rng.choice(["a", "b", "c", None]), rng.choice("uvw"), rng.choice([1.0, 2.0, 5.5, None]), float(rng.randint(0, 9)), rng.gauss(0, 1)) for _ in range(160)]
    data += [("r", "only", "u", 1.0, 2.0, 3.0), ("s", "a", "u", 1.0, 1.0, 1.0), ("s", "b", "u", 2.0, 1.0, 0.0), ("s", "b", "v", 3.0, 4.0, 2.0)]
    df = spark.createDataFrame(data, "r string, g string, h string, x double, y double, z double").repartition(3)
    near = lambda t: [(None if v is None else round(v, 9) if isinstance(v, float) else v) for v in t]

    def both():
        one = rows(C.omission_spearman(df.filter("g is not null"), ["r"], "g", "out", "x", "y", pieces=2), "r", "out", "n", "spearman")
        two = rows(C.omission_partial(df, [], "g", "out", "h", "x", "y", "z", pieces=2), "out", "n", "partial")
        return [near(t) for t in one], [near(t) for t in two]

    counted = both()
    monkeypatch.setattr(C, "LABELS", 0)
    monkeypatch.setattr(C.label_places, "__defaults__", (0,))
    assert counted == both() and ["r", "only", 0, None] in counted[0] and len(counted[1]) == 4


def test_no_row_fans_out_for_omitted_labels(spark):
    from parcelbook.operators import correlation as C

    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 3.0, 3.0)], "g string, x double, y double")
    ranked = C.ranks_without(df.withColumn("_k", F.lit(0)), [], "x", "r", 3)
    assert "Generate" not in ranked._jdf.queryExecution().executedPlan().toString() and ranked.count() == 3
