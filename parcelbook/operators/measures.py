"""Derived measures: marts, ratios, prices, stocks, gaps and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelbook.functions.buckets import band
from parcelbook.functions.numbers import annuity, ratio
from parcelbook.operators import order_stats as Q
from parcelbook.operators import periods as P
from parcelbook.operators.aggregates import all_or_nothing
from parcelbook.session import settle


def dimension_with_check(df: DataFrame, code: str, name: str) -> DataFrame:
    """One row per code; a code spelled in two ways is flagged."""
    return df.groupBy(code).agg(F.min(name).alias(name), (F.min(name) != F.max(name)).alias("name_conflict"))


def pivot_with_check(df: DataFrame, keys: list[str], kind: str, parts: list[str], total: str, value: str, tol: float = 0.0) -> DataFrame:
    """Kinds to columns plus the additive gap of parts against the total row."""
    wide = df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in [*parts, total]]
    )
    gap = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) - F.col(total)
    return wide.withColumn("gap", gap).withColumn("adds_up", F.abs("gap") <= tol)


def ratio_set(df: DataFrame, specs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Columns ``name -> scale * num / den``; null on a missing or zero denominator."""
    return df.withColumns({name: ratio(F.col(a), F.col(b), scale=s) for name, (a, b, s) in specs.items()})


def income_years(df: DataFrame, unit: str, year: str, price_m2: str, income: str, m2: float = 90.0) -> DataFrame:
    """Price of a dwelling in years of the income earned one year earlier."""
    w = P.previous([unit], year, income)
    return df.withColumn("years_of_income", ratio(F.col(price_m2) * m2, w))


def series_by_source(year: Column, rules: list[tuple[Column, Column, str]]) -> tuple[Column, Column]:
    """First rule whose year condition holds decides value and source; no rule, no value."""
    value, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    for cond, v, name in reversed(rules):
        value = F.when(cond, v).otherwise(value)
        source = F.when(cond & v.isNotNull(), F.lit(name)).when(cond, F.lit(None).cast("string")).otherwise(source)
    return value, source


def region_mart(df: DataFrame, region: str, year: str, counts: list[str], own_index: DataFrame, index: str, national: str) -> DataFrame:
    """Counts summed over members, the index taken from its own rows, national row added."""
    by = df.groupBy(region, year).agg(*[all_or_nothing(F.col(c)).alias(c) for c in counts])
    nat = df.groupBy(year).agg(*[all_or_nothing(F.col(c)).alias(c) for c in counts]).withColumn(region, F.lit(national))
    return by.unionByName(nat).join(own_index.select(region, year, index), [region, year], "left")


def mixed_grain_anchors(detail: DataFrame, published: DataFrame, unit: str, region: str, value: str, tol: float = 1.0) -> DataFrame:
    """Published rows at unit, single-unit-region and region grain mapped to units.

    A region that holds several units is only checked against the sum of its units
    and gives no anchor, so nothing is counted twice.
    """
    size = detail.groupBy(region).agg(
        F.count_distinct(unit).alias("units"), F.min(unit).alias("only_unit"), F.sum(value).alias("unit_sum")
    )
    own = published.join(detail.select(F.col(unit).alias("label")).distinct(), "label", "left_semi").select(
        F.col("label").alias(unit), F.col(value), F.lit("unit").alias("grain"), F.lit(True).alias("counted"), F.lit(None).cast("boolean").alias("agrees")
    )
    at_region = published.join(size, published["label"] == size[region])
    single = at_region.filter("units = 1").select(
        F.col("only_unit").alias(unit), F.col(value), F.lit("single").alias("grain"), F.lit(True).alias("counted"), F.lit(None).cast("boolean").alias("agrees")
    )
    several = at_region.filter("units > 1").select(
        F.col("label").alias(unit), F.col(value), F.lit("region").alias("grain"), F.lit(False).alias("counted"), (F.abs(F.col(value) - F.col("unit_sum")) <= tol).alias("agrees")
    )
    return own.unionByName(single).unionByName(several)


def occupancy(df: DataFrame, persons: str, homes: str, main: str, rented: str, hidden: str) -> DataFrame:
    """Section ratios, null where the section is suppressed."""
    shown = ~F.col(hidden)
    return df.withColumns(
        {
            "persons_per_home": F.when(shown, ratio(F.col(persons), F.col(homes))),
            "households_per_home": F.when(shown, ratio(F.col(main), F.col(homes))),
            "rented_share": F.when(shown, ratio(F.col(rented), F.col(main))),
        }
    )


def rent_burden(rent: Column, income: Column) -> Column:
    """Twelve monthly rents over yearly income, in percent."""
    return ratio(12 * rent, income, scale=100.0)


def gross_yield(rent: Column, price: Column) -> Column:
    return ratio(12 * rent, price, scale=100.0)


def absorption(unit: str, year: str, homes: str, people: str) -> Column:
    """New homes per new inhabitant; undefined unless population grows."""
    dh, dp = P.change([unit], year, homes, "diff", strict=False), P.change([unit], year, people, "diff", strict=False)
    return F.when(dp > 0, dh / dp)


def household_gap(df: DataFrame, unit: list[str], year: str, stock: str, built: str, first: int, last: int) -> DataFrame:
    """Creation over the window (stock of last+1 minus first) less completions; null propagates."""
    inside = F.col(year).between(first, last)
    agg = df.filter(F.col(year).between(first, last + 1)).groupBy(*unit).agg(
        F.max(F.when(F.col(year) == first, F.col(stock))).alias("_a"),
        F.max(F.when(F.col(year) == last + 1, F.col(stock))).alias("_b"),
        F.sum(F.when(inside, F.col(built))).alias("built"),
        F.count(F.when(inside, F.col(built))).alias("_n"),
    )
    return agg.select(
        *unit,
        (F.col("_b") - F.col("_a")).alias("created"),
        F.when(F.col("_n") == last - first + 1, F.col("built")).alias("built"),
        F.when(F.col("_n") == last - first + 1, F.col("_b") - F.col("_a") - F.col("built")).alias("gap"),
    )


def bounded_gap(cells: DataFrame, created: DataFrame, unit: str, national: str) -> DataFrame:
    """Gap with coverage: exact only when every cell was observed, else an upper figure.

    ``cells`` carries expected / observed counts and the observed sum. The national
    row is null in every column where some unit is null.
    """
    j = created.join(cells, unit, "left")
    upper = F.col("created") - F.col("observed_sum")
    rows = j.select(
        unit,
        "created",
        "cells_expected",
        "cells_observed",
        "observed_sum",
        upper.alias("gap_upper"),
        F.when(F.col("cells_expected") == F.col("cells_observed"), upper).alias("gap"),
    )
    rows = settle(rows)
    names = [c for c in rows.columns if c != unit]
    total = rows.agg(*[all_or_nothing(F.col(c)).alias(c) for c in names]).select(F.lit(national).alias(unit), *names)
    return rows.unionByName(total)


def payment_scenarios(cases: DataFrame, principal: Column, rate_pct: Column, months: Column, income: Column, debts: Column) -> DataFrame:
    """Constant payments at the chosen rate and one and two points above."""
    steps = F.array(*[F.struct(F.lit(i).alias("added_pp"), F.lit(n).alias("scenario")) for i, n in enumerate(["chosen", "plus_1", "plus_2"])])
    fan = cases.withColumns({"_p": principal, "_m": months, "_i": income, "_d": debts, "_s": F.explode(steps)})
    fan = fan.withColumn("_r", (rate_pct + F.col("_s.added_pp")) / 1200.0)
    pay = fan.withColumn("payment", annuity(F.col("_p"), F.col("_r"), F.col("_m")))
    return pay.select(
        *cases.columns,
        F.col("_s.scenario").alias("scenario"),
        F.col("_s.added_pp").alias("added_pp"),
        "payment",
        ratio(F.col("payment"), F.col("_i"), scale=100.0).alias("payment_pct"),
        ratio(F.col("payment") + F.col("_d"), F.col("_i"), scale=100.0).alias("debt_pct"),
        (F.col("_i") - F.col("payment") - F.col("_d")).alias("after_debt"),
        (F.col("payment") * F.col("_m")).alias("total_paid"),
        F.greatest(F.col("payment") * F.col("_m") - F.col("_p"), F.lit(0.0)).alias("total_interest"),
    )


def era_profile(df: DataFrame, area: str, year: str, weight: str, eras: list[tuple[int, int, str]]) -> DataFrame:
    """Weighted era shares over dated weight, missing share and repeated-value median."""
    use = df.filter(F.col(weight) > 0)
    era = band(F.col(year), eras)
    w = F.col(weight)
    shares = use.groupBy(area).agg(
        F.sum(w).alias("total"),
        F.coalesce(F.sum(F.when(F.col(year).isNotNull(), w)), F.lit(0)).alias("dated"),
        *[F.coalesce(F.sum(F.when(era == label, w)), F.lit(0)).alias(f"_{label}") for _, _, label in eras],
    )
    med = Q.quantiles(use, [area], year, {"median_year": Q.rule("averaging")}, weight=weight).drop("total")
    return shares.join(med, area).select(
        area,
        "total",
        "dated",
        ratio(F.col("total") - F.col("dated"), F.col("total"), scale=100.0).alias("missing_pct"),
        "median_year",
        *[ratio(F.col(f"_{label}"), F.col("dated"), scale=100.0).alias(f"pct_{label}") for _, _, label in eras],
    )


def area_summary(areas: DataFrame, records: DataFrame, area: str, km2: str, homes: str, floor: str, year: str) -> DataFrame:
    """Counts, density and coverage per area; an area without records keeps its row."""
    agg = records.groupBy(area).agg(
        F.count("*").alias("records"),
        F.sum(homes).alias("homes"),
        F.sum(floor).alias("floor_m2"),
        F.count(floor).alias("with_floor"),
        F.count(year).alias("with_year"),
    )
    j = areas.join(agg, area, "left").na.fill(0, ["records", "with_floor", "with_year"])
    return j.withColumn("homes_per_km2", ratio(F.col("homes"), F.col(km2)))


def aligned_rates(df: DataFrame, by: list[str], empty: str, first: str, second: str) -> DataFrame:
    """Empty rate under two denominators and the spread of their ratio per group."""
    r = df.withColumns(
        {"rate_first": ratio(F.col(empty), F.col(first), scale=100.0), "rate_second": ratio(F.col(empty), F.col(second), scale=100.0)}
    ).withColumn("rate_ratio", ratio(F.col("rate_second"), F.col("rate_first")))
    med = Q.quantiles(r, by, "rate_ratio", {"ratio_median": Q.rule("averaging")}).withColumnRenamed("total", "units")
    span = r.groupBy(*by).agg(F.min("rate_ratio").alias("ratio_min"), F.max("rate_ratio").alias("ratio_max"))
    return Q.null_safe_join(med, span, by)


def endpoint_summary(df: DataFrame, unit: str, year: str, metrics: list[str], a: str, b: str) -> DataFrame:
    """First and last common year per metric of two units with changes and their difference."""
    long = df.filter(F.col(unit).isin(a, b)).select(
        unit, year, *[F.col(m).cast("double").alias(m) for m in metrics]
    ).unpivot([unit, year], metrics, "metric", "v").filter("v is not null")
    ends = long.groupBy("metric", unit).agg(
        F.min_by("v", year).alias("v0"), F.max_by("v", year).alias("v1"), F.min(year).alias("y0"), F.max(year).alias("y1")
    )
    wide = ends.groupBy("metric").agg(
        *[
            F.max(F.when(F.col(unit) == u, F.col(c))).alias(f"{c}_{s}")
            for u, s in ((a, "a"), (b, "b"))
            for c in ("y0", "y1", "v0", "v1")
        ]
    )
    pct_a, pct_b = (ratio(F.col(f"v1_{s}") - F.col(f"v0_{s}"), F.col(f"v0_{s}"), scale=100.0) for s in "ab")
    return wide.withColumns({"pct_a": pct_a, "pct_b": pct_b, "pct_difference": pct_a - pct_b, "last_difference": F.col("v1_a") - F.col("v1_b")})


def unit_profile(units: DataFrame, key: str, indicators: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Indicators stacked with year, unit of measure and the reason of a missing value.

    ``indicators``: name -> (table, year column, value column, unit of measure).
    """
    out = None
    for name, (df, year, value, measure) in indicators.items():
        last = P.latest_row(df, [key], year, [value])
        one = units.select(key).join(last, key, "left").select(
            key,
            F.lit(name).alias("indicator"),
            F.col(year).cast("int").alias("year"),
            F.col(value).cast("double").alias("value"),
            F.lit(measure).alias("measure"),
            F.when(F.col(year).isNull(), "no rows for the unit").when(F.col(value).isNull(), "not published in the latest year").alias("reason"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def vintage_status(df: DataFrame, by: list[str], vintage: str, state: str, weight: str, bands: list[tuple[int, int, str]]) -> DataFrame:
    """Stock by construction band and state, with the band's share of its group."""
    b = band(F.col(vintage), bands, "undated")
    t = df.groupBy(*by, b.alias("band")).pivot(state, ["main", "second", "empty"]).agg(F.sum(weight)).na.fill(0)
    t = t.withColumn("stock", F.col("main") + F.col("second") + F.col("empty"))
    totals = t.groupBy(*by).agg(F.sum("stock").alias("_t"))
    return t.join(totals, by).withColumn("band_pct", ratio(F.col("stock"), F.col("_t"), scale=100.0)).drop("_t")
