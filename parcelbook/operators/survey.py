"""Survey cells: validated linkage, equivalised income, weighted cuts and disclosure gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelbook.operators.order_stats import group_by_cuts, weighted_cuts
from parcelbook.session import settle

# fixed values: release gates of a cell and the wording of their reasons
MIN_PERSONS = 50
MIN_HOUSEHOLDS = 30
MAX_MISSING = 0.05
FEW_PERSONS = "less_than_50_valid_persons"
FEW_HOUSEHOLDS = "less_than_30_valid_households"
MUCH_LOSS = "over_5pct_weighted_cost_loss"
MARGIN_NOTE = "overlapping_marginal_rate_not_published"


def linkage_problems(
    register: DataFrame, households: DataFrame, persons: DataFrame, hid: str, members: str, weight: str
) -> DataFrame:
    """Violations of the linkage rules with how many households or persons break each."""
    d = register.groupBy(hid).agg(F.count("*").alias("_d"))
    h = households.groupBy(hid).agg(F.count("*").alias("_h"), F.max(members).alias("_members"))
    p = persons.groupBy(hid).agg(F.count("*").alias("_p"))
    # one co-partitioned pass over the three household-level aggregates
    j = d.join(h, hid, "full").join(p, hid, "full")
    counts = j.agg(
        F.count_if((F.col("_d") > 1) | (F.col("_h") > 1)).alias("duplicate_key"),
        F.count_if(F.col("_d").isNull() != F.col("_h").isNull()).alias("universe_mismatch"),
        F.count_if(F.coalesce("_p", F.lit(0)) != F.coalesce("_members", F.lit(0))).alias(
            "member_count_mismatch"
        ),
    )
    bad = persons.agg(
        F.count_if(~F.coalesce(F.col(weight) > 0, F.lit(False))).alias("weight_not_positive")
    )
    names = ["duplicate_key", "universe_mismatch", "member_count_mismatch"]
    return counts.unpivot([], names, "rule", "violations").unionByName(
        bad.unpivot([], ["weight_not_positive"], "rule", "violations")
    )


def equivalised(income: Column, adults: Column, children: Column) -> Column:
    """Income over the modified scale: 1, 0.5 per further adult, 0.3 per child."""
    return income / (1 + 0.5 * (adults - 1) + 0.3 * children)


def household_scale(persons: DataFrame, hid: str, age: str, adult_from: int = 14) -> DataFrame:
    return persons.groupBy(hid).agg(
        F.count_if(F.col(age) >= adult_from).alias("adults"),
        F.count_if(F.col(age) < adult_from).alias("children"),
    )


def overburdened(monthly_cost: Column, income: Column, allowance: Column) -> Column:
    """Ordered rules: no net cost -> no; no net income -> yes; else cost > 40 % of income."""
    net_cost = 12 * monthly_cost - allowance
    net_income = income - allowance
    return (
        F.when(net_cost <= 0, False).when(net_income <= 0, True).otherwise(net_cost > 0.4 * net_income)
    )


def poverty_line(persons: DataFrame, income: str, weight: str, share: float = 0.6) -> Column:
    """60 % of the weighted median over all persons, as a scalar."""
    cuts = weighted_cuts(persons, [], income, weight, {"_median": 0.5})
    return cuts.select(F.col("_median") * share).scalar()


def quintile(persons: DataFrame, income: str, weight: str) -> Column:
    """Quintile 1..5 by four weighted cuts; a tie with a cut goes to the lower group."""
    names = {f"_c{i}": i / 5 for i in range(1, 5)}
    cuts = weighted_cuts(persons, [], income, weight, names)
    return group_by_cuts(F.col(income), list(cuts.select(*names).first()))


def group_rates(df: DataFrame, memberships: Column, flag: str, weight: str) -> DataFrame:
    """Weighted rate per (breakdown, group); a person may belong to several groups."""
    long = df.select(F.explode(memberships).alias("_g"), flag, weight)
    return long.groupBy(F.col("_g.breakdown").alias("breakdown"), F.col("_g.code").alias("code")).agg(
        (100.0 * F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("rate_pct"),
        F.sum(weight).alias("person_weight"),
        F.count("*").alias("sample_persons"),
    )


def cell_cube(
    persons: DataFrame,
    dims: dict[str, list[str]],
    hid: str,
    weight: str,
    valid: str,
    flag: str,
) -> DataFrame:
    """Every person counted under TOTAL and own value of each dimension, on the full grid.

    ``dims`` lists the categories, so empty cells keep a row. Only leaf cells and
    household *patterns* are fanned out to the margins: sums roll up from the leaves,
    and households with the same set of leaves are counted together, so distinct
    households stay exact without copying each household once per margin.
    """
    names = list(dims)
    size = {n: len(dims[n]) + 2 for n in names}  # TOTAL, the categories, any other label
    base, span = {}, 1
    for n in reversed(names):
        base[n] = span
        span *= size[n]

    def place(n: str) -> Column:
        at = F.array_position(F.array(*[F.lit(c) for c in dims[n]]), F.col(n)).cast("int")
        return F.when(F.coalesce(at, F.lit(0)) == 0, size[n] - 1).otherwise(at)

    def margins(code: Column) -> Column:
        out = [code]
        for n in names:
            own = F.pmod(F.floor(code / base[n]), F.lit(size[n])).cast("int") * base[n]
            out = [*out, *[c - own for c in out]]
        return F.array(*out)

    own_code = sum((place(n) * base[n] for n in names), F.lit(0))
    leaf = persons.groupBy(hid, own_code.alias("_code")).agg(
        F.count("*").alias("_t"),
        F.count_if(F.col(valid)).alias("_v"),
        F.sum(weight).alias("_tw"),
        F.sum(F.when(F.col(valid), F.col(weight)).otherwise(0.0)).alias("_vw"),
        F.sum(F.when(F.col(valid) & F.col(flag), F.col(weight)).otherwise(0.0)).alias("_bw"),
    )
    sums = ["_t", "_v", "_tw", "_vw", "_bw"]
    # a household has at most one entry per leaf cell, so its entries stay few
    homes = leaf.groupBy(hid).agg(F.sort_array(F.collect_list(F.struct("_code", *sums))).alias("_cells"))
    shape = F.transform("_cells", lambda c: F.struct(c["_code"].alias("code"), (c["_v"] > 0).alias("ok")))
    entries = homes.select(shape.alias("_pattern"), F.explode("_cells").alias("_c")).select("_pattern", "_c.*")
    # every household of a pattern has each of its codes once: rows per code = households
    patterns = settle(
        entries.groupBy("_pattern", "_code").agg(
            F.count("*").alias("_homes"), F.max(F.col("_v") > 0).alias("_ok"), *[F.sum(c).alias(c) for c in sums]
        )
    )
    fan = patterns.withColumn("_cell", F.explode(margins(F.col("_code"))))
    totals = fan.groupBy("_cell").agg(
        F.sum("_t").alias("target_persons"),
        F.sum("_v").alias("valid_persons"),
        F.sum("_tw").alias("target_weight"),
        F.sum("_vw").alias("valid_weight"),
        F.sum("_bw").alias("_bw"),
    )
    homes_in = (
        fan.groupBy("_pattern", "_cell")
        .agg(F.max("_homes").alias("_homes"), F.bool_or("_ok").alias("_ok"))
        .groupBy("_cell")
        .agg(
            F.sum("_homes").alias("target_households"),
            F.sum(F.when(F.col("_ok"), F.col("_homes")).otherwise(0)).alias("valid_households"),
        )
    )
    grid = persons.sparkSession.range(1).select(F.lit(0).alias("_cell"))
    for n in names:
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(["TOTAL", *dims[n]])])
        grid = grid.withColumn("_s", F.explode(steps)).select(
            *[c for c in grid.columns if c != "_cell"], F.col("_s.c").alias(n), (F.col("_cell") + F.col("_s.i") * base[n]).alias("_cell")
        )
    filled = ["target_persons", "valid_persons", "target_households", "valid_households", "target_weight", "valid_weight", "_bw"]
    return grid.join(totals, "_cell", "left").join(homes_in, "_cell", "left").select(*names, *filled).na.fill(0, filled)


def disclosure_gate(cells: DataFrame) -> DataFrame:
    """Rate only where the cell passes every gate; otherwise the reasons."""
    missing = F.least(
        F.lit(1.0),
        F.greatest(
            F.lit(0.0),
            (F.col("target_weight") - F.col("valid_weight")) / F.nullif(F.col("target_weight"), F.lit(0.0)),
        ),
    )
    missing = F.when(F.col("target_weight") > 0, missing)
    reasons = F.concat_ws(
        ";",
        F.when(F.col("valid_persons") < MIN_PERSONS, FEW_PERSONS),
        F.when(F.col("valid_households") < MIN_HOUSEHOLDS, FEW_HOUSEHOLDS),
        F.when(F.col("_missing") > MAX_MISSING + 1e-12, MUCH_LOSS),
    )
    counted = (F.col("target_persons") > 0) & (F.col("valid_persons") > 0)
    return (
        cells.withColumn("_missing", missing)
        .withColumn("reasons", F.when(counted, reasons).otherwise(""))
        .withColumn(
            "status",
            F.when(F.col("target_persons") == 0, "empty")
            .when(F.col("valid_persons") == 0, "no_valid_cost")
            .when(F.col("reasons") != "", "suppressed")
            .otherwise("available"),
        )
        .withColumn("missing_pct", 100 * F.col("_missing"))
        .withColumn(
            "rate_pct",
            F.when(F.col("status") == "available", 100 * F.col("_bw") / F.nullif(F.col("valid_weight"), F.lit(0.0))),
        )
        .drop("_missing", "_bw")
    )


def withhold_margins(cells: DataFrame, dims: list[str]) -> DataFrame:
    """Cells with a TOTAL coordinate publish no rate, so hidden cells cannot be derived."""
    margin = F.lit(False)
    for d in dims:
        margin = margin | (F.col(d) == "TOTAL")
    hit = margin & F.col("status").isin("available", "suppressed")
    return (
        cells.withColumn("rate_pct", F.when(~hit, F.col("rate_pct")))
        .withColumn(
            "reasons",
            F.when(hit, F.concat_ws(";", F.when(F.col("reasons") != "", F.col("reasons")), F.lit(MARGIN_NOTE))).otherwise(
                F.col("reasons")
            ),
        )
        .withColumn("status", F.when(hit, "marginal_not_published").otherwise(F.col("status")))
    )


def flag_frequencies(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count of every flag value by field."""
    return df.unpivot([], flags, "field", "flag").groupBy("field", "flag").agg(F.count("*").alias("n"))


def benchmark_matches(computed: DataFrame, published: DataFrame, keys: list[str], tol: float = 0.05) -> DataFrame:
    """Published rate, computed rate and whether they agree within rounding."""
    c = computed.select(*keys, F.col("rate_pct").alias("computed_pct"))
    return published.select(*keys, F.col("rate_pct").alias("published_pct")).join(c, keys, "left").withColumn(
        "matches",
        F.coalesce(F.abs(F.col("computed_pct") - F.col("published_pct")) <= tol + 1e-9, F.lit(False)),
    )
