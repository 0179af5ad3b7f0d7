"""Rank and partial correlations on counted values, without pairwise blow-up of rows.

Inputs are one row per unit (areas, suppliers); they are settled once because every
ranked column reads them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelbook.operators.aggregates import guarded_corr, vector_sum
from parcelbook.operators.order_stats import in_ranges, null_safe_join, rank_values
from parcelbook.session import settle

RESIDUAL_FLOOR = 1e-12


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """Normal interval on the atanh scale; null for n < 4 or a perfect correlation."""
    ok = (n >= 4) & (F.abs(r) < 1)
    safe = F.when(ok, r)
    half = 1.96 / F.sqrt(F.when(ok, n - 3))
    return F.tanh(F.atanh(safe) - half), F.tanh(F.atanh(safe) + half)


def t_of_correlation(r: Column, n: Column) -> Column:
    """t of a correlation; null when |r| = 1 or there are no degrees of freedom."""
    ok = (F.abs(r) < 1) & (n > 2)
    safe = F.when(ok, r)
    return safe * F.sqrt(F.when(ok, n - 2)) / F.sqrt(1 - safe * safe)


def centred(df: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Value minus its group mean; the means are an aggregate joined back."""
    means = df.groupBy(*by).agg(
        *[F.avg(v).alias(f"_m_{out}") for out, v in values.items()], F.count("*").alias("group_rows")
    )
    out = null_safe_join(df, means, by)
    for name, v in values.items():
        out = out.withColumn(name, F.col(v) - F.col(f"_m_{name}")).drop(f"_m_{name}")
    return out


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3, pieces: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks per group."""
    pairs = settle(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    ranked = rank_values(rank_values(pairs, by, x, "_rx", pieces=pieces), by, y, "_ry", pieces=pieces)
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    return grouped.agg(F.count("*").alias("n"), guarded_corr("_rx", "_ry", least).alias("spearman"))


def group_centred(df: DataFrame, by: list[str], group: str, x: str, y: str, pieces: int | None = None) -> DataFrame:
    """Pearson, Spearman and the correlation of ranks centred inside ``group``.

    Ranks are global inside ``by``; a group with one row adds zeros and is counted.
    """
    pairs = settle(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    ranked = rank_values(rank_values(pairs, by, x, "_rx", pieces=pieces), by, y, "_ry", pieces=pieces)
    c = centred(ranked, [*by, group], {"_dx": "_rx", "_dy": "_ry"})
    grouped = c.groupBy(*by) if by else c.groupBy()
    return grouped.agg(
        F.count("*").alias("n"),
        F.count_distinct(group).alias("groups"),
        F.count_if(F.col("group_rows") == 1).alias("singletons"),
        guarded_corr(x, y).alias("pearson"),
        guarded_corr("_rx", "_ry").alias("spearman"),
        guarded_corr("_dx", "_dy").alias("centred"),
    )


def partial_rank(df: DataFrame, by: list[str], group: str, x: str, y: str, z: str, pieces: int | None = None) -> DataFrame:
    """Correlation of centred ranks after projecting both on the centred rank of ``z``.

    With centred ranks dx, dy, dz the residual sums follow from six moments:
    e_x.e_y = dx.dy - (dx.dz)(dy.dz)/(dz.dz), so one aggregate gives everything.
    """
    full = settle(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()))
    ranked = full
    for v, r in ((x, "_rx"), (y, "_ry"), (z, "_rz")):
        ranked = rank_values(ranked, by, v, r, pieces=pieces)
    c = centred(ranked, [*by, group], {"_dx": "_rx", "_dy": "_ry", "_dz": "_rz"})
    grouped = c.groupBy(*by) if by else c.groupBy()

    def s(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    m = grouped.agg(
        F.count("*").alias("n"),
        F.count_distinct(group).alias("groups"),
        guarded_corr("_rx", "_ry").alias("spearman"),
        guarded_corr("_dx", "_dy").alias("centred"),
        s("_dx", "_dx").alias("_xx"),
        s("_dy", "_dy").alias("_yy"),
        s("_dz", "_dz").alias("_zz"),
        s("_dx", "_dy").alias("_xy"),
        s("_dx", "_dz").alias("_xz"),
        s("_dy", "_dz").alias("_yz"),
    )
    zz = F.nullif(F.col("_zz"), F.lit(0.0))
    exx = F.col("_xx") - F.col("_xz") * F.col("_xz") / zz
    eyy = F.col("_yy") - F.col("_yz") * F.col("_yz") / zz
    exy = F.col("_xy") - F.col("_xz") * F.col("_yz") / zz
    enough = (exx > RESIDUAL_FLOOR * F.col("_xx")) & (eyy > RESIDUAL_FLOOR * F.col("_yy"))
    return (
        m.withColumn("partial", F.when(enough, exy / F.sqrt(F.when(enough, exx * eyy))))
        .withColumn(
            "state",
            F.when(F.col("n") == 0, "no complete rows")
            .when(F.col("_zz") == 0, "no variation of the control")
            .when(~F.coalesce(enough, F.lit(False)), "no residual variation")
            .otherwise("descriptive"),
        )
        .drop("_xx", "_yy", "_zz", "_xy", "_xz", "_yz")
    )


def omission_samples(df: DataFrame, by: list[str], group: str, out: str) -> DataFrame:
    """Each row once for every group label other than its own, with that label.

    The label list (districts, regions) is a small aggregate per ``by``; rows fan out
    by an exploded array, and every later step counts values before it shuffles.
    """
    # distinct labels first, so the array never sees more than one copy of a label
    labels = df.select(*by, group).distinct().groupBy(*by).agg(F.collect_list(group).alias("_labels"))
    joined = null_safe_join(df, labels, by) if by else df.withColumn(
        "_labels", labels.select("_labels").scalar()
    )
    return joined.withColumn(
        out, F.explode(F.array_remove(F.col("_labels"), F.col(group)))
    ).drop("_labels")


def omission_frame(df: DataFrame, by: list[str], group: str, out: str) -> DataFrame:
    """All (by, omitted label) pairs, so an empty remainder keeps its row."""
    return df.select(*by, F.col(group).alias(out)).distinct()


# ------------------------------------------------- ranks without one group at a time

#: Labels a row may have counts for; with more, rows fan out by ``omission_samples``.
LABELS = 512


def label_places(df: DataFrame, by: list[str], group: str, most: int = LABELS) -> tuple[DataFrame, int] | None:
    """(by, group, _k): the place of each label inside its ``by``, and how many places there are; None beyond ``most``."""
    labels = df.select(*by, group).filter(F.col(group).isNotNull()).distinct()
    sizes = labels.groupBy(*by).agg(F.count("*").alias("n")) if by else labels.agg(F.count("*").alias("n"))
    n = sizes.agg(F.max("n")).first()[0] or 0
    if n > most:
        return None
    return settle(labels.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(group)) - 1)), n


def ranks_without(df: DataFrame, by: list[str], value: str, out: str, places: int, pieces: int | None = None) -> DataFrame:
    """Adds ``out``: the average rank of the row's value without each label ``_k`` in turn, less the mean rank.

    The rank without a label is the rank less the label's own rows below the value (and
    half of those at it), so each distinct value carries one count a label and no row is
    repeated. Values are counted and ranged as for a plain rank.
    """
    mine = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda g: F.when(g == F.col("_k"), 1.0).otherwise(0.0))
    counts = df.groupBy(*by, value).agg(vector_sum(mine).alias("_own"))
    ranged = in_ranges(counts, [*by, value], pieces)
    per_range = ranged.groupBy(*by, "_range").agg(vector_sum("_own").alias("_in"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    shift = per_range.select(*by, "_range", F.zip_with(vector_sum("_in", upto), "_in", lambda a, b: a - b).alias("_below"), vector_sum("_in", whole).alias("_total"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = null_safe_join(ranged.withColumn("_cum", vector_sum("_own", inside)), shift, [*by, "_range"])
    before = F.transform(F.arrays_zip("_cum", "_below", "_own"), lambda c: c["_cum"] + c["_below"] - c["_own"])
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    table = run.withColumn("_before", before).withColumns({"_b": add(F.col("_before")), "_e": add(F.col("_own")), "_n": add(F.col("_total"))})
    rank = F.transform(F.arrays_zip("_before", "_own", "_total"), lambda c: (F.col("_b") - c["_before"]) + (F.col("_e") - c["_own"] + 1) / 2 - (F.col("_n") - c["_total"] + 1) / 2)
    return null_safe_join(df, table.select(*by, value, rank.alias(out)), [*by, value])


def omission_moments(df: DataFrame, by: list[str], group: str, values: list[str], within: str | None = None, pieces: int | None = None) -> DataFrame | None:
    """(by, group, n, s_ab..): sums of products of ranks of the rows outside each label, from one set of rows.

    ``s_0_1`` is that of the first and second value and so on. With ``within`` ranks are
    centred inside its groups. None where there are too many labels for counts by row.
    """
    complete = df.select(*by, group, *values, *([within] if within and within not in (*by, group) else []))
    for v in (group, *values):
        complete = complete.filter(F.col(v).isNotNull())
    rows = settle(complete)
    found = label_places(rows, by, group)
    if found is None:
        return None
    labels, places = found
    if not places:
        return None
    ranked = null_safe_join(rows, labels, [*by, group])
    for i, v in enumerate(values):
        ranked = ranks_without(ranked, by, v, f"_r{i}", places, pieces)
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.lit(places - 1)).alias("k"), *[F.col(f"_r{i}").alias(f"r{i}") for i in range(len(values))])
    factors: list[list[int]] = [[], *[[i] for i in range(len(values))], *[[i, j] for i, j in pairs]]

    def outside(term: list[int]) -> Column:
        product = lambda c: reduce(lambda a, i: a * c[f"r{i}"], term, F.lit(1.0))
        return F.transform(zipped, lambda c: F.when(c["k"] != F.col("_k"), product(c)).otherwise(0.0))

    wide = F.concat(*[outside(term) for term in factors])
    keys = [*by, *([F.col(within).alias("_within")] if within else [])]
    sums = ranked.groupBy(*keys).agg(vector_sum(wide).alias("_s"))
    # from here on one row for each label and inner group
    at = lambda t, k: F.get("_s", k + t * places)
    cell = lambda k: F.struct(k.alias("k"), *[at(t, k).alias(f"t{t}") for t in range(len(factors))])
    long = sums.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(places - 1)), cell)).alias("_c")).select(*by, "_c.*").filter("t0 > 0")
    moments = []
    for p, (i, j) in enumerate(pairs):
        product = F.col(f"t{1 + len(values) + p}")
        moments.append(F.sum(product - F.col(f"t{1 + i}") * F.col(f"t{1 + j}") / F.col("t0") if within else product).alias(f"s_{i}_{j}"))
    out = long.groupBy(*by, "k").agg(F.sum("t0").cast("long").alias("n"), *moments)
    named = labels.withColumnRenamed("_k", "k")
    return null_safe_join(named, out, [*by, "k"], "left").drop("k")


def _moment_corr(xy: str, xx: str, yy: str) -> Column:
    ok = (F.col(xx) > 0) & (F.col(yy) > 0)
    return F.when(ok, F.col(xy) / F.sqrt(F.when(ok, F.col(xx) * F.col(yy))))


def omission_spearman(df: DataFrame, by: list[str], group: str, out: str, x: str, y: str, least: int = 2, pieces: int | None = None) -> DataFrame:
    """(by, out, n, spearman) of the rows outside each label; an empty remainder keeps its row."""
    frame = omission_frame(df, by, group, out)
    m = omission_moments(df, by, group, [x, y], pieces=pieces)
    if m is None:
        fits = spearman(omission_samples(df, by, group, out), [*by, out], x, y, least, pieces)
    else:
        r = F.when(F.col("n") >= least, _moment_corr("s_0_1", "s_0_0", "s_1_1"))
        fits = m.select(*by, F.col(group).alias(out), "n", r.alias("spearman"))
    return null_safe_join(frame, fits, [*by, out], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def omission_partial(df: DataFrame, by: list[str], group: str, out: str, within: str, x: str, y: str, z: str, pieces: int | None = None) -> DataFrame:
    """(by, out, n, partial): the partial rank correlation of the rows outside each label, ranks centred inside ``within``."""
    m = omission_moments(df, by, group, [x, y, z], within, pieces)
    if m is None:
        fan = omission_samples(df, by, group, out)
        return partial_rank(fan, [*by, out], within, x, y, z, pieces).select(*by, out, "n", "partial")
    zz = F.nullif(F.col("s_2_2"), F.lit(0.0))
    exx = F.col("s_0_0") - F.col("s_0_2") * F.col("s_0_2") / zz
    eyy = F.col("s_1_1") - F.col("s_1_2") * F.col("s_1_2") / zz
    exy = F.col("s_0_1") - F.col("s_0_2") * F.col("s_1_2") / zz
    enough = (exx > RESIDUAL_FLOOR * F.col("s_0_0")) & (eyy > RESIDUAL_FLOOR * F.col("s_1_1"))
    partial = F.when(enough, exy / F.sqrt(F.when(enough, exx * eyy)))
    return m.filter("n > 0").select(*by, F.col(group).alias(out), "n", partial.alias("partial"))


def windowed_changes(df: DataFrame, keys: list[str], period: str, values: list[str], windows: list[tuple[int, int]]) -> DataFrame:
    """Endpoint changes of every window, stacked with its bounds."""
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in windows])
    fanned = df.withColumn("_w", F.explode(spans)).filter(
        (F.col(period) == F.col("_w.start")) | (F.col(period) == F.col("_w.end"))
    )
    aggs = []
    for v in values:
        for side in ("start", "end"):
            aggs.append(
                F.max(F.when(F.col(period) == F.col(f"_w.{side}"), F.col(v))).alias(f"{v}_{side}")
            )
    return (
        fanned.groupBy(*keys, F.col("_w.start").alias("w_start"), F.col("_w.end").alias("w_end"))
        .agg(*aggs)
        .select(
            *keys,
            "w_start",
            "w_end",
            *[c for v in values for c in (f"{v}_start", f"{v}_end")],
            *[
                ((F.col(f"{v}_end") - F.col(f"{v}_start")) / F.nullif(F.col(f"{v}_start").cast("double"), F.lit(0.0)) * 100).alias(f"{v}_pct")
                for v in values
            ],
        )
    )
