"""Joins with explicit rules for ambiguity, absence and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelbook.functions.keys import labels_agree


def endpoint_change(
    df: DataFrame, keys: list[str], period: str, start: int, end: int, values: list[str]
) -> DataFrame:
    """Start, end and change of every measure, in one pass instead of a self-join."""
    aggs = []
    for v in values:
        aggs.append(F.max(F.when(F.col(period) == start, F.col(v))).alias(f"{v}_start"))
        aggs.append(F.max(F.when(F.col(period) == end, F.col(v))).alias(f"{v}_end"))
    wide = df.filter(F.col(period).isin(start, end)).groupBy(*keys).agg(*aggs)
    for v in values:
        wide = wide.withColumn(f"{v}_change", F.col(f"{v}_end") - F.col(f"{v}_start"))
    return wide


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.join(b, key, "left_anti")
        .withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))
    )


def unique_match(
    left: DataFrame, right: DataFrame, key: str, left_label: str, right_label: str, value: str
) -> DataFrame:
    """Attach a value only if its key is unique and labels agree; else say why not."""
    side = right.groupBy(key).agg(
        F.count("*").alias("matches"),
        F.max(right_label).alias("_label"),
        F.max(value).alias("_value"),
    )
    joined = left.join(side, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = (
        F.when(F.col("matches") == 0, "missing")
        .when(F.col("matches") > 1, "duplicate")
        .when(~F.coalesce(labels_agree(F.col("_label"), F.col(left_label)), F.lit(False)), "label_mismatch")
        .when(F.col("_value").isNull(), "missing")
        .when(F.col("_value") <= 0, "nonpositive")
        .otherwise("valid")
    )
    return (
        joined.withColumn("status", status)
        .withColumn("value", F.when(F.col("status") == "valid", F.col("_value")))
        .drop("_label", "_value")
    )


def with_fallback(primary: Column, fallback: Column, names: tuple[str, str]) -> tuple[Column, Column]:
    """(value, source): the primary, else the fallback, else nothing."""
    return F.coalesce(primary, fallback), F.when(primary.isNotNull(), F.lit(names[0])).when(
        fallback.isNotNull(), F.lit(names[1])
    )


def quarantine_homonyms(df: DataFrame, key: list[str], name: str, attributes: list[str]) -> DataFrame:
    """Keys shared by several display names keep their rows but lose the attributes."""
    spellings = df.groupBy(*key).agg((F.min(name) != F.max(name)).alias("ambiguous"))
    out = df.join(spellings, key, "left")
    for a in attributes:
        out = out.withColumn(a, F.when(~F.col("ambiguous"), F.col(a)))
    return out


def attach_by_name(
    left: DataFrame,
    right: DataFrame,
    scope: list[str],
    key: str,
    name: str,
    attribute: str,
    only_when: Column | None = None,
) -> DataFrame:
    """Cross-publisher attribute by canonical key inside a scope.

    A key that several right-hand names share gives nothing; ``only_when`` limits the
    attribute to some rows (for instance one year).
    """
    side = (
        right.groupBy(*scope, key)
        .agg(
            F.count("*").alias("_n"),
            (F.min(name) != F.max(name)).alias("_clash"),
            F.max(attribute).alias("_a"),
        )
        .withColumn(attribute, F.when((F.col("_n") == 1) & ~F.col("_clash"), F.col("_a")))
        .drop("_n", "_clash", "_a")
    )
    out = left.join(side, [*scope, key], "left")
    if only_when is not None:
        out = out.withColumn(attribute, F.when(only_when, F.col(attribute)))
    return out


def crosswalk_check(a: DataFrame, b: DataFrame, key: str, code_a: str, code_b: str) -> DataFrame:
    """Code pairs by key with the reason when a pair cannot be trusted."""
    left = a.groupBy(key).agg(F.count("*").alias("_na"), F.max(code_a).alias(code_a))
    right = b.groupBy(key).agg(F.count("*").alias("_nb"), F.max(code_b).alias(code_b))
    return left.join(right, key, "full").select(
        key,
        F.when(F.coalesce("_na", F.lit(1)) == 1, F.col(code_a)).alias(code_a),
        F.when(F.coalesce("_nb", F.lit(1)) == 1, F.col(code_b)).alias(code_b),
        F.when(F.col("_nb").isNull(), "missing_right")
        .when(F.col("_na").isNull(), "missing_left")
        .when((F.col("_na") > 1) | (F.col("_nb") > 1), "duplicate")
        .otherwise("ok")
        .alias("pair_status"),
    )


def tolerance_buckets(value: Column, width: Column) -> Column:
    """Bucket of a number and its two neighbours, for a range join by equality."""
    b = F.floor(value / width)
    return F.array(b - 1, b, b + 1)


def unmatched_numbers(
    numbers: DataFrame, claims: DataFrame, value: str, slack: str, claim: str, tol: str, width: float | None = None
) -> DataFrame:
    """Numbers that lie within tolerance + slack of no claim.

    Both sides are bucketed by a width of at least the largest sum of tolerance and
    slack: ``width``, or the power of ten above each number's own sum, so that coarse
    numbers do not crowd one bucket with fine ones. Claims are spread over three
    neighbouring buckets of each width, numbers stay in one, and the residual test is
    exact. Distinct (value, slack) pairs are tested once and the verdict is joined back,
    so a hot number costs one probe.
    """
    probe = numbers.select(value, slack).distinct()
    if width is None:
        most = claims.agg(F.max(tol)).first()[0] or 0.0
        probe = probe.withColumn("_e", F.ceil(F.log10(F.col(slack) + F.lit(float(most)))).cast("int"))
        powers = sorted(r[0] for r in probe.select("_e").distinct().collect() if r[0] is not None)  # at most one for each digit of a double
        sizes = F.array(*[F.struct(F.lit(e).alias("_e"), F.lit(10.0**e).alias("_w")) for e in powers]) if powers else F.array().cast("array<struct<_e:int,_w:double>>")
        probe = probe.withColumn("_w", F.pow(F.lit(10.0), F.col("_e")))
    else:
        sizes = F.array(F.struct(F.lit(0).alias("_e"), F.lit(float(width)).alias("_w")))
        probe = probe.withColumns({"_e": F.lit(0), "_w": F.lit(float(width))})
    probe = probe.withColumn("_b", F.floor(F.col(value) / F.col("_w"))).drop("_w")
    dealt = claims.select(F.col(claim).alias("_c"), F.col(tol).alias("_t"), F.explode(sizes).alias("_s"))
    spread = dealt.select("_c", "_t", F.col("_s._e").alias("_e"), F.explode(tolerance_buckets(F.col("_c"), F.col("_s._w"))).alias("_b")).distinct()
    hit = F.abs(F.col(value) - F.col("_c")) <= F.col("_t") + F.col(slack)
    lonely = probe.join(spread, (probe["_b"] == spread["_b"]) & (probe["_e"] == spread["_e"]) & hit, "left_anti").drop("_b", "_e")
    return numbers.join(lonely, [value, slack], "left_semi")
