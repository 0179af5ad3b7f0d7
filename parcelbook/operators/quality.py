"""Data-quality rules: each returns the violating rows or one verdict row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelbook.operators.joins import unmatched_numbers


def additive_breaks(df: DataFrame, parts: list[str], total: str, tol: float = 0.0) -> DataFrame:
    """Rows whose parts do not add up to the total within the tolerance."""
    gap = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) - F.col(total)
    return df.withColumn("gap", gap).filter(F.abs("gap") > tol)


def hierarchy_breaks(
    leaf: DataFrame, published: DataFrame, parent: str, keys: list[str], value: str, tol: float = 0.0, known: list[tuple] | None = None
) -> DataFrame:
    """Leaf sums against published parent rows per key; pinned gaps of the publisher are left out."""
    sums = leaf.groupBy(parent, *keys).agg(F.sum(value).alias("leaf_sum"))
    joined = sums.join(published.select(parent, *keys, F.col(value).alias("published")), [parent, *keys], "full")
    gap = F.coalesce(F.col("leaf_sum"), F.lit(0.0)) - F.coalesce(F.col("published"), F.lit(0.0))
    out = joined.withColumn("gap", gap).filter(F.abs("gap") > tol)
    for pinned in known or []:
        match = F.lit(True)
        for name, v in zip([parent, *keys], pinned, strict=True):
            match = match & (F.col(name) == v)
        out = out.filter(~match)
    return out


def missing_cells(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the expected grid that were not observed."""
    return expected.select(*keys).join(observed.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, and whether their rows agree."""
    whole = F.xxhash64(*(values or df.columns))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("rows"), (F.min(whole) == F.max(whole)).alias("identical"))
        .filter(F.col("rows") > 1)
    )


def value_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every row that breaks a rule; a null verdict is no violation."""
    named = F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return df.select(key, F.explode(F.array_compact(named)).alias("rule"))


def unknown_labels(df: DataFrame, label: str, vocabulary: list[str]) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & ~F.col(label).isin(vocabulary)).groupBy(label).agg(
        F.count("*").alias("rows")
    )


@dataclass(frozen=True)
class Claim:
    """A number that a source must give: one aggregate function, over the rows where ``where`` holds."""

    label: str
    source: str
    aggregate: str
    expected: float
    tol: float = 0.0
    where: str | None = None


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def check_claims(sources: dict[str, DataFrame], claims: list[Claim]) -> DataFrame:
    """(label, expected, found, tol, verdict), one row a claim; each source is scanned once.

    All claims on a source become one aggregate with a filter each, and claims that ask
    the same are asked once, so thousands of claims cost as many scans as there are
    sources. A claim without a value fails.
    """
    out = None
    for name in dict.fromkeys(c.source for c in claims):
        own = [c for c in claims if c.source == name]
        asked = {q: f"_a{i}" for i, q in enumerate(dict.fromkeys((c.aggregate, c.where) for c in own))}
        found = sources[name].agg(*[F.expr(f"CAST({agg}{f' FILTER (WHERE {where})' if where else ''} AS DOUBLE) AS {col}") for (agg, where), col in asked.items()])
        # one text for all claims: building it column by column would take longer than the scan
        entries = [f"named_struct('label', {_quoted(c.label)}, 'expected', {float(c.expected)!r}D, 'found', {asked[c.aggregate, c.where]}, 'tol', {float(c.tol)!r}D)" for c in own]
        rows = found.selectExpr(f"inline(array({', '.join(entries)}))")
        out = rows if out is None else out.unionByName(rows)
    close = F.abs(F.col("found") - F.col("expected")) <= F.col("tol")
    return out.withColumn("verdict", F.when(close, "ok").otherwise("fail"))


def anchor_gap(a: DataFrame, b: DataFrame, unit: str, value: str, units: int, limit_pct: float) -> DataFrame:
    """Worst percent gap of two totals and whether exactly ``units`` units are covered."""
    j = a.select(unit, F.col(value).alias("_a")).join(b.select(unit, F.col(value).alias("_b")), unit)
    j = j.withColumn("_g", 100.0 * F.abs(F.col("_a") - F.col("_b")) / F.nullif(F.col("_b").cast("double"), F.lit(0.0)))
    return j.agg(
        F.max("_g").alias("worst_pct"),
        F.max_by(unit, F.struct(F.col("_g"), F.col(unit))).alias("worst_unit"),
        F.count("*").alias("covered"),
    ).withColumn("passed", (F.col("worst_pct") <= limit_pct) & (F.col("covered") == units))


def headline_agreement(cuts: DataFrame, metric: str, value: str, tol: float) -> DataFrame:
    """The same total published in several cuts must agree; one source alone is an error."""
    return cuts.groupBy(metric).agg(
        F.count("*").alias("sources"), (F.max(value) - F.min(value)).alias("spread")
    ).withColumn(
        "verdict",
        F.when(F.col("sources") < 2, "single_source").when(F.col("spread") > tol, "disagree").otherwise("ok"),
    )


def share_identity(df: DataFrame, group: list[str], share: str, tol_each: float = 0.06) -> DataFrame:
    """Shares of a group add to 100 within the tolerance per cell; gaps skip the check."""
    return df.groupBy(*group).agg(
        F.count("*").alias("cells"),
        F.count_if(F.col(share).isNull()).alias("missing"),
        F.sum(share).alias("share_sum"),
    ).withColumn(
        "verdict",
        F.when(F.col("missing") > 0, "checks_skipped")
        .when(F.abs(F.col("share_sum") - 100) > tol_each * F.col("cells"), "fail")
        .otherwise("ok"),
    )


def era_completeness(df: DataFrame, period: str, value: str, start: int) -> DataFrame:
    """A column must be empty before a year and full from it."""
    early = F.col(period) < start
    return df.agg(
        F.count_if(early & F.col(value).isNotNull()).alias("filled_before"),
        F.count_if(~early & F.col(value).isNull()).alias("empty_after"),
    ).withColumn("passed", (F.col("filled_before") == 0) & (F.col("empty_after") == 0))


def row_sums(df: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows, total, marks): order-free sums of two hashes of whole rows, nulls told apart by place."""
    cells = [c for name in df.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    hashed = df.select(F.xxhash64(*cells).alias("h"), F.hash(*cells, F.lit(7)).alias("g"))
    return hashed.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor(F.col("h").bitwiseXOR(F.col("g").cast("long") * 4294967297)).alias("marks"))


def table_difference(stored: DataFrame, fresh: DataFrame, buckets: int = 4096) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity (order-free), by ``side``.

    Both tables are reduced to hash sums of buckets of rows; rows are compared only in
    the buckets whose sums differ, so equal tables shuffle ``buckets`` sums and nothing
    else. Two rows that differ are taken for equal only if two hash sums agree by chance.
    """
    names = stored.columns
    other = fresh.select(*names)
    a, b = row_sums(stored, buckets), row_sums(other, buckets)
    same = (F.col("a.rows") == F.col("b.rows")) & (F.col("a.total") == F.col("b.total")) & (F.col("a.marks") == F.col("b.marks"))
    apart = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full").filter(~F.coalesce(same, F.lit(False)))
    odd = [r[0] for r in apart.select(F.coalesce("a.bucket", "b.bucket")).collect()]  # at most ``buckets`` numbers
    cells = [c for name in names for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    inside = F.pmod(F.xxhash64(*cells), F.lit(buckets)).cast("int").isin(odd) if odd else F.lit(False)
    left, right = stored.filter(inside), other.filter(inside)
    return left.exceptAll(right).withColumn("side", F.lit("stored")).unionByName(right.exceptAll(left).withColumn("side", F.lit("fresh")))


def coverage_report(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Rows, year range and null counts of each table, stacked."""
    out = None
    for name, (df, year, columns) in tables.items():
        row = df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("rows"),
            F.min(year).cast("int").alias("first_year"),
            F.max(year).cast("int").alias("last_year"),
            sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)).cast("long").alias("nulls"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------ numbers in text


#: Signs that part two tokens, and the minus sign; each maps to one character.
_MARKS = ("−–—→×~±…†²", "-         ")
_OPEN, _CLOSE = r"^[(\[{<'\"*_]+", r"[)\]}>'\"*_.,;:!?]+$"
_RANGE = r"^[+-]?[0-9][0-9.,]*(-[0-9][0-9.,]*)+[kM%]?$"
_DATE = r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"
_GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?[kM%y]?$"
_PLAIN = r"^[+-]?[0-9]+(\.[0-9]+)?[kM%y]?$"
_COMMA = r"^[+-]?[0-9]+,[0-9]{1,2}[kM%y]?$"


#: The same with all white space made blanks, so that words are found by classes of one sign (five times faster).
_BLANKS = (_MARKS[0] + "\t\n\x0b\f\r", _MARKS[1] + " " * 5)
#: A whole word that holds a digit; looked for where a word begins only, so a long one costs its length.
_WORD = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def prose_tokens(text: Column) -> Column:
    """Words with a digit of a text outside code: what stands between backticks is every other piece.

    All other words are passed over in one search of the text, before any of them is a value.
    """
    pieces = F.filter(F.split(text, "`"), lambda _, i: i % 2 == 0)
    prose = F.regexp_replace(F.array_join(pieces, " "), r"(?:^|\n)[ \t]*[0-9]+[.][ \t]+", " ")
    words = F.filter(F.regexp_extract_all(F.translate(prose, *_BLANKS), F.lit(_WORD), 0), lambda w: F.instr(w, "://") == 0)
    return F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, _OPEN, ""), _CLOSE, ""))


def text_numbers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, token, value, slack) of every number in a text.

    A text is cut into words once and each whole word is one of: a range (both ends
    count), a number with grouped thousands, a plain one or one with a decimal comma,
    perhaps with k, M, % or y behind it; any other word has no number, so dates, labels
    and identifiers drop out. A lone digit, a whole number of years and a calendar year
    are labels. Slack is half the last printed place, scaled like the number.
    """
    word = df.select(*keys, F.explode(prose_tokens(F.col(text))).alias("word"))
    ends = F.when(F.col("word").rlike(_DATE), F.array().cast("array<string>")).when(F.col("word").rlike(_RANGE), F.filter(F.split("word", "-"), lambda e: e != "")).otherwise(F.array("word"))
    token = word.select(*keys, F.explode(ends).alias("token"))
    t = F.col("token")
    digits = F.regexp_replace(t, "[kM%y]$", "")
    number = F.when(t.rlike(_GROUPED), F.replace(digits, F.lit(","), F.lit(""))).when(t.rlike(_PLAIN), digits).when(t.rlike(_COMMA), F.replace(digits, F.lit(","), F.lit(".")))
    unit = F.right(t, F.lit(1))
    scale = F.when(unit == "k", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    places = F.when(F.instr("number", ".") > 0, F.length("number") - F.instr("number", ".")).otherwise(0)
    out = token.withColumn("number", number).where(F.col("number").isNotNull() & ~t.rlike("^[+-]?[0-9]$") & ~t.rlike("^[+-]?[0-9]+y$"))
    out = out.select(*keys, "token", (F.col("number").try_cast("double") * scale).alias("value"), (F.lit(0.5) * F.pow(F.lit(10.0), -places) * scale).alias("slack"))
    year = (F.col("value") == F.floor("value")) & F.col("value").between(1990, 2030)
    return out.filter(F.col("value").isNotNull() & ~year)


def unexplained(numbers: DataFrame, claims: DataFrame, allowed: list[float], value: str = "value", slack: str = "slack", claim: str = "claim", tol: str = "tol") -> DataFrame:
    """Numbers of a text that no claim and no allowed value accounts for."""
    rest = numbers
    for v in allowed:
        rest = rest.filter(F.abs(F.col(value) - v) > 1e-9)
    return unmatched_numbers(rest, claims, value, slack, claim, tol)
