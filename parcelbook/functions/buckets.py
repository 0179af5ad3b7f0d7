"""Ages, eras, surfaces, dates and serials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelbook.functions import let

# fixed values: population age bands (lower, upper, label)
AGE_BANDS = [(0, 19, "0-19"), (20, 34, "20-34"), (35, 49, "35-49"), (50, 64, "50-64"), (65, 999, "65+")]
# fixed values: disjoint survey cohorts and the overlapping published age groups
COHORTS = [(0, 17, "Y_LT18"), (18, 24, "Y18-24"), (25, 29, "Y25-29"), (30, 64, "Y30-64"), (65, 999, "Y_GE65")]
AGE_GROUPS = [(0, 999, "TOTAL"), (18, 24, "Y18-24"), (25, 29, "Y25-29"), (18, 64, "Y18-64"), (65, 999, "Y_GE65")]


def band(c: Column, bands: list[tuple[int, int, str]], missing: str | None = None) -> Column:
    """Label of the closed band that holds the value."""
    out = F.when(c.isNull(), F.lit(missing))
    for lo, hi, label in bands:
        out = out.when(c.between(lo, hi), F.lit(label))
    return out


def band_order(c: Column, bands: list[tuple[int, int, str]]) -> Column:
    """Sort position of the band; missing comes last."""
    out = F.when(c.isNull(), F.lit(len(bands) + 1))
    for i, (lo, hi, _) in enumerate(bands):
        out = out.when(c.between(lo, hi), F.lit(i + 1))
    return out


def reference_age(c: Column) -> Column:
    """Born between income year and interview (-1) counts as 0."""
    return F.when(c == -1, F.lit(0)).otherwise(c)


def age_groups(c: Column) -> Column:
    """Array of every overlapping group that holds the age."""
    groups = F.array(
        *[F.when(c.between(lo, hi), F.lit(label)) for lo, hi, label in AGE_GROUPS]
    )
    return F.array_compact(groups)


_ISO = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?"
    r"(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)?$"
)
NO_DATE = "--01-01T00:00:00"


def construction_date(text: Column) -> Column:
    """struct(year, state) with state missing / invalid / valid."""
    return let(text, _construction_date)


def _construction_date(c: Column) -> Column:
    def decide(year: Column) -> Column:
        good = year.between(1, 2100)
        state = (
            F.when(c.isNull() | (c == NO_DATE), F.lit("missing")).when(good, F.lit("valid")).otherwise(F.lit("invalid"))
        )
        return F.struct(F.when(good & (c != NO_DATE), year).alias("year"), state.alias("state"))

    # the shape bounds clock and offset (14 h), so only the calendar day is left to parse
    parsed = F.when(c.rlike(_ISO), F.year(F.substring(c, 1, 10).try_cast("date")))
    return let(parsed, decide)


def date_quality(start: Column, end: Column) -> Column:
    """struct(year_start, year_end, date_quality, reversed) of a date pair."""

    def join(pair: Column) -> Column:
        ys, ye = pair["s"]["year"], pair["e"]["year"]
        bad = (pair["s"]["state"] == "invalid") | (pair["e"]["state"] == "invalid")
        quality = (
            F.when(bad, F.lit("invalid"))
            .when(ys.isNotNull() & ye.isNotNull(), F.lit("complete"))
            .when(ys.isNull() & ye.isNull(), F.lit("missing"))
            .otherwise(F.lit("partial"))
        )
        return F.struct(
            ys.alias("year_start"),
            ye.alias("year_end"),
            quality.alias("date_quality"),
            F.coalesce(ys > ye, F.lit(False)).alias("reversed"),
        )

    return let(F.struct(construction_date(start).alias("s"), construction_date(end).alias("e")), join)


def month_end_serial(d: Column, epoch: str = "1899-12-30") -> Column:
    """Spreadsheet day number of the month end."""
    return F.datediff(F.last_day(d), F.lit(epoch).cast("date"))


def from_serial(n: Column, epoch: str = "1899-12-30") -> Column:
    """Date of a spreadsheet day number."""
    return F.date_add(F.lit(epoch).cast("date"), n.cast("int"))


def is_month_end(d: Column) -> Column:
    return d == F.last_day(d)
