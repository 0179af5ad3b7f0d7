"""Number parsing and null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelbook.functions import let

# fixed values: spellings of "not published"
SENTINELS = ["", "nd", "n.d.", "-", "...", ".", ".."]


def strict_number(c: Column) -> tuple[Column, Column]:
    """(value, error) of a dot-thousands, comma-decimals number.

    Blank and dot cells are "not published" (null, no error); any other text that
    is not a full match of the locale is flagged and yields null.
    """
    t = F.trim(c)
    absent = c.isNull() | t.isin("", ".", "..")
    ok = t.rlike(r"^-?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$")
    value = F.when(~absent & ok, F.translate(t, ",.", ".").try_cast("double"))
    return value, ~absent & ~ok


def drop_sentinel(c: Column, zero_is_missing: bool = False) -> Column:
    """Text cell to double; sentinels (and optionally 0) become null."""
    t = F.lower(F.trim(c))
    v = F.when(~t.isin(SENTINELS), F.translate(t, ",", ".").try_cast("double"))
    return F.nullif(v, F.lit(0.0)) if zero_is_missing else v


def mixed_separator_number(c: Column) -> Column:
    """Number whose decimal mark is whichever separator comes last.

    One lone comma followed by at most two digits is a decimal mark; other commas
    are thousands marks. A cell holding only separators is null.
    """

    def read(t: Column) -> Column:
        dots = F.length(t) - F.length(F.translate(t, ".", ""))
        commas = F.length(t) - F.length(F.translate(t, ",", ""))
        # the last separator is the first one of the reversed text
        dot_is_last = F.regexp_extract(F.reverse(t), "([.,])", 1) == "."
        both = (dots > 0) & (commas > 0)
        lone = (commas == 1) & t.rlike(r",\d{0,2}$")
        text = (
            F.when(both & dot_is_last, F.translate(t, ",", ""))
            .when(both, F.translate(t, ",.", "."))
            .when(lone, F.translate(t, ",", "."))
            .otherwise(F.translate(t, ",", ""))
        )
        return F.when(~t.rlike(r"^[.,]*$"), text.try_cast("double"))

    return let(F.trim(c), read)


def thousands_to_units(c: Column) -> Column:
    """Published thousands -> whole units, half to even."""
    return F.bround(c * 1000, 0).cast("long")


def ratio(num: Column, den: Column, digits: int | None = None, scale: float = 1.0) -> Column:
    """``scale * num / den``; null when the denominator is missing or zero."""
    q = F.lit(float(scale)) * num / F.nullif(den.cast("double"), F.lit(0.0))
    return q if digits is None else F.bround(q, digits)


def real(c: Column, digits: int = 6) -> Column:
    """Rounded double for published output (and no negative zero)."""
    r = F.round(c.cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def finite(c: Column) -> Column:
    """True for an actual finite number."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def whole_or_null(c: Column) -> Column:
    """Value as a count only when it has no fraction."""
    return F.when(c == F.floor(c), c.cast("long"))


def annuity(principal: Column, monthly_rate: Column, months: Column) -> Column:
    """Constant payment; straight line at zero rate, zero for no loan."""
    return (
        F.when(principal <= 0, F.lit(0.0))
        .when(monthly_rate == 0, principal / months)
        .otherwise(principal * monthly_rate / (1 - F.pow(1 + monthly_rate, -months)))
    )
