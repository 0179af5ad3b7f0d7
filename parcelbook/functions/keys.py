"""Name, label and code cleansing (all JVM-side expressions)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Latin letters whose decomposition starts with one ASCII letter, from a rule."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter).encode("ascii", "ignore").decode()
        if len(base) == 1 and base.isalpha():
            src.append(letter)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()

# fixed values: articles that publishers move to the end of a place name
ARTICLES = ["EL", "LA", "LOS", "LAS", "ELS", "LES", "ES", "SA", "SES", "NA", "EN", "L"]
# fixed values: qualifiers that tag an aggregate instead of a place
QUALIFIERS = ["(CIUDAD)", "(PROVINCIA)"]


def ascii_fold(c: Column) -> Column:
    """Accents removed; what has no ASCII base letter is dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def norm_name(c: Column) -> Column:
    """Upper case, no accents, single spaces."""
    return F.trim(F.regexp_replace(F.upper(ascii_fold(c)), r"\s+", " "))


def flat_key(c: Column) -> Column:
    """Normalised name with only letters and digits left."""
    return F.regexp_replace(norm_name(c), "[^A-Z0-9]", "")


def place_key(c: Column) -> Column:
    """Comparison key of a place: no qualifier, punctuation, leading or trailing article.

    A leading article always goes, a trailing one only if something else remains.
    """
    s = F.upper(ascii_fold(c))
    for q in QUALIFIERS:
        s = F.replace(s, F.lit(q), F.lit(""))
    words = F.filter(
        F.split(F.regexp_replace(s, "[^A-Z ]", " "), " "), lambda w: w != F.lit("")
    )
    articles = F.array(*[F.lit(a) for a in ARTICLES])

    def is_article(w: Column) -> Column:
        return F.array_contains(articles, w)

    n = F.size(words)
    body = F.when(
        (n > 0) & is_article(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))),
        F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
    ).otherwise(words)
    m = F.size(body)
    tail = F.coalesce(F.try_element_at(body, F.lit(-1)), F.lit(""))
    kept = F.when((m > 1) & is_article(tail), F.slice(body, F.lit(1), m - 1)).otherwise(body)
    return F.array_join(kept, " ")


def uninvert(c: Column) -> Column:
    """``Base, Article`` -> ``Article Base``."""
    return F.regexp_replace(c, r"^(.*),\s*(.*)$", "$2 $1")


def strip_code(c: Column) -> Column:
    """Remove a leading numeric code and its dot from a label."""
    return F.trim(F.regexp_replace(c, r"^\s*\d+\.?\s+", ""))


def split_code(c: Column) -> tuple[Column, Column]:
    """``41091 Name`` -> (code, name); both null when the label has no code."""
    has = c.rlike(r"^\d+\s+\S")
    return (
        F.when(has, F.regexp_extract(c, r"^(\d+)\s+(.*)$", 1)),
        F.when(has, F.regexp_extract(c, r"^(\d+)\s+(.*)$", 2)),
    )


def dotted_parts(c: Column) -> Column:
    """``A. B. C.`` -> trimmed non-empty parts."""
    return F.filter(F.transform(F.split(c, r"\."), lambda p: F.trim(p)), lambda p: p != F.lit(""))


def classify_parts(parts: Column, measures: list[str]) -> tuple[Column, Column]:
    """(territory, measure) from two parts in either order, else nulls."""
    known = F.array(*[F.lit(m) for m in measures])
    hit = F.filter(parts, lambda p: F.array_contains(known, p))
    rest = F.filter(parts, lambda p: ~F.array_contains(known, p))
    ok = (F.size(hit) == 1) & (F.size(rest) == 1)
    return (
        F.when(ok, F.try_element_at(rest, F.lit(1))),
        F.when(ok, F.try_element_at(hit, F.lit(1))),
    )


def zfill(c: Column, width: int) -> Column:
    """Zero-padded text code; longer codes are kept whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def merged_unit(code: Column, members: list[str]) -> Column:
    """Replace each member code by the joint code ``a+b``."""
    return F.when(code.isin(members), F.lit("+".join(members))).otherwise(code)


def is_unit_code(code: Column, digits: int = 5, residual: str = "999") -> Column:
    """Full numeric code that is not a residual aggregate."""
    return code.rlike(f"^[0-9]{{{digits}}}$") & (F.right(code, F.lit(len(residual))) != residual)


def repair_case(a: Column, b: Column) -> tuple[Column, Column]:
    """(upper-cased reference, repaired?) when a second id agrees ignoring case."""
    agree = F.upper(a) == F.upper(b)
    return F.when(agree, F.upper(a)), agree & (a != F.upper(a))


def labels_agree(a: Column, b: Column) -> Column:
    """Same place key; a province qualifier or a residual never agrees with a place."""
    odd = F.lower(a).contains("(provincia)") | a.rlike(r"(?i)^resto\b")
    return F.when(odd, F.lit(False)).otherwise(place_key(a) == place_key(b))
