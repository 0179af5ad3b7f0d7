"""Delimited text: every column text, header checked, margins kept by filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c1_table() -> tuple[str, str]:
    """Control characters of ISO-8859-1 and what they mean in windows-1252."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    kept = [(a, z) for a, z in pairs if z]
    return "".join(a for a, _ in kept), "".join(z for _, z in kept)


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(
    spark: SparkSession, path: str, names: list[str], sep: str = ";", encoding: str = "UTF-8"
) -> DataFrame:
    """Header-checked scan with no type inference; a byte-order mark is ignored.

    Spark compares the header of every file with ``names``, in every encoding, and a
    file that differs fails the scan. windows-1252 is read as ISO-8859-1, which differs
    only in one block of characters that a column translation then restores.
    """
    legacy = encoding.lower() in ("windows-1252", "cp1252")
    df = (
        spark.read.schema(text_schema(names))
        .option("sep", sep)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", "ISO-8859-1" if legacy else encoding)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    if not legacy:
        return df
    src, dst = _c1_table()
    return df.select(*[F.translate(n, src, dst).alias(n) for n in names])


def parse_line(line: Column, names: list[str], sep: str = ";") -> Column:
    """Struct of text cells of one delimited line held in a column."""
    ddl = ", ".join(f"`{n}` STRING" for n in names)
    return F.from_csv(F.ltrim(line, F.lit("﻿")), ddl, {"sep": sep, "mode": "PERMISSIVE"})


def published_cells(df: DataFrame, value: str) -> DataFrame:
    """Rows whose cell was published (neither blank nor a dash)."""
    return df.filter(~F.trim(F.col(value)).isin("", "-"))


def keep_margin(df: DataFrame, totals: dict[str, str], blanks: list[str] | None = None) -> DataFrame:
    """Keep one margin: given columns equal their total label, others are blank."""
    for name, label in totals.items():
        df = df.filter(F.col(name) == label)
    for name in blanks or []:
        df = df.filter(F.coalesce(F.trim(F.col(name)), F.lit("")) == "")
    return df


def code_and_label(label: Column) -> tuple[Column, Column]:
    """``code label words`` -> code and the rest."""
    parts = F.split(label, " ", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
