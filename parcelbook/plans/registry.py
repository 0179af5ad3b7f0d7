"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelbook.functions.numbers import real

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def published(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; other columns untouched."""
    return df.select(
        *[
            real(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return published(fn(spark, folder))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register
