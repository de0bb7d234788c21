"""Registration of queries next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register the decorated function as ``name``; ``oracle`` is its check."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r6(col: str | Column, name: str | None = None) -> Column:
    """A double rounded to six places, so both engines print the same value."""
    if isinstance(col, str):
        return F.round(F.col(col).cast("double"), 6).alias(name or col)
    return F.round(col.cast("double"), 6).alias(name)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})
