"""Where the named queries and their SQL equivalents are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it on whole tables, its equivalent."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tidy(df: DataFrame) -> DataFrame:
    """Engine-neutral types: integers as bigint, floats as doubles with six decimals, instants as epoch micros, lists as
    texts."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("bigint")
        elif dtype in ("float", "double"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif dtype == "timestamp":
            c = F.unix_micros(c)
        elif dtype.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(name))
    return df.select(*out)
