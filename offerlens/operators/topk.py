"""Ranked lists: the best k rows per key with stable ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: list[str], score: Column, k: int, tie: list[Column], rank: str = "rank") -> DataFrame:
    """The k best rows per key by score, ties in the given order.

    The rank filter lets Spark drop all but k rows per key inside each task before the shuffle, so a key with many
    rows does not travel whole.
    """
    w = Window.partitionBy(*keys).orderBy(score.desc(), *tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_k_distinct(df: DataFrame, keys: list[str], item: str, score: str, k: int, rank: str = "rank") -> DataFrame:
    """As top_k after keeping the best row of each (key, item)."""
    best = df.groupBy(*keys, item).agg(F.max(score).alias(score))
    return top_k(best, keys, F.col(score), k, [F.col(item)], rank)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def global_top(df: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of a table, numbered; each task keeps k rows, so the final sort sees k per task."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
