"""Whole rows for a decision that was made on keys and a number of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_number(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs whose (key, number of the text) is in `kept` (k, tk), one for each of these; null keys are keys."""
    d = docs.withColumn("__k", F.col(f"`{key}`").cast("bigint")).withColumn("__tk", text_number(text))
    kept = kept.select(F.col("k").alias("__k2"), F.col("tk").alias("__tk2"))
    same = F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__tk") == F.col("__tk2"))
    rows = d.join(kept, same, "left_semi")
    many = d.groupBy("__k", "__tk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__k").alias("__k2"), F.col("__tk").alias("__tk2"))
    if not many.isEmpty():  # rows that repeat key and text
        rows = rows.join(many, same, "left_anti").unionByName(rows.join(many, same, "left_semi").dropDuplicates(["__k", "__tk"]))
    return rows.drop("__k", "__tk")
