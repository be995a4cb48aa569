"""What the two classifiers share: which rows are held out, and bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str = "k") -> Column:
    """True where the crc32 of the key as text leaves remainder 0 by 5; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def label_table(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(k, y) for rows to learn from: one label of 0 to 1 for each key outside the held-out fold; repeated labels are averaged,
    null keys and labels dropped."""
    rows = labels.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{label}`").cast("double").alias("y"))
    return rows.filter(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out()).groupBy("k").agg(F.avg("y").alias("y"))


def sample(labels: DataFrame, ones: int, zeros: int) -> DataFrame:
    """At most so many rows (k, y) of either class, chosen by hash of the key, the same ones in each run."""
    order = [F.xxhash64("k", F.lit(11)), "k"]
    return labels.filter("y >= 0.5").orderBy(*order).limit(ones).union(labels.filter("y < 0.5").orderBy(*order).limit(zeros))
