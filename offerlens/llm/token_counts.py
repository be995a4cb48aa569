"""Token counts of a corpus from an exact histogram of encoded lengths.

Documents are encoded once and only their lengths are kept, folded to (length, documents) in each task and by length after
one shuffle of a few rows.  Suffix sums over the histogram then answer every question about totals, quantiles and context limits
without another look at the texts.  The sums run in two levels, over stretches of 1024 lengths and within each, so no task needs
the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm import bpe
from offerlens.session import materialized

STRETCH = 1024


def length_histogram(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """(n_tokens, docs): the number of documents of each encoded length; null and empty texts have length 0; an empty
    table gives no row; repeated rows count each; other columns are ignored."""
    return bpe.token_lengths(docs, model, text).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length n that occurs: docs (of that length), docs_from and tokens_from (of length n and more), docs_to and
    tokens_to (of length n and less), truncated_tokens (the total if every document is cut at n) and quantile (the share of documents
    of length n and less)."""
    h = materialized(histogram.withColumn("stretch", F.floor(F.col("n_tokens") / STRETCH)))
    t = F.col("n_tokens") * F.col("docs")
    blocks = h.groupBy("stretch").agg(F.sum("docs").alias("d"), F.sum(t).alias("t"))  # one row for 1024 lengths
    after = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nil = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("stretch", nil(F.sum("d").over(after)).alias("d_after"), nil(F.sum("t").over(after)).alias("t_after"),
                           F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    within = Window.partitionBy("stretch").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.select("*", F.sum("docs").over(within).alias("d_in"), F.sum(t).over(within).alias("t_in")).join(blocks, "stretch")
    s = s.select("n_tokens", "docs", (F.col("d_in") + F.col("d_after")).alias("docs_from"),
                 (F.col("t_in") + F.col("t_after")).alias("tokens_from"), "all_docs", "all_tokens")
    to = F.col("all_docs") - F.col("docs_from") + F.col("docs")
    below = F.col("all_tokens") - F.col("tokens_from")
    return s.select("n_tokens", "docs", "docs_from", "tokens_from", to.alias("docs_to"),
                    (below + F.col("n_tokens") * F.col("docs")).alias("tokens_to"),
                    (below + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
                    (to / F.col("all_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, whole_docs, truncated_tokens) for any context limits: documents no longer than the limit, and the total
    tokens if every document is cut there.  `sums` comes from suffix_sums; limits are few and given by the caller."""
    whole = F.col("n_tokens") <= F.col("limit")
    each = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])))
    return each.groupBy("limit").agg(
        F.sum(F.when(whole, F.col("docs")).otherwise(0)).alias("whole_docs"),
        F.sum(F.col("docs") * F.least("n_tokens", "limit")).alias("truncated_tokens"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of the documents doesn't exceed."""
    each = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return each.filter(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
