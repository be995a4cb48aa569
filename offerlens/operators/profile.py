"""Table profiles: shapes, nulls, counts, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import exprs as X


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, number of columns, column list and types of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            F.lit(",".join(df.columns)).alias("column_names"),
            F.lit(",".join(t for _, t in df.dtypes)).alias("column_types"))
        for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column, only columns with any, most first; one pass over the table."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns])
    return one.select(F.inline(cells)).filter("null_count > 0").orderBy(F.desc("null_count"), "column_name")


def preview(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def split_summary(events: DataFrame) -> DataFrame:
    """Per split: first and last time, users, events, distinct user-item pairs.

    Pairs are folded before users are counted, so neither count needs more than one row per pair.
    """
    pairs = events.groupBy("split", "user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    users = pairs.groupBy("split", "user_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return users.groupBy("split").agg(
        F.min("lo").alias("start_ts"), F.max("hi").alias("end_ts"), F.count(F.lit(1)).alias("users"),
        F.sum("n").alias("positive_events"), F.sum("p").alias("unique_positive_pairs"))


def group_size_summary(df: DataFrame, key: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of the rows per key.

    Sizes are counted by value first: quartiles are read off a table with one row per distinct size.
    """
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("size")
    placed = hist.select("size", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                         F.sum("n").over(Window.partitionBy()).alias("total"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("size")))

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("total") - 1)
        low = F.floor(place)
        share = F.max(place - low)
        high = F.least(low + 1, F.col("total") - 1)
        return at(low) + share * (at(high) - at(low))

    n, s = F.sum("n"), F.sum(F.col("n") * F.col("size"))
    ss = F.sum(F.col("n") * F.col("size") * F.col("size"))
    return placed.agg(
        n.cast("bigint").alias("count"), (s / n).alias("mean"),
        F.when(n > 1, F.sqrt((ss - s * s / n) / F.nullif(n - 1, F.lit(0)))).alias("std"),
        F.min("size").alias("min"), quantile(0.25).cast("double").alias("p25"), quantile(0.5).cast("double").alias("p50"),
        quantile(0.75).cast("double").alias("p75"), F.max("size").alias("max"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Contingency table; `values` lists the column values, so the plan needs no extra pass to find them."""
    out = df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)
    return out.select(rows, *[F.col(f"`{v}`").cast("bigint").alias(f"{columns}_{v}") for v in values])


def value_counts(df: DataFrame, column: str, keep_nulls: bool = True) -> DataFrame:
    kept = df if keep_nulls else df.filter(F.col(column).isNotNull())
    return kept.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def sample_balance(pairs: DataFrame) -> DataFrame:
    """Positives, negatives, their ratio, users, items and mean rows per user of a labelled sample."""
    cells = pairs.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"))
    users = cells.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).agg(
        F.sum("p").alias("positive_samples"), (F.sum("n") - F.sum("p")).alias("negative_samples"),
        (F.sum("p") / F.sum("n")).alias("positive_ratio"), F.count("user_id").alias("unique_users"),
        (F.sum(F.when(F.col("user_id").isNotNull(), F.col("n"))) / F.count("user_id")).alias("avg_samples_per_user"))
    items = cells.groupBy("item_id").agg(F.lit(1).alias("one")).agg(F.count("item_id").alias("unique_items"))
    return users.select("*", items.scalar().alias("unique_items"))


def sample_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """A reproducible sample of n distinct users (all of them where there are fewer)."""
    distinct = users.select("user_id").distinct()
    key = X.as_number(F.col("user_id"), dict(users.dtypes)["user_id"])
    return distinct.orderBy(X.draw([key], seed), "user_id").limit(n)


def audit_sample(pairs: DataFrame, items: DataFrame, n_users: int = 3, n_rows: int = 12, seed: int = 42) -> DataFrame:
    """For n sampled users their first rows with item attributes, by event ascending and label descending."""
    chosen = pairs.join(sample_users(pairs, n_users, seed), "user_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy("positive_event_id", F.desc("label"), "item_id")
    first = chosen.withColumn("row_in_user", F.row_number().over(w)).filter(F.col("row_in_user") <= n_rows)
    return first.join(items.select("item_id", "genre_name", "discount_price", "price_rate"), "item_id", "left")


def unique_counts(events: DataFrame) -> DataFrame:
    """Events, distinct user-item pairs and distinct users."""
    pairs = events.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    users = pairs.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("p"))
    return users.agg(F.sum("n").alias("events"), F.sum("p").alias("unique_pairs"), F.count("user_id").alias("users"))
