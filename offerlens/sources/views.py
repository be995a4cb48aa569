"""The user-item world read from the star-schema tables of a data folder.

`events` gives the facts (the item is the number inside `props`), `customer` the users, `part` the items.  Parts that
occur in facts are the known items; parts that never do are the cold target items to be ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import configure


@dataclass(frozen=True)
class World:
    """The six inputs of a ranking job."""

    users: DataFrame
    items: DataFrame
    target_items: DataFrame
    purchases: DataFrame
    visits: DataFrame
    template: DataFrame

    @property
    def all_items(self) -> DataFrame:
        return self.items.unionByName(self.target_items)


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = star_table(spark, sf_dir, "customer"), star_table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"),
        F.substring("c_mktsegment", 1, 1).alias("sex_id"),
        (F.lit(15) + (F.col("c_custkey") * 7) % 60).cast("int").alias("age"),
        F.col("n_name").alias("pref_name"),
    )


def facts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
    )


def purchases_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_view(spark, sf_dir).filter("event_type = 'purchase'").drop("event_type")


def visits_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_view(spark, sf_dir).filter("event_type in ('view', 'click')").drop("event_type")


def all_items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, nation = star_table(spark, sf_dir, "part"), star_table(spark, sf_dir, "nation")
    key = F.col("p_partkey")
    first_day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    start = ((key % 5 - 1) * 5).cast("int")
    zero = F.lit(0)
    return part.join(nation, key % 25 == F.col("n_nationkey")).select(
        key.alias("item_id"),
        F.col("p_type").alias("genre_name"),
        F.col("p_brand").alias("capsule_text"),
        F.col("p_size").cast("double").alias("price_rate"),
        F.col("p_retailprice").alias("catalog_price"),
        (F.col("p_retailprice") * (F.lit(100) - F.col("p_size")) / 100).alias("discount_price"),
        F.col("n_name").alias("pref_name"),
        (F.col("p_size") * 3).alias("valid_period"),
        (first_day + F.make_interval(days=start)).alias("disp_from"),
        F.when(key % 11 == 0, F.lit(None))
        .otherwise(first_day + F.make_interval(days=(start + 10 + key % 15).cast("int"), hours=zero))
        .alias("disp_end"),
    )


def world(spark: SparkSession, sf_dir: str) -> World:
    every = all_items_view(spark, sf_dir)
    seen = facts_view(spark, sf_dir).filter("event_type in ('purchase', 'view', 'click')").select("item_id").distinct()
    users = users_view(spark, sf_dir)
    return World(
        users=users,
        items=every.join(seen, "item_id", "left_semi"),
        target_items=every.join(seen, "item_id", "left_anti"),
        purchases=purchases_view(spark, sf_dir),
        visits=visits_view(spark, sf_dir),
        template=users.select("user_id"),
    )


def order_lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger purchase fact: one row per order line."""
    lineitem, orders = star_table(spark, sf_dir, "lineitem"), star_table(spark, sf_dir, "orders")
    return lineitem.select("l_orderkey", "l_partkey").join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
             F.col("o_orderdate").cast("timestamp").alias("ts"))
