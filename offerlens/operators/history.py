"""Histories: counts and aggregates per user, item, genre and their pairs, at a cut-off or at every week."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import exprs as X
from offerlens.functions.constants import TOP_K
from offerlens.operators import split as S
from offerlens.operators.numbering import middle_of_counts
from offerlens.session import materialized

def row_count() -> Column:
    return F.count(F.lit(1))


def counts(facts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows per key, null keys left out."""
    kept = facts
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(row_count().alias(name))


def item_sets(facts: DataFrame) -> DataFrame:
    """The distinct items of each user as rows; a set as rows joins and subtracts without one array per user."""
    return facts.select("user_id", "item_id").distinct()


def item_lists(ranked: DataFrame, keys: list[str], rank: str, k: int | None = None) -> DataFrame:
    """The items of each key as an ordered array, the first k where k is given."""
    kept = ranked if k is None else ranked.filter(F.col(rank) <= k)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("item_id").alias("i"))))
    return kept.groupBy(*keys).agg(F.transform(pairs, lambda p: p["i"]).alias("items"))


@dataclass(frozen=True)
class Context:
    """Aggregates of everything before a cut-off.

    Each frame is keyed by its id columns plus `scope` (nothing, a week, or a request), so that one join chain serves
    a single cut-off, many weeks at once and per-request histories.
    """

    user: DataFrame        # user_purchases, user_visits, user_mean_price, user_last_purchase
    user_genre: DataFrame  # user_genre_purchases, user_genre_visits
    user_item: DataFrame   # same_item_purchases
    item: DataFrame        # item_purchases, item_visits
    genre: DataFrame       # genre_purchases
    scope: tuple[str, ...] = ()


def pair_history(purchases: DataFrame, visits: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Purchases and visits folded to one row per user and item (and `extra` keys): the base of every other aggregate."""
    extra = extra or []
    facts = purchases.select(*extra, "user_id", "item_id", "ts", F.lit(1).alias("p"), F.lit(0).alias("v")).unionByName(
        visits.select(*extra, "user_id", "item_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(0).alias("p"),
                      F.lit(1).alias("v")))
    return facts.groupBy(*extra, "user_id", "item_id").agg(
        F.sum("p").alias("p"), F.sum("v").alias("v"), F.max("ts").alias("last_ts"))


def _roll_up(base: DataFrame, items: DataFrame, extra: list[str]) -> dict[str, DataFrame]:
    meta = items.select("item_id", "genre_name", F.col("discount_price").cast("double").alias("price"))
    rows = base.join(meta, "item_id", "left")
    priced = F.when(F.col("price").isNotNull(), F.col("p"))
    by_genre = rows.groupBy(*extra, "user_id", "genre_name").agg(
        F.sum("p").alias("p"), F.sum("v").alias("v"), F.max("last_ts").alias("last_ts"),
        F.sum(F.col("price") * F.col("p")).alias("price_sum"), F.sum(priced).alias("price_n"))
    # Three of the five frames are read off this table, each of them more than once.
    by_genre = materialized(by_genre)
    return {
        "user": by_genre.groupBy(*extra, "user_id").agg(
            F.sum("p").alias("p"), F.sum("v").alias("v"), F.max("last_ts").alias("last_ts"),
            F.sum("price_sum").alias("price_sum"), F.sum("price_n").alias("price_n")),
        "user_genre": by_genre.filter(F.col("genre_name").isNotNull()).select(
            *extra, "user_id", "genre_name", "p", "v"),
        "user_item": base.select(*extra, "user_id", "item_id", "p"),
        "item": base.groupBy(*extra, "item_id").agg(F.sum("p").alias("p"), F.sum("v").alias("v")),
        "genre": by_genre.filter(F.col("genre_name").isNotNull()).groupBy(*extra, "genre_name").agg(
            F.sum("p").alias("p")),
    }


def _named(parts: dict[str, DataFrame], scope: tuple[str, ...]) -> Context:
    s = list(scope)
    return Context(
        user=parts["user"].select(
            *s, "user_id", F.col("p").alias("user_purchases"), F.col("v").alias("user_visits"),
            X.safe_ratio(F.col("price_sum"), F.col("price_n")).alias("user_mean_price"),
            F.col("last_ts").alias("user_last_purchase")),
        user_genre=parts["user_genre"].select(
            *s, "user_id", "genre_name", F.col("p").alias("user_genre_purchases"),
            F.col("v").alias("user_genre_visits")),
        user_item=parts["user_item"].select(*s, "user_id", "item_id", F.col("p").alias("same_item_purchases")),
        item=parts["item"].select(*s, "item_id", F.col("p").alias("item_purchases"), F.col("v").alias("item_visits")),
        genre=parts["genre"].select(*s, "genre_name", F.col("p").alias("genre_purchases")),
        scope=scope,
    )


def cutoff_context(purchases: DataFrame, visits: DataFrame, items: DataFrame, cutoff_us: int) -> Context:
    """All aggregates strictly before one cut-off."""
    base = materialized(pair_history(S.history_before(purchases, cutoff_us), S.history_before(visits, cutoff_us)))
    return _named(_roll_up(base, items, []), ())


def weekly_context(purchases: DataFrame, visits: DataFrame, items: DataFrame, grid: S.WeekGrid,
                   wanted: dict[str, DataFrame], include_validation: bool = False) -> Context:
    """All aggregates at the start of every week in one job.

    Facts are folded per week once; a running total over the weeks of a key then gives each week's history.  `wanted`
    names, per frame, the (week, key) rows to answer; only those are produced, and of the two frames of pairs only keys that
    have facts at all, since nearly no pair has any.
    """
    last = grid.train_weeks + (1 if include_validation else 0)
    cut = grid.first_start + last * S.WEEK_US

    def weekly(facts: DataFrame) -> DataFrame:
        return S.history_before(facts, cut).withColumn("week", grid.week_of(F.col("ts")))

    parts = _roll_up(materialized(pair_history(weekly(purchases), weekly(visits), ["week"])), items, ["week"])
    out = {}
    for name, part in parts.items():
        keys = [c for c in ("user_id", "genre_name", "item_id") if c in part.columns]
        values = [c for c in part.columns if c not in (*keys, "week")]
        types = dict(part.dtypes)
        asked = wanted[name].select("week", *keys)
        if len(keys) > 1:
            asked = asked.join(part.select(*keys).distinct(), keys, "left_semi")
        asked = asked.distinct().select(
            "week", *keys, *[F.lit(None).cast(types[v]).alias(v) for v in values], F.lit(True).alias("_asked"))
        both = part.withColumn("_asked", F.lit(False)).unionByName(asked).groupBy("week", *keys).agg(
            *[(F.max if v == "last_ts" else F.sum)(v).alias(v) for v in values], F.max("_asked").alias("_asked"))
        before = Window.partitionBy(*keys).orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
        out[name] = both.select("week", *keys, "_asked", *[
            (F.max if v == "last_ts" else F.sum)(v).over(before).alias(v) for v in values]).filter("_asked").drop("_asked")
    return _named(out, ("week",))


def weekly_context_of(pairs: DataFrame, purchases: DataFrame, visits: DataFrame, items: DataFrame, all_items: DataFrame,
                      grid: S.WeekGrid, include_validation: bool = False) -> Context:
    """The weekly context answering exactly the keys of (week, user, item) pairs."""
    keyed = pairs.select("week", "user_id", "item_id").join(all_items.select("item_id", "genre_name"), "item_id", "left")
    wanted = {"user": keyed, "user_genre": keyed, "user_item": keyed, "item": keyed, "genre": keyed}
    return weekly_context(purchases, visits, items, grid, wanted, include_validation)


# --- the richer history of the event-time pipeline ------------------------------------------------------------------

def user_history(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: size, distinct items and genres, mean and exact median price, mean rate, sums, span, active days."""
    meta = items.select("item_id", "genre_name", F.col("discount_price").cast("double").alias("price"),
                        F.col("price_rate").cast("double").alias("rate"))
    base = purchases.groupBy("user_id", "item_id").agg(row_count().alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = base.join(meta, "item_id", "left")
    n = F.col("n")
    by_genre = rows.groupBy("user_id", "genre_name").agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("items"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(F.col("price") * n).alias("ps"), F.sum(F.when(F.col("price").isNotNull(), n)).alias("pn"),
        F.sum(F.col("rate") * n).alias("rs"), F.sum(F.when(F.col("rate").isNotNull(), n)).alias("rn"))
    users = by_genre.groupBy("user_id").agg(
        F.sum("n").alias("user_purchase_count"), F.sum("items").alias("user_unique_item_count"),
        F.count("genre_name").alias("user_unique_genre_count"),
        X.safe_ratio(F.sum("ps"), F.sum("pn")).alias("user_avg_purchase_price"),
        X.safe_ratio(F.sum("rs"), F.sum("rn")).alias("user_avg_discount_rate"),
        F.coalesce(F.sum("ps"), F.lit(0.0)).alias("purchase_price_sum"),
        F.coalesce(F.sum("rs"), F.lit(0.0)).alias("discount_rate_sum"),
        F.min("lo").alias("first_purchase"), F.max("hi").alias("last_purchase"))
    # Medians weigh each price by its purchases; the fold per (user, price) keeps a user's cost at distinct prices.
    weighted = rows.filter(F.col("price").isNotNull()).groupBy("user_id", "price").agg(F.sum("n").alias("_n"))
    median = middle_of_counts(weighted, ["user_id"], "price", "user_median_purchase_price")
    days = F.greatest(X.whole_days_between(F.col("last_purchase"), F.col("first_purchase")), F.lit(0).cast("bigint"))
    return users.join(median, "user_id", "left").withColumn("user_active_days", days)


def view_history(visits: DataFrame) -> DataFrame:
    """Per user: views and distinct viewed items."""
    base = visits.groupBy("user_id", "item_id").agg(row_count().alias("n"))
    return base.groupBy("user_id").agg(F.sum("n").alias("user_view_count"),
                                       F.count("item_id").alias("user_unique_view_item_count"))


def full_user_history(purchases: DataFrame, visits: DataFrame, items: DataFrame) -> DataFrame:
    """Purchase and view history side by side for users with either; view_to_purchase_ratio is 0 without purchases."""
    both = user_history(purchases, items).join(view_history(visits), "user_id", "full_outer")
    bought, viewed = F.coalesce("user_purchase_count", F.lit(0)), F.coalesce("user_view_count", F.lit(0))
    return both.withColumns({
        "user_purchase_count": bought, "user_view_count": viewed,
        "view_to_purchase_ratio": F.coalesce(X.safe_ratio(viewed, bought), F.lit(0.0))})


@dataclass(frozen=True)
class EventHistory:
    """The history tables of the event-time pipeline at one cut-off."""

    user: DataFrame
    genre: DataFrame
    region: DataFrame
    user_item: DataFrame
    genre_view: DataFrame


def event_history(purchases: DataFrame, visits: DataFrame, items: DataFrame) -> EventHistory:
    """Histories of facts that are already cut off before the prediction time."""
    meta = items.select("item_id", "genre_name", "pref_name")
    bought = purchases.groupBy("user_id", "item_id").agg(row_count().alias("n"))
    rows = bought.join(meta, "item_id", "left")
    viewed = visits.groupBy("user_id", "item_id").agg(row_count().alias("n")).join(meta, "item_id", "left")

    def total(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.sum("n").alias(name))

    return EventHistory(
        user=full_user_history(purchases, visits, items),
        genre=total(rows, "genre_name", "user_genre_purchase_count"),
        region=total(rows, "pref_name", "user_pref_item_count").withColumnRenamed("pref_name", "item_pref_name"),
        user_item=bought.withColumnRenamed("n", "user_item_purchase_count"),
        genre_view=total(viewed, "genre_name", "user_genre_view_count"))


def constant_in_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per column the largest number of distinct values (null counting as one) within any group; one shuffle.

    A value differs within a group exactly when its minimum and maximum differ or nulls meet values, so partial
    aggregates suffice and no group is gathered: the result is 1 for constant and 2 for varying columns.
    """
    varies = [
        F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), 2).otherwise(1).alias(c)
        for c in columns]
    worst = df.groupBy(group).agg(*varies).agg(*[F.max(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("max_distinct")) for c in columns])
    return worst.select(F.inline(cells))


def genre_popularity_rank(purchases: DataFrame, items: DataFrame, targets: DataFrame, k: int = TOP_K) -> DataFrame:
    """Target items by the purchases of their genre, first k: the list for users without an own ranking."""
    bought = counts(purchases, ["item_id"], "n").join(items.select("item_id", "genre_name"), "item_id")
    genre = bought.filter(F.col("genre_name").isNotNull()).groupBy("genre_name").agg(F.sum("n").alias("_n"))
    ranked = targets.join(genre, "genre_name", "left").select(
        "item_id", "genre_name", F.coalesce("_n", F.lit(0)).cast("bigint").alias("genre_popularity"))
    first = ranked.orderBy(F.desc("genre_popularity"), "item_id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("genre_popularity"), "item_id")))


def popular_in_pool(purchases: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """The n most bought items that belong to the pool."""
    return counts(purchases, ["item_id"], "purchases").join(pool.select("item_id"), "item_id", "left_semi").orderBy(
        F.desc("purchases"), "item_id").limit(n)
