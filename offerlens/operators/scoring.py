"""Scores that need no training, and the ranked lists built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import exprs as X
from offerlens.functions.constants import (
    POPULARITY_GENRE_WEIGHT, PREFERENCE_GENRE_VIEW_WEIGHT, PREFERENCE_REGION_WEIGHT, RULE_WEIGHTS, TOP_K)
from offerlens.operators.candidates import pool_pairs, shortlist
from offerlens.operators.features import pair_features
from offerlens.operators.history import Context
from offerlens.operators.topk import global_top, top_k
from offerlens.session import spread



def rule_score() -> Column:
    """Weighted sum of the pair features."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(name) for name, w in RULE_WEIGHTS.items()])


def popularity_score() -> Column:
    return F.col("log_item_purchases") + F.lit(POPULARITY_GENRE_WEIGHT) * F.col("log_genre_purchases")


def global_popularity_score(purchases: str = "item_purchases") -> Column:
    return X.log1p_or_zero(F.col(purchases))


def preference_score() -> Column:
    return (X.log1p_or_zero(F.col("user_genre_purchase_count"))
            + F.lit(PREFERENCE_GENRE_VIEW_WEIGHT) * X.log1p_or_zero(F.col("user_genre_view_count"))
            + F.lit(PREFERENCE_REGION_WEIGHT) * F.col("same_region").cast("double"))


def item_base(items: DataFrame, ctx: Context) -> DataFrame:
    """What the rule score owes to the item alone, and its log price."""
    w = RULE_WEIGHTS
    rows = items.join(ctx.item, "item_id", "left").join(ctx.genre, "genre_name", "left")
    price = X.at_least_zero(F.coalesce(F.col("discount_price").cast("double"), F.lit(0.0)))
    base = (F.lit(w["log_genre_purchases"]) * X.log1p_or_zero(F.col("genre_purchases"))
            + F.lit(w["log_item_purchases"]) * X.log1p_or_zero(F.col("item_purchases"))
            + F.lit(w["log_item_visits"]) * X.log1p_or_zero(F.col("item_visits"))
            + F.lit(w["price_rate"]) * F.coalesce(F.col("price_rate").cast("double"), F.lit(0.0)))
    return rows.select("item_id", "genre_name", "pref_name", base.alias("base"), F.log1p(price).alias("log_price"))


def rules_shortlist(users: DataFrame, pool: DataFrame, ctx: Context, k: int = TOP_K,
                    owner: list[str] | None = None) -> DataFrame:
    """Pairs certain to hold every owner's k best pool items by the rule score."""
    owner = owner or ["user_id"]
    people = users.join(ctx.user, owner, "left").select(
        *owner, "pref_name", X.log1p_or_zero(F.col("user_mean_price")).alias("log_price"))
    w = RULE_WEIGHTS
    bonus = (F.lit(w["log_user_genre_purchases"]) * X.log1p_or_zero(F.col("user_genre_purchases"))
             + F.lit(w["log_user_genre_visits"]) * X.log1p_or_zero(F.col("user_genre_visits")))
    known = ctx.user_genre.filter("user_genre_purchases > 0 or user_genre_visits > 0").select(*owner, "genre_name", bonus.alias("bonus"))
    return shortlist(people, known, item_base(pool, ctx), owner, k, -w["price_distance"], w["pref_match"])


def rules_top(users: DataFrame, pool: DataFrame, ctx: Context, cutoff_us: int, k: int = TOP_K,
              digits: int | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Each user's k best pool items by the rule score; ties go to the smaller id."""
    pairs = rules_shortlist(users, pool, ctx, k)
    scored = pair_features(pairs.withColumn("cutoff", X.ts_lit(cutoff_us)), users, pool, ctx, codes)
    score = rule_score() if digits is None else F.round(rule_score(), digits)
    return top_k(scored.select("user_id", "item_id", score.alias("score")), ["user_id"], F.col("score"), k,
                 [F.col("item_id")])


def item_popularity(pool: DataFrame, ctx: Context) -> DataFrame:
    """Pool items with the popularity score."""
    rows = pool.join(ctx.item, "item_id", "left").join(ctx.genre, "genre_name", "left").select(
        "item_id", X.log1p_or_zero(F.col("item_purchases")).alias("log_item_purchases"),
        X.log1p_or_zero(F.col("genre_purchases")).alias("log_genre_purchases"))
    return rows.select("item_id", popularity_score().alias("score"))


def give_to_all(users: DataFrame, ranked: DataFrame) -> DataFrame:
    """A short common list (at most k rows) handed to every user.

    The list is one array value, so users are read once; only their ids move, so that many tasks share the k rows of each.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "item_id", "score")))
    return spread(users.select("user_id"), "user_id").select("user_id", F.inline(ranked.agg(rows.alias("l")).scalar())).select(
        "user_id", "item_id", "score", "rank")


def popularity_top(users: DataFrame, pool: DataFrame, ctx: Context, k: int = TOP_K,
                   digits: int | None = None) -> DataFrame:
    """Each user's k most popular pool items.  The score ignores the user, so the list is computed once."""
    scored = item_popularity(pool, ctx)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return give_to_all(users, global_top(scored, [F.desc("score"), F.col("item_id")], k))


def preference_top(users: DataFrame, pool: DataFrame, genre: DataFrame, genre_view: DataFrame, k: int = TOP_K,
                   digits: int | None = None) -> DataFrame:
    """Each user's k best pool items by the preference baseline, through an exact shortlist."""
    likes = genre.join(genre_view, ["user_id", "genre_name"], "full_outer")
    bonus = (X.log1p_or_zero(F.col("user_genre_purchase_count"))
             + F.lit(PREFERENCE_GENRE_VIEW_WEIGHT) * X.log1p_or_zero(F.col("user_genre_view_count")))
    known = likes.select("user_id", "genre_name", bonus.alias("bonus"))
    items = pool.select("item_id", "genre_name", "pref_name", F.lit(0.0).alias("base"), F.lit(0.0).alias("log_price"))
    people = users.select("user_id", "pref_name", F.lit(0.0).alias("log_price"))
    pairs = shortlist(people, known, items, ["user_id"], k, region_bonus=PREFERENCE_REGION_WEIGHT)
    rows = (pairs.join(pool.select("item_id", "genre_name", F.col("pref_name").alias("item_pref_name")), "item_id")
            .join(users.select("user_id", F.col("pref_name").alias("user_pref_name")), "user_id")
            .join(genre, ["user_id", "genre_name"], "left").join(genre_view, ["user_id", "genre_name"], "left")
            .withColumn("same_region", X.same_region(F.col("user_pref_name"), F.col("item_pref_name"))))
    score = preference_score() if digits is None else F.round(preference_score(), digits)
    return top_k(rows.select("user_id", "item_id", score.alias("score")), ["user_id"], F.col("score"), k,
                 [F.col("item_id")])


def score_all(users: DataFrame, pool: DataFrame, ctx: Context, cutoff_us: int, k: int = TOP_K,
              digits: int | None = None) -> DataFrame:
    """(method, user, item, score, rank) for the untrained methods."""
    rules = rules_top(users, pool, ctx, cutoff_us, k, digits).withColumn("method", F.lit("rules"))
    popular = popularity_top(users, pool, ctx, k, digits).withColumn("method", F.lit("popularity"))
    return rules.unionByName(popular)


def rank_scored(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top k per method and user of rows (method, user_id, item_id, score)."""
    return top_k(scored, ["method", "user_id"], F.col("score"), k, [F.col("item_id")])
