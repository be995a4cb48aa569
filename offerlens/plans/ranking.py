"""Queries on candidates, features, scores and ranked lists of the weekly model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from offerlens.functions.constants import PAIR_FEATURES
from offerlens.operators import candidates as CA
from offerlens.operators import encode as E
from offerlens.operators import features as FE
from offerlens.operators import history as H
from offerlens.operators import metrics as V
from offerlens.operators import sampling as N
from offerlens.operators import scoring as SC
from offerlens.operators import split as S
from offerlens.operators import topk as TK
from offerlens.plans.histories import CONTEXT, CUT, validation_context
from offerlens.plans.registry import query, tidy
from offerlens.plans.sql import (
    POPULARITY_SQL, RULE_SQL, codes, context, draw, feature_list, pair_features, stratum, with_views)
from offerlens.session import materialized
from offerlens.sources import sinks
from offerlens.sources import views as W

NAMES = "fx_users fx_purchases fx_visits fx_items fx_targets fx_items_all fx_grid"
DIGITS = 6

POOL_SQL = "pool as (select i.* from fx_items i, fx_grid where disp_from < val_start + interval '7' day and disp_end >= val_start)"
TRUTH_SQL = "truth as (select distinct user_id, item_id from fx_purchases, fx_grid where ts >= val_start and ts < final_cutoff)"
PAIRS_SQL = "pairs as (select user_id, item_id from fx_users, pool)"


def ranked_sql(score: str, name: str = "ranked", source: str = "feats") -> str:
    return f"""{name} as (select user_id, item_id, score, cast(rank as bigint) as rank from (
  select user_id, item_id, score, row_number() over (partition by user_id order by score desc, item_id) as rank from (
    select user_id, item_id, round({score}, 6) + 0.0 as score from {source}) a) b where rank <= 10)"""


FEATS_SQL = ",".join([POOL_SQL, PAIRS_SQL, CONTEXT, pair_features("pairs", CUT, coded=False)])
RULES_SQL = ",".join([FEATS_SQL, ranked_sql(RULE_SQL)])
POPULAR_SQL = ",".join([FEATS_SQL, ranked_sql(POPULARITY_SQL)])
MAP_ALL_SQL = """select round(coalesce(sum(ap), 0) / (select count(*) from fx_users), 6) as map_at_k from (
  select user_id, sum(hits / rank) / least(any_value(n), 10) as ap from (
    select r.user_id, r.rank, row_number() over (partition by r.user_id order by r.rank) as hits, s.n
    from ranked r join truth t on t.user_id = r.user_id and t.item_id = r.item_id
    join (select user_id, count(*) as n from truth group by user_id) s on s.user_id = r.user_id) h group by user_id) x"""


def validation_setup(spark, sf):
    w, grid, ctx = validation_context(spark, sf)
    return w, grid, ctx, S.candidates_in_window(w.items, grid.val_start)


def validation_truth(w, grid):
    return S.labels_in_window(w.purchases, grid.val_start)


@query("rules_top10", with_views(NAMES, "select user_id, item_id, score, rank from ranked", RULES_SQL))
def rules_top10(spark, sf):
    """Ten best validation-week offers of every user by the rule score."""
    w, grid, ctx, pool = validation_setup(spark, sf)
    return tidy(SC.rules_top(w.users, pool, ctx, grid.val_start, digits=DIGITS))


@query("rules_map10", with_views(NAMES, MAP_ALL_SQL, ",".join([RULES_SQL, TRUTH_SQL])))
def rules_map10(spark, sf):
    w, grid, ctx, pool = validation_setup(spark, sf)
    ranked = SC.rules_top(w.users, pool, ctx, grid.val_start, digits=DIGITS)
    return tidy(V.map_at_k_all_users(w.users, validation_truth(w, grid), ranked))


@query("popularity_top10", with_views(NAMES, "select user_id, item_id, score, rank from ranked", POPULAR_SQL))
def popularity_top10(spark, sf):
    w, _, ctx, pool = validation_setup(spark, sf)
    return tidy(SC.popularity_top(w.users, pool, ctx, digits=DIGITS))


@query("popularity_map10", with_views(NAMES, MAP_ALL_SQL, ",".join([POPULAR_SQL, TRUTH_SQL])))
def popularity_map10(spark, sf):
    w, grid, ctx, pool = validation_setup(spark, sf)
    ranked = SC.popularity_top(w.users, pool, ctx, digits=DIGITS)
    return tidy(V.map_at_k_all_users(w.users, validation_truth(w, grid), ranked))


FINAL_CONTEXT = context("(select final_cutoff from fx_grid)")
FINAL_SQL = ",".join(["pairs as (select user_id, item_id from fx_users, (select item_id from fx_targets) t)", FINAL_CONTEXT,
                      pair_features("pairs", "(select final_cutoff from fx_grid)", coded=False), ranked_sql(RULE_SQL)])


def final_rules(spark, sf):
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    ctx = H.cutoff_context(w.purchases, w.visits, w.all_items, grid.final_cutoff)
    return w, SC.rules_top(w.users, w.target_items, ctx, grid.final_cutoff, digits=DIGITS)


@query("rules_top10_targets", with_views(NAMES, "select user_id, item_id, score, rank from ranked", FINAL_SQL))
def rules_top10_targets(spark, sf):
    """The final ranking: every user's ten best of all target items, through the exact shortlist."""
    return tidy(final_rules(spark, sf)[1])


@query("submission_rules", with_views(NAMES, """select u.user_id, coalesce(l, '') as purchased_items from fx_users u left join (
  select user_id, string_agg(item_id, ' ' order by rank) as l from ranked group by user_id) r using (user_id)""", FINAL_SQL))
def submission_rules(spark, sf):
    w, ranked = final_rules(spark, sf)
    return sinks.submission(w.template, ranked)


@query("score_all_methods", with_views(NAMES, """select 'rules' as method, user_id, item_id, score, rank from ranked
  union all select 'popularity', user_id, item_id, score, rank from popular""",
    ",".join([FEATS_SQL, ranked_sql(RULE_SQL), ranked_sql(POPULARITY_SQL, "popular")])))
def score_all_methods(spark, sf):
    w, grid, ctx, pool = validation_setup(spark, sf)
    return tidy(SC.score_all(w.users, pool, ctx, grid.val_start, digits=DIGITS))


@query("shortlist_keeps_the_best", with_views(NAMES, "select user_id, item_id from ranked", RULES_SQL))
def shortlist_keeps_the_best(spark, sf):
    """Ten best pairs by score among those of the shortlist; the SQL looks at every user and item of the pool."""
    w, grid, ctx, pool = validation_setup(spark, sf)
    pairs = SC.rules_shortlist(w.users, pool, ctx).withColumn("cutoff", FE.X.ts_lit(grid.val_start))
    scored = FE.pair_features(pairs, w.users, pool, ctx).withColumn("score", F.round(SC.rule_score(), DIGITS))
    return TK.top_k(scored.select("user_id", "item_id", "score"), ["user_id"], F.col("score"), 10,
                    [F.col("item_id")]).select("user_id", "item_id")


@query("user_item_product", with_views(NAMES, "select user_id, item_id from pairs", ",".join([POOL_SQL, PAIRS_SQL])))
def user_item_product(spark, sf):
    w = W.world(spark, sf)
    pool = S.candidates_in_window(w.items, S.week_grid(w.purchases).val_start)
    return CA.pool_pairs(w.users.select("user_id"), pool.select("item_id")).select("user_id", "item_id")


@query("item_codes", with_views("fx_users fx_items_all", "select kind, value, code from codes", codes()))
def item_codes(spark, sf):
    return tidy(E.entity_codes(W.users_view(spark, sf), W.all_items_view(spark, sf)))


@query("coded_items", with_views("fx_users fx_items_all", """
select item_id, coalesce(g.code, 0) as genre_code, coalesce(c.code, 0) as capsule_code from fx_items_all i
left join codes g on g.kind = 'genre' and g.value = i.genre_name
left join codes c on c.kind = 'capsule' and c.value = i.capsule_text""", codes()))
def coded_items(spark, sf):
    items = W.all_items_view(spark, sf)
    table = E.entity_codes(W.users_view(spark, sf), items)
    return tidy(E.apply_codes(items, table, {"genre_code": ("genre_name", "genre"), "capsule_code": ("capsule_text", "capsule")})
                .select("item_id", "genre_code", "capsule_code"))


@query("pair_features", with_views(NAMES, f"select user_id, item_id, {feature_list(PAIR_FEATURES)} from feats", ",".join([
    TRUTH_SQL, CONTEXT, codes(), pair_features("truth", CUT)])))
def pair_features_query(spark, sf):
    """All 21 columns of the pairs bought in the validation week."""
    w, grid, ctx = validation_context(spark, sf)
    pairs = validation_truth(w, grid).withColumn("cutoff", FE.X.ts_lit(grid.val_start))
    out = FE.pair_features(pairs, w.users, w.all_items, ctx, E.entity_codes(w.users, w.all_items))
    codes_ = [c for c in PAIR_FEATURES if c.endswith("_code")]
    return tidy(out.withColumns({c: F.col(c).cast("int") for c in codes_}))


def weekly_pairs_sql() -> str:
    d1, d2 = draw(["user_id", "week", "j"], 42), draw(["user_id", "week", "j"], 43)
    return f"""
weeks as (select cast(w as bigint) as week, first_start + interval '7' day * cast(w as int) as start
  from fx_grid, range(0, 1000) r(w) where first_start + interval '7' day * cast(w as int) < val_start),
wpool as (select week, item_id, row_number() over (partition by week order by item_id) - 1 as pos,
  count(*) over (partition by week) as n from weeks join fx_items on disp_from < start + interval '7' day and disp_end >= start),
wpos as (select distinct week, user_id, item_id from weeks join fx_purchases on ts >= start and ts < start + interval '7' day
  where user_id in (select user_id from fx_users) and (week, item_id) in (select (week, item_id) from wpool)),
wdraw as (select week, user_id, {stratum('j', 'least(16, n)', 'n', d1)} as pos, {d2} as o
  from fx_users, (select distinct week, n from wpool) s, range(0, 16) r(j) where j < least(16, n)),
wneg as (select week, user_id, item_id from (
  select d.week, d.user_id, p.item_id, row_number() over (partition by d.week, d.user_id order by o, p.item_id) as rn
  from wdraw d join wpool p on p.week = d.week and p.pos = d.pos
  where not exists (select 1 from wpos w where w.week = d.week and w.user_id = d.user_id and w.item_id = p.item_id)) x
  where rn <= 8),
wpairs as (select week, user_id, item_id, cast(1 as bigint) as label from wpos union all
  select week, user_id, item_id, cast(0 as bigint) from wneg)"""


@query("weekly_training_pairs", with_views(NAMES, "select week, user_id, item_id, label from wpairs", weekly_pairs_sql()))
def weekly_training_pairs(spark, sf):
    """Positives and eight random negatives per user and week, for all training weeks."""
    w = W.world(spark, sf)
    return tidy(N.weekly_pairs(w.users, w.purchases, w.items, S.week_grid(w.purchases)))


@query("retrieval_coverage", with_views(NAMES, """
select round(avg(case when item_id in (select item_id from pool) then 1.0 else 0.0 end), 6) as coverage from truth""",
    ",".join([POOL_SQL, TRUTH_SQL])))
def retrieval_coverage(spark, sf):
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    return tidy(V.candidate_coverage(validation_truth(w, grid), S.candidates_in_window(w.items, grid.val_start)))


@query("known_candidate_share", with_views(NAMES, """
select count(*) as candidates, count(*) filter (k) as known, round(avg(case when k then 1.0 else 0.0 end), 6) as known_share from (
  select item_id in (select item_id from fx_purchases, fx_grid where ts < val_start) as k from pool) x""", POOL_SQL))
def known_candidate_share(spark, sf):
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    return tidy(V.known_item_share(S.candidates_in_window(w.items, grid.val_start),
                                   S.history_before(w.purchases, grid.val_start)))


def weekly_frame(spark, sf, include_validation: bool = False):
    """The labelled weekly training frame with all features, every week against its own history."""
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    pairs = materialized(N.weekly_pairs(w.users, w.purchases, w.items, grid, include_validation=include_validation))
    # What is looked up by item is written first: where it is small, the pairs need no shuffle for it.
    items = materialized(w.all_items.join(pairs.select("item_id").distinct(), "item_id", "left_semi"))
    ctx = H.weekly_context_of(pairs, w.purchases, w.visits, w.all_items, items, grid, include_validation)
    ctx = replace(ctx, item=materialized(ctx.item), genre=materialized(ctx.genre))
    table = materialized(E.entity_codes(w.users, w.all_items))
    frame = FE.pair_features(pairs.withColumn("cutoff", grid.start_of(F.col("week"))), w.users, items, ctx, table)
    return w, grid, frame, table


WEEKLY_FRAME_SQL = f"""
f as (select p.week, p.user_id, p.item_id, p.label, w.start, u.age, u.pref_name as up, i.* exclude (item_id)
  from wpairs p join weeks w on w.week = p.week left join fx_users u on u.user_id = p.user_id
  left join fx_items_all i on i.item_id = p.item_id),
buys as (select p.*, i.genre_name, i.discount_price from fx_purchases p left join fx_items_all i using (item_id)),
looks as (select v.*, i.genre_name from fx_visits v left join fx_items_all i using (item_id)),
wu as (select w.week, user_id, count(*) as n, avg(discount_price) as m, max(ts) as last_ts from weeks w join buys on ts < start
  group by all),
wv as (select w.week, user_id, count(*) as n from weeks w join looks on ts < start group by all),
wug as (select w.week, user_id, genre_name, count(*) as n from weeks w join buys on ts < start group by all),
wvg as (select w.week, user_id, genre_name, count(*) as n from weeks w join looks on ts < start group by all),
wi as (select w.week, item_id, count(*) as n from weeks w join buys on ts < start group by all),
wvi as (select w.week, item_id, count(*) as n from weeks w join looks on ts < start group by all),
wg as (select w.week, genre_name, count(*) as n from weeks w join buys on ts < start group by all),
wui as (select w.week, user_id, item_id, count(*) as n from weeks w join buys on ts < start group by all)"""


@query("weekly_training_frame", with_views(NAMES, """
select f.week, f.user_id, f.item_id, f.label, cast(f.age as double) as age, case when up = f.pref_name then 1.0 else 0.0 end as pref_match,
  round(abs(ln(1 + discount_price) - ln(1 + coalesce(wu.m, 0))) + 3.7e-9, 6) as price_distance,
  round(ln(1 + coalesce(wu.n, 0)), 6) as log_user_purchases, round(ln(1 + coalesce(wv.n, 0)), 6) as log_user_visits,
  round(coalesce((epoch_us(f.start) - epoch_us(wu.last_ts)) / 86400000000.0, 365), 6) as days_since_purchase,
  round(ln(1 + coalesce(wug.n, 0)), 6) as log_user_genre_purchases, round(ln(1 + coalesce(wvg.n, 0)), 6) as log_user_genre_visits,
  round(ln(1 + coalesce(wi.n, 0)), 6) as log_item_purchases, round(ln(1 + coalesce(wvi.n, 0)), 6) as log_item_visits,
  round(ln(1 + coalesce(wg.n, 0)), 6) as log_genre_purchases, round(ln(1 + coalesce(wui.n, 0)), 6) as log_same_item_purchases
from f left join wu using (week, user_id) left join wv using (week, user_id) left join wug using (week, user_id, genre_name)
left join wvg using (week, user_id, genre_name) left join wi using (week, item_id) left join wvi using (week, item_id)
left join wg using (week, genre_name) left join wui using (week, user_id, item_id)""",
    ",".join([weekly_pairs_sql(), WEEKLY_FRAME_SQL])))
def weekly_training_frame(spark, sf):
    frame = weekly_frame(spark, sf)[2]
    shown = frame.select(
        "week", "user_id", "item_id", "label", "age", "pref_match", (F.col("price_distance") + 3.7e-9).alias("price_distance"),
        "log_user_purchases", "log_user_visits", "days_since_purchase", "log_user_genre_purchases", "log_user_genre_visits",
        "log_item_purchases", "log_item_visits", "log_genre_purchases", "log_same_item_purchases")
    return tidy(shown)


@query("weekly_sample_size", with_views(NAMES, """
select count(*) filter (label = 1) as train_positive_rows, count(*) filter (label = 0) as train_negative_rows from wpairs""",
    weekly_pairs_sql()))
def weekly_sample_size(spark, sf):
    w = W.world(spark, sf)
    pairs = N.weekly_pairs(w.users, w.purchases, w.items, S.week_grid(w.purchases))
    return pairs.agg(F.count(F.when(F.col("label") == 1, 1)).alias("train_positive_rows"),
                     F.count(F.when(F.col("label") == 0, 1)).alias("train_negative_rows"))


REPORT_SQL = f"""
rules as (select user_id, item_id, rank from ranked), pop as (select user_id, item_id, rank from popular),
hits as (select method, r.user_id, rank, row_number() over (partition by method, r.user_id order by rank) as h, n from (
    select 'rules' as method, * from rules union all select 'popularity', * from pop) r
  join truth t on t.user_id = r.user_id and t.item_id = r.item_id
  join (select user_id, count(*) as n from truth group by user_id) s on s.user_id = r.user_id),
maps as (select method, sum(ap) / (select count(*) from fx_users) as m from (
  select method, user_id, sum(h / rank) / least(any_value(n), 10) as ap from hits group by all) x group by method)"""


@query("validation_report", with_views(NAMES, """
select strftime(first_start, '%Y-%m-%d') as first_train_week, strftime(val_start - interval '7' day, '%Y-%m-%d') as last_train_week,
  cast(date_diff('day', first_start, val_start) // 7 as bigint) as train_weeks,
  cast(date_diff('day', first_start, val_start) // 7 + 1 as bigint) as final_train_weeks,
  strftime(val_start, '%Y-%m-%d') as validation_start, (select count(*) from fx_users) as validation_users,
  (select count(*) from pool) as validation_candidates, (select count(*) from truth) as validation_truth_rows,
  (select round(avg(case when item_id in (select item_id from pool) then 1.0 else 0.0 end), 6) from truth) as candidate_truth_coverage,
  (select round(avg(case when item_id in (select item_id from fx_purchases, fx_grid where ts < val_start) then 1.0 else 0.0 end), 6)
   from pool) as known_candidate_share,
  round((select m from maps where method = 'rules'), 6) as map_rules,
  round((select m from maps where method = 'popularity'), 6) as map_popularity,
  (select count(*) filter (label = 1) from wpairs) as train_positive_rows,
  (select count(*) filter (label = 0) from wpairs) as train_negative_rows, (select count(*) from fx_targets) as target_items
from fx_grid""", ",".join([FEATS_SQL, ranked_sql(RULE_SQL), ranked_sql(POPULARITY_SQL, "popular"), TRUTH_SQL,
                           weekly_pairs_sql(), REPORT_SQL])))
def validation_report(spark, sf):
    """The one-row report of a weekly run (untrained methods)."""
    w, grid, ctx, pool = validation_setup(spark, sf)
    truth = validation_truth(w, grid)
    scores = V.map_at_k_all_users(w.users, truth, SC.score_all(w.users, pool, ctx, grid.val_start, digits=DIGITS), by=["method"])
    by_method = scores.agg(F.max(F.when(F.col("method") == "rules", F.col("map_at_k"))).alias("map_rules"),
                           F.max(F.when(F.col("method") == "popularity", F.col("map_at_k"))).alias("map_popularity"))
    pairs = N.weekly_pairs(w.users, w.purchases, w.items, grid)
    sample = pairs.agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"))

    def day(us: int):
        return F.date_format(FE.X.ts_lit(us), "yyyy-MM-dd")

    def size(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return tidy(by_method.select(
        day(grid.first_start).alias("first_train_week"), day(grid.train_starts[-1]).alias("last_train_week"),
        F.lit(grid.train_weeks).alias("train_weeks"), F.lit(grid.train_weeks + 1).alias("final_train_weeks"),
        day(grid.val_start).alias("validation_start"), size(w.users).alias("validation_users"),
        size(pool).alias("validation_candidates"), size(truth).alias("validation_truth_rows"),
        V.candidate_coverage(truth, pool).scalar().alias("candidate_truth_coverage"),
        V.known_item_share(pool, S.history_before(w.purchases, grid.val_start)).select("known_share").scalar()
        .alias("known_candidate_share"),
        "map_rules", "map_popularity", sample.select("p").scalar().alias("train_positive_rows"),
        sample.select("n").scalar().alias("train_negative_rows"), size(w.target_items).alias("target_items")))
