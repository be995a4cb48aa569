"""Queries on histories: counts per user, item, genre and pair, running and weekly."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.operators import history as H
from offerlens.operators import split as S
from offerlens.operators.topk import first_n
from offerlens.plans.registry import query, tidy
from offerlens.plans.sql import context, with_views
from offerlens.sources import views as W

CUT = "(select val_start from fx_grid)"
CONTEXT = context(CUT)


def validation_context(spark, sf):
    """(world, grid, context at the start of the validation week)."""
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    return w, grid, H.cutoff_context(w.purchases, w.visits, w.all_items, grid.val_start)


NAMES = "fx_purchases fx_visits fx_items_all fx_grid"


@query("user_aggregates", with_views(NAMES, """
select user_id, user_purchases, user_visits, round(user_mean_price + 3.7e-9, 6) as user_mean_price,
  coalesce(epoch_us(user_last_purchase), -1) as user_last_purchase from c_user""", CONTEXT))
def user_aggregates(spark, sf):
    _, _, ctx = validation_context(spark, sf)
    return tidy(ctx.user.withColumn("user_mean_price", F.col("user_mean_price") + 3.7e-9)).fillna(-1, ["user_last_purchase"])


@query("user_genre_counts", with_views(NAMES, "select * from c_user_genre", CONTEXT))
def user_genre_counts(spark, sf):
    return tidy(validation_context(spark, sf)[2].user_genre)


@query("user_item_counts", with_views(NAMES, "select * from c_user_item", CONTEXT))
def user_item_counts(spark, sf):
    return tidy(validation_context(spark, sf)[2].user_item.filter("same_item_purchases > 0"))


@query("item_counts", with_views(NAMES, "select * from c_item", CONTEXT))
def item_counts(spark, sf):
    return tidy(validation_context(spark, sf)[2].item)


@query("genre_counts", with_views(NAMES, "select * from c_genre", CONTEXT))
def genre_counts(spark, sf):
    return tidy(validation_context(spark, sf)[2].genre.filter("genre_purchases > 0"))


@query("user_region_counts", with_views("fx_lines fx_items_all", """
select user_id, pref_name as item_pref_name, count(*) as user_pref_item_count from fx_lines join fx_items_all using (item_id)
where pref_name is not null group by all"""))
def user_region_counts(spark, sf):
    lines = W.order_lines_view(spark, sf)
    return tidy(H.event_history(lines, lines, W.all_items_view(spark, sf)).region)


@query("user_history", with_views("fx_lines fx_items_all", """
select user_id, count(*) as user_purchase_count, count(distinct item_id) as user_unique_item_count,
  count(distinct genre_name) as user_unique_genre_count, round(avg(discount_price) + 3.7e-9, 6) as user_avg_purchase_price,
  round(quantile_cont(discount_price, 0.5) + 3.7e-9, 6) as user_median_purchase_price, round(avg(price_rate) + 3.7e-9, 6) as user_avg_discount_rate,
  round(sum(discount_price), 4) as purchase_price_sum, round(sum(price_rate), 6) as discount_rate_sum,
  epoch_us(min(ts)) as first_purchase, epoch_us(max(ts)) as last_purchase,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 as user_active_days
from fx_lines left join fx_items_all using (item_id) group by user_id"""))
def user_history(spark, sf):
    out = H.user_history(W.order_lines_view(spark, sf), W.all_items_view(spark, sf))
    # Means of decimal prices can end exactly on a half; a tiny shift makes both engines round them alike.
    shifted = {c: F.col(c) + 3.7e-9 for c in ("user_avg_purchase_price", "user_median_purchase_price",
                                             "user_avg_discount_rate")}
    return tidy(out.withColumns(shifted).withColumn("purchase_price_sum", F.round("purchase_price_sum", 4)))


@query("view_history", with_views("fx_visits", """
select user_id, count(*) as user_view_count, count(distinct item_id) as user_unique_view_item_count from fx_visits group by user_id"""))
def view_history(spark, sf):
    return tidy(H.view_history(W.visits_view(spark, sf)))


@query("full_user_history", with_views("fx_purchases fx_visits fx_items", """
select user_id, coalesce(p, 0) as user_purchase_count, coalesce(v, 0) as user_view_count,
  coalesce(round(coalesce(v, 0) / nullif(p, 0), 6), 0) as view_to_purchase_ratio, coalesce(uv, 0) as user_unique_view_item_count
from (select user_id, count(*) as p from fx_purchases group by all) a full join
  (select user_id, count(*) as v, count(distinct item_id) as uv from fx_visits group by all) b using (user_id)"""))
def full_user_history(spark, sf):
    w = W.world(spark, sf)
    out = H.full_user_history(w.purchases, w.visits, w.items)
    return tidy(out.select("user_id", "user_purchase_count", "user_view_count", "view_to_purchase_ratio",
                           F.coalesce("user_unique_view_item_count", F.lit(0)).alias("user_unique_view_item_count")))


@query("bought_sets", with_views("fx_lines", "select distinct user_id, item_id from fx_lines"))
def bought_sets(spark, sf):
    return H.item_sets(W.order_lines_view(spark, sf))


@query("first_viewed_lists", with_views("fx_visits", """
select user_id, string_agg(item_id, '|' order by r) as items from (
  select user_id, item_id, row_number() over (partition by user_id order by seen, item_id) as r from (
    select user_id, item_id, min(ts) as seen from fx_visits group by all) v) x
group by user_id"""))
def first_viewed_lists(spark, sf):
    seen = W.visits_view(spark, sf).groupBy("user_id", "item_id").agg(F.min("ts").alias("at"))
    ranked = seen.withColumn("rank", F.struct("at", "item_id"))
    return tidy(H.item_lists(ranked, ["user_id"], "rank"))


@query("genre_popularity_rank", with_views("fx_purchases fx_items fx_targets", """
select item_id, genre_name, coalesce(n, 0) as genre_popularity, row_number() over (order by coalesce(n, 0) desc, item_id) as rank
from fx_targets left join (select genre_name, count(*) as n from fx_purchases join fx_items using (item_id) group by all) g
using (genre_name) order by rank limit 10"""))
def genre_popularity_rank(spark, sf):
    w = W.world(spark, sf)
    return tidy(H.genre_popularity_rank(w.purchases, w.items, w.target_items))


@query("popular_in_pool", with_views("fx_lines fx_items", """
select item_id, count(*) as purchases from fx_lines where item_id in (select item_id from fx_items) group by item_id
order by purchases desc, item_id limit 100"""))
def popular_in_pool(spark, sf):
    return tidy(H.popular_in_pool(W.order_lines_view(spark, sf), W.world(spark, sf).items, 100))


@query("constant_columns_per_customer", """
select 'o_orderstatus' as column_name, cast(max(n) as bigint) as max_distinct from (
  select least(count(distinct o_orderstatus) + (case when count(*) > count(o_orderstatus) then 1 else 0 end), 2) as n
  from orders group by o_custkey) x
union all select 'o_custkey', 1 union all select 'o_orderpriority', cast(max(n) as bigint) from (
  select least(count(distinct o_orderpriority), 2) as n from orders group by o_custkey) y""")
def constant_columns_per_customer(spark, sf):
    orders = W.star_table(spark, sf, "orders").withColumn("customer", F.col("o_custkey"))
    return tidy(H.constant_in_group(orders, "customer", ["o_orderstatus", "o_custkey", "o_orderpriority"]))


WEEK_CTES = """weeks as (select cast(w as bigint) as week, first_start + interval '7' day * cast(w as int) as start
  from fx_grid, range(0, 1000) r(w) where first_start + interval '7' day * cast(w as int) < val_start),
keys as (select week, start, user_id, item_id from weeks join fx_purchases on ts >= start and ts < start + interval '7' day
  group by all)"""


@query("weekly_user_snapshots", with_views("fx_purchases fx_visits fx_items fx_grid", """
select k.week, k.user_id,
  (select count(*) from fx_purchases p where p.user_id = k.user_id and p.ts < k.start) as user_purchases,
  (select count(*) from fx_visits v where v.user_id = k.user_id and v.ts < k.start) as user_visits,
  round((select avg(discount_price) from fx_purchases p join fx_items using (item_id)
    where p.user_id = k.user_id and p.ts < k.start) + 3.7e-9, 6) as user_mean_price,
  coalesce((select epoch_us(max(ts)) from fx_purchases p where p.user_id = k.user_id and p.ts < k.start), -1) as user_last_purchase
from (select distinct week, start, user_id from keys) k""", WEEK_CTES))
def weekly_user_snapshots(spark, sf):
    """Each week's history of the users buying in that week; all weeks in one job."""
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    pairs = S.weekly_labels(w.purchases, grid)
    ctx = H.weekly_context_of(pairs, w.purchases, w.visits, w.items, w.items, grid)
    user = ctx.user.withColumn("user_mean_price", F.col("user_mean_price") + 3.7e-9)
    return tidy(user.fillna(0, ["user_purchases", "user_visits"])).fillna(-1, ["user_last_purchase"])


@query("weekly_item_snapshots", with_views("fx_purchases fx_visits fx_items fx_grid", """
select k.week, k.item_id, (select count(*) from fx_purchases p where p.item_id = k.item_id and p.ts < k.start) as item_purchases,
  (select count(*) from fx_visits v where v.item_id = k.item_id and v.ts < k.start) as item_visits
from (select distinct week, start, item_id from keys) k""", WEEK_CTES))
def weekly_item_snapshots(spark, sf):
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    pairs = S.weekly_labels(w.purchases, grid)
    ctx = H.weekly_context_of(pairs, w.purchases, w.visits, w.items, w.items, grid)
    return tidy(ctx.item.fillna(0))


@query("weekly_genre_snapshots_order_lines", with_views("fx_lines fx_items_all", """
select * from (select week, genre_name, cast(coalesce(sum(n) over (partition by genre_name order by week rows between unbounded preceding
  and 1 preceding), 0) as bigint) as genre_purchases from (
  select cast(floor((epoch_us(ts) - epoch_us(first_start)) / 604800000000.0) as bigint) as week, genre_name, count(*) as n
  from fx_lines join fx_items_all using (item_id), g where ts < val_start group by all) x) y where week >= 0""",
    """g as (select first_day + interval '1' day * cast(date_diff('day', first_day, val_start) % 7 as int) as first_start, val_start
  from (select cast(date_trunc('day', min(ts)) as timestamp) as first_day,
    cast(date_trunc('day', max(ts)) as timestamp) - interval '6' day as val_start from fx_lines) b)"""))
def weekly_genre_snapshots_order_lines(spark, sf):
    """Genre popularity at the start of every week of the large fact."""
    lines, items = W.order_lines_view(spark, sf), W.all_items_view(spark, sf)
    grid = S.week_grid(lines)
    sold = S.weekly_labels(lines, grid).join(items.select("item_id", "genre_name"), "item_id")
    wanted = {n: sold for n in ("user", "user_genre", "user_item", "item", "genre")}
    return tidy(H.weekly_context(lines, lines.limit(0), items, grid, wanted).genre.fillna(0))

