"""Queries on time: history cuts, the weekly grid, candidate windows, splits and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions.constants import DAY_US
from offerlens.operators import asof as A
from offerlens.operators import audit as Q
from offerlens.operators import clean as C
from offerlens.operators import features as FE
from offerlens.operators import profile as P
from offerlens.operators import split as S
from offerlens.plans.registry import query, tidy
from offerlens.plans.sql import with_views
from offerlens.sources import views as W


def events_with_id(spark, sf):
    """Purchase events with their surrogate id."""
    return C.assign_event_id(W.purchases_view(spark, sf), "event_id")


@query("history_before_validation", with_views("fx_purchases fx_grid", """
select event_id, user_id, item_id, epoch_us(ts) as ts from fx_purchases, fx_grid where ts < val_start"""))
def history_before_validation(spark, sf):
    p = W.purchases_view(spark, sf)
    return tidy(S.history_before(p, S.week_grid(p).val_start))


@query("visits_through_last_purchase", with_views("fx_purchases fx_visits", """
select event_id, user_id, item_id, epoch_us(ts) as ts from fx_visits where ts <= (select max(ts) from fx_purchases)"""))
def visits_through_last_purchase(spark, sf):
    return tidy(S.history_through(W.visits_view(spark, sf), W.purchases_view(spark, sf)))


@query("purchase_time_bounds", with_views("fx_lines", """
select epoch_us(min(ts)) as first_ts, epoch_us(max(ts)) as last_ts from fx_lines"""))
def purchase_time_bounds(spark, sf):
    return tidy(S.global_bounds(W.order_lines_view(spark, sf)))


@query("weekly_grid", with_views("fx_grid", """
select cast(w as bigint) as week, epoch_us(first_start + interval '7' day * cast(w as int)) as week_start,
  case when first_start + interval '7' day * cast(w as int) < val_start then 'train' else 'validation' end as role
from fx_grid, range(0, 1000) r(w) where first_start + interval '7' day * cast(w as int) <= val_start"""))
def weekly_grid(spark, sf):
    return tidy(S.weekly_grid(W.purchases_view(spark, sf)))


@query("weekly_grid_order_lines", with_views("fx_lines", """
select cast(w as bigint) as week, epoch_us(first_start + interval '7' day * cast(w as int)) as week_start,
  case when first_start + interval '7' day * cast(w as int) < val_start then 'train' else 'validation' end as role
from g, range(0, 1000) r(w) where first_start + interval '7' day * cast(w as int) <= val_start""",
    """g as (select first_day + interval '1' day * cast(date_diff('day', first_day, val_start) % 7 as int) as first_start, val_start
  from (select cast(date_trunc('day', min(ts)) as timestamp) as first_day,
    cast(date_trunc('day', max(ts)) as timestamp) - interval '6' day as val_start from fx_lines) b)"""))
def weekly_grid_order_lines(spark, sf):
    return tidy(S.weekly_grid(W.order_lines_view(spark, sf)))


@query("validation_candidates", with_views("fx_items fx_grid", """
select item_id from fx_items, fx_grid where disp_from < val_start + interval '7' day and disp_end >= val_start"""))
def validation_candidates(spark, sf):
    w = W.world(spark, sf)
    return S.candidates_in_window(w.items, S.week_grid(w.purchases).val_start).select("item_id")


WEEKS_SQL = """weeks as (select cast(w as bigint) as week, first_start + interval '7' day * cast(w as int) as start
  from fx_grid, range(0, 1000) r(w) where first_start + interval '7' day * cast(w as int) < val_start)"""


@query("weekly_candidates", with_views("fx_items fx_grid", """
select week, item_id from weeks join fx_items on disp_from < start + interval '7' day and disp_end >= start""", WEEKS_SQL))
def weekly_candidates(spark, sf):
    w = W.world(spark, sf)
    return S.weekly_candidates(w.items, S.week_grid(w.purchases))


@query("active_holdout_items", with_views("fx_items fx_bounds", """
select item_id from fx_items, fx_bounds where (disp_from is null or disp_from <= last_ts)
  and (disp_end is null or disp_end >= holdout_start)"""))
def active_holdout_items(spark, sf):
    w = W.world(spark, sf)
    b = S.split_bounds(w.purchases)
    return S.active_items(w.items, b.holdout_start, b.last).select("item_id")


@query("holdout_pool_with_truth", with_views("fx_items fx_bounds fx_split", """
select item_id from fx_items, fx_bounds where ((disp_from is null or disp_from <= last_ts)
  and (disp_end is null or disp_end >= holdout_start)) or item_id in (select item_id from fx_split where split = 'holdout')"""))
def holdout_pool_with_truth(spark, sf):
    w = W.world(spark, sf)
    b = S.split_bounds(w.purchases)
    truth = S.tag_split(w.purchases, b).filter("split = 'holdout'")
    return S.pool_with_truth(w.items, truth, b.holdout_start, b.last).select("item_id")


@query("training_pool", with_views("fx_items fx_bounds", """
select item_id from fx_items, fx_bounds where disp_from is null or disp_from < tuning_start"""))
def training_pool(spark, sf):
    w = W.world(spark, sf)
    return S.training_pool(w.items, S.split_bounds(w.purchases).tuning_start).select("item_id")


@query("three_way_split", with_views("fx_split", "select event_id, cast(positive_event_id as bigint) as positive_event_id, split from fx_split"))
def three_way_split(spark, sf):
    tagged, _ = S.temporal_three_way_split(events_with_id(spark, sf))
    return tagged.select("event_id", "positive_event_id", "split")


LINES_SPLIT_SQL = """b as (select max(case when rn = t then ts end) as t0, max(case when rn = h then ts end) as h0 from (
    select ts, row_number() over (order by ts) - 1 as rn, cast(floor(count(*) over () * 0.8) as bigint) as t,
      cast(floor(count(*) over () * 0.9) as bigint) as h from fx_lines) p)"""


@query("split_summary_order_lines", with_views("fx_lines", """
select case when ts < t0 then 'train' when ts < h0 then 'early_stop' else 'holdout' end as split,
  epoch_us(min(ts)) as start_ts, epoch_us(max(ts)) as end_ts, count(distinct user_id) as users, count(*) as positive_events,
  count(distinct (user_id, item_id)) as unique_positive_pairs from fx_lines, b group by 1""", LINES_SPLIT_SQL))
def split_summary_order_lines(spark, sf):
    lines = W.order_lines_view(spark, sf)
    return tidy(P.split_summary(S.tag_split(lines, S.split_bounds(lines))))


@query("validation_labels", with_views("fx_purchases fx_grid", """
select distinct user_id, item_id from fx_purchases, fx_grid where ts >= val_start and ts < val_start + interval '7' day"""))
def validation_labels(spark, sf):
    p = W.purchases_view(spark, sf)
    return S.labels_in_window(p, S.week_grid(p).val_start)


@query("purchases_while_displayed", with_views("fx_purchases fx_items", """
select event_id, user_id, item_id, epoch_us(ts) as ts from fx_purchases join fx_items using (item_id)
where (disp_from is null or disp_from <= ts) and (disp_end is null or disp_end >= ts)"""))
def purchases_while_displayed(spark, sf):
    w = W.world(spark, sf)
    return tidy(S.available_events(w.purchases, w.items).select("event_id", "user_id", "item_id", "ts"))


@query("first_users", with_views("fx_users", "select user_id from fx_users order by user_id limit 10"))
def first_users(spark, sf):
    return S.limit_users(W.users_view(spark, sf), 10).select("user_id")


@query("purchases_of_known_region_users", with_views("fx_purchases fx_users", """
select event_id, user_id from fx_purchases where user_id in (select user_id from fx_users where pref_name is not null)"""))
def purchases_of_known_region_users(spark, sf):
    users = W.users_view(spark, sf).filter("pref_name is not null")
    return C.referential_filter(W.purchases_view(spark, sf), users).select("event_id", "user_id")


@query("visits_never_bought", with_views("fx_purchases fx_visits", """
select event_id, user_id, item_id from fx_visits v where not exists (select 1 from fx_purchases p
  where p.user_id = v.user_id and p.item_id = v.item_id)"""))
def visits_never_bought(spark, sf):
    bought = W.purchases_view(spark, sf).select("user_id", "item_id").distinct()
    return W.visits_view(spark, sf).join(bought, ["user_id", "item_id"], "left_anti").select("event_id", "user_id", "item_id")


@query("purchases_with_item", with_views("fx_purchases fx_items", """
select event_id, user_id, item_id, genre_name, pref_name as item_pref_name from fx_purchases left join fx_items using (item_id)"""))
def purchases_with_item(spark, sf):
    w = W.world(spark, sf)
    return FE.lookup(w.purchases, w.items.select("item_id", "genre_name", F.col("pref_name").alias("item_pref_name")),
                     ["item_id"]).select("event_id", "user_id", "item_id", "genre_name", "item_pref_name")


@query("visits_with_user_by_other_key", """
select event_id, e.user_id, c_name from events e left join customer on c_custkey = e.user_id
where event_type in ('view', 'click')""")
def visits_with_user_by_other_key(spark, sf):
    visits, customer = W.visits_view(spark, sf), W.star_table(spark, sf, "customer")
    return visits.join(customer, visits["user_id"] == customer["c_custkey"], "left").select("event_id", "user_id", "c_name")


@query("genre_count_lookup", with_views("fx_purchases fx_visits fx_items fx_users", """
select g.user_id, g.genre_name, coalesce(n, 0) as purchases from
(select distinct user_id, genre_name from fx_visits join fx_items using (item_id) where user_id in (select user_id from fx_users)) g
left join (select user_id, genre_name, count(*) as n from fx_purchases join fx_items using (item_id) group by all) c
  on c.user_id = g.user_id and c.genre_name = g.genre_name"""))
def genre_count_lookup(spark, sf):
    w = W.world(spark, sf)
    genre = w.items.select("item_id", "genre_name")
    asked = w.visits.join(genre, "item_id").select("user_id", "genre_name").distinct().join(
        w.users.select("user_id"), "user_id")
    n = w.purchases.join(genre, "item_id").groupBy("user_id", "genre_name").agg(F.count(F.lit(1)).alias("n"))
    return FE.lookup(asked, n, ["user_id", "genre_name"]).select(
        "user_id", "genre_name", F.coalesce("n", F.lit(0)).alias("purchases"))


@query("purchase_and_view_history_outer", with_views("fx_purchases fx_visits", """
select user_id, coalesce(p, 0) as purchases, coalesce(v, 0) as views from
 (select user_id, count(*) as p from fx_purchases group by user_id) a
 full join (select user_id, count(*) as v from fx_visits group by user_id) b using (user_id)"""))
def purchase_and_view_history_outer(spark, sf):
    w = W.world(spark, sf)
    p = w.purchases.groupBy("user_id").agg(F.count(F.lit(1)).alias("p"))
    v = w.visits.groupBy("user_id").agg(F.count(F.lit(1)).alias("v"))
    return p.join(v, "user_id", "full_outer").select(
        "user_id", F.coalesce("p", F.lit(0)).alias("purchases"), F.coalesce("v", F.lit(0)).alias("views"))


@query("key_set_relations", with_views("fx_purchases fx_visits", """
select (select count(*) from p) as left_size, (select count(*) from v) as right_size,
  (select count(*) from (select * from p intersect select * from v) x) as common,
  (select count(*) from (select * from p except select * from v) x) as only_left,
  (select count(*) from (select * from v except select * from p) x) as only_right""",
    """p as (select distinct user_id, item_id from fx_purchases), v as (select distinct user_id, item_id from fx_visits)"""))
def key_set_relations(spark, sf):
    w = W.world(spark, sf)
    return Q.disjoint(w.purchases, w.visits, ["user_id", "item_id"])


@query("last_purchase_before_visit", with_views("fx_purchases fx_visits", """
select v.event_id, v.user_id, coalesce(p.item_id, -1) as last_item, coalesce(epoch_us(p.ts), -1) as last_ts
from fx_visits v asof left join (select user_id, ts, max(item_id) as item_id from fx_purchases group by all) p
  on p.user_id = v.user_id and v.ts > p.ts"""))
def last_purchase_before_visit(spark, sf):
    w = W.world(spark, sf)
    states = w.purchases.groupBy("user_id", F.col("ts").alias("state_time")).agg(F.max("item_id").alias("last_item"))
    out = A.asof_latest(w.visits.select("event_id", "user_id", "ts"), states, ["user_id"])
    return out.select("event_id", "user_id", F.coalesce("last_item", F.lit(-1)).alias("last_item"),
                      F.coalesce(F.unix_micros("state_time"), F.lit(-1)).alias("last_ts"))


@query("lines_before_order", """
with l as (select o_custkey, o_orderdate, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey),
d as (select o_custkey, o_orderdate, count(*) as n, sum(l_extendedprice) as s from l group by all),
r as (select o_custkey, o_orderdate, sum(n) over w as n, sum(s) over w as s from d
  window w as (partition by o_custkey order by o_orderdate rows between unbounded preceding and current row))
select o.o_orderkey, cast(coalesce(r.n, 0) as bigint) as earlier_lines, round(coalesce(r.s, 0), 2) as earlier_value
from orders o asof left join r on r.o_custkey = o.o_custkey and o.o_orderdate > r.o_orderdate""")
def lines_before_order(spark, sf):
    """What each customer had bought strictly before an order: strict as-of over the large fact."""
    orders = W.star_table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    lines = W.star_table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", "ts", "l_extendedprice")
    out = A.asof_measures(orders, lines, ["user_id"], {
        "n": A.Measure("sum", F.lit(1).cast("bigint")), "s": A.Measure("sum", F.col("l_extendedprice"))},
        bucket_us=30 * DAY_US)
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("earlier_lines"),
                      F.round(F.coalesce("s", F.lit(0.0)), 2).alias("earlier_value"))


@query("running_genre_purchases", with_views("fx_purchases fx_items", """
select user_id, genre_name, epoch_us(ts) as state_time, cast(sum(n) over (partition by user_id, genre_name order by ts
  rows between unbounded preceding and current row) as bigint) as purchases from (
  select user_id, genre_name, ts, count(*) as n from fx_purchases join fx_items using (item_id) group by all) x"""))
def running_genre_purchases(spark, sf):
    w = W.world(spark, sf)
    rows = w.purchases.join(w.items.select("item_id", "genre_name"), "item_id")
    return tidy(A.running_state(rows, ["user_id", "genre_name"], {"purchases": A.Measure("sum", F.lit(1).cast("bigint"))}))


@query("user_running_state", with_views("fx_purchases fx_items", """
select user_id, epoch_us(ts) as state_time, cast(sum(n) over w as bigint) as purchases, round(sum(p) over w, 6) as price_sum,
  round(sum(r) over w, 6) as rate_sum, epoch_us(min(ts) over (partition by user_id)) as first_purchase from (
  select user_id, ts, count(*) as n, coalesce(sum(discount_price), 0) as p, coalesce(sum(price_rate), 0) as r
  from fx_purchases left join fx_items using (item_id) group by all) x
window w as (partition by user_id order by ts rows between unbounded preceding and current row)"""))
def user_running_state(spark, sf):
    w = W.world(spark, sf)
    rows = w.purchases.join(w.items.select("item_id", "discount_price", "price_rate"), "item_id", "left")
    state = A.running_state(rows, ["user_id"], {
        "purchases": A.Measure("sum", F.lit(1).cast("bigint")),
        "price_sum": A.Measure("sum", F.coalesce("discount_price", F.lit(0.0))),
        "rate_sum": A.Measure("sum", F.coalesce("price_rate", F.lit(0.0)))})
    first = w.purchases.groupBy("user_id").agg(F.min("ts").alias("first_purchase"))
    return tidy(state.join(first, "user_id"))
