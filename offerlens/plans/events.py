"""Queries of the event-time pipeline: hard negatives, as-of features, evaluation pools, metrics, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.constants import MAX_CANDIDATES_PER_USER, POPULAR_CANDIDATES
from offerlens.operators import audit as Q
from offerlens.operators import candidates as CA
from offerlens.operators import clean as C
from offerlens.operators import encode as E
from offerlens.operators import features as FE
from offerlens.operators import history as H
from offerlens.operators import metrics as V
from offerlens.operators import profile as P
from offerlens.operators import sampling as N
from offerlens.operators import scoring as SC
from offerlens.operators import split as S
from offerlens.plans.registry import query, tidy
from offerlens.plans.sql import draw, stratum, with_views
from offerlens.plans.timing import events_with_id
from offerlens.session import materialized
from offerlens.sources import sinks
from offerlens.sources import views as W


@dataclass(frozen=True)
class EventWorld:
    """Cleaned tables, tagged purchase events and the split boundaries."""

    users: DataFrame
    items: DataFrame
    targets: DataFrame
    visits: DataFrame
    events: DataFrame
    bounds: S.SplitBounds

    def part(self, name: str) -> DataFrame:
        return self.events.filter(F.col("split") == name)

    @property
    def bought(self) -> DataFrame:
        return H.item_sets(self.events)


def event_world(spark, sf) -> EventWorld:
    w = W.world(spark, sf)
    tagged, bounds = S.temporal_three_way_split(events_with_id(spark, sf))
    # Which items are known takes a look at all facts, so it is settled once for the many readers of the items.
    return EventWorld(C.with_age_bucket(w.users), C.with_price_features(materialized(w.items)), C.with_price_features(w.target_items),
                      w.visits, materialized(tagged), bounds)


def train_negatives(w: EventWorld) -> DataFrame:
    pool = N.sampling_index(S.training_pool(w.items, w.bounds.tuning_start))
    return N.exclusive_hard_negatives(w.part("train"), pool, w.bought)


def train_pairs(w: EventWorld) -> DataFrame:
    """The labelled training pairs, computed once: features, checks and models all read them."""
    return materialized(N.training_pairs(w.part("train"), train_negatives(w)))


NAMES = "fx_users fx_purchases fx_visits fx_items fx_targets fx_items_all fx_events fx_bounds fx_split"


def negatives_sql(part: str = "split = 'train'", pool: str = "disp_from is null or disp_from < tuning_start",
                  seed: int = 42) -> str:
    """Hard negatives by brute force: a user's events one by one, each with its best items that no earlier one has."""
    return f"""
priced as (select i.*, ln(1 + greatest(catalog_price, 0)) as lcp, ln(1 + greatest(discount_price, 0)) as lp
  from fx_items i, fx_bounds where {pool}),
meta as (select *, case when l <= 5.5 then 0 when l <= 6.5 then 1 when l <= 7.5 then 2 when l <= 8.5 then 3 else 4 end as band
  from (select *, coalesce(lp, (select median(lp) from priced), 0) as l from priced) x),
pos as (select s.positive_event_id, s.user_id, s.item_id as ref, s.ts, m.genre_name, m.band, m.lp, m.price_rate, m.valid_period
  from fx_split s left join meta m using (item_id) where {part}),
avail as (select p.*, m.item_id, m.genre_name as g2, m.band as b2,
    abs(coalesce(m.lp, 0) - coalesce(p.lp, 0)) + abs(coalesce(m.price_rate, 0) - coalesce(p.price_rate, 0)) / 100.0
      + 0.25 * abs(coalesce(m.valid_period, 0) - coalesce(p.valid_period, 0)) / 365.0 as d
  from pos p join meta m on (m.disp_from is null or m.disp_from <= p.ts) and (m.disp_end is null or m.disp_end >= p.ts)
  where not exists (select 1 from fx_events e where e.user_id = p.user_id and e.item_id = m.item_id)),
liked as (select *, case when g2 = genre_name then 1 when b2 = band then 2 else 3 end as lev from avail),
lists as (select positive_event_id, user_id, ref, list(item_id order by lev, case when lev < 3 then d
    else {draw(['positive_event_id', 'item_id'], seed + 7)} end, item_id) as best from liked group by all),
numbered as (select *, row_number() over (partition by user_id order by positive_event_id) as k from lists),
walk as (select user_id, k, positive_event_id, ref, best[1:5] as got, best[1:5] as used from numbered where k = 1
  union all select n.user_id, n.k, n.positive_event_id, n.ref, list_filter(n.best, lambda x: not list_contains(w.used, x))[1:5],
    list_concat(w.used, list_filter(n.best, lambda x: not list_contains(w.used, x))[1:5])
  from walk w join numbered n on n.user_id = w.user_id and n.k = w.k + 1),
given as (select user_id, positive_event_id, ref, unnest(got) as item_id from walk),
negs as (select g.user_id, item_id, cast(0 as bigint) as label, cast(positive_event_id as bigint) as positive_event_id, g.ref as reference_item_id,
  case lev when 1 then 'L1_same_genre_similar' when 2 then 'L2_similar_price_band' else 'L3_random_fallback' end as negative_source
  from given g join (select positive_event_id, item_id, lev from liked) l using (positive_event_id, item_id))"""


PAIRS_SQL = """
tpairs as (select user_id, item_id, cast(1 as bigint) as label, cast(positive_event_id as bigint) as positive_event_id,
  item_id as reference_item_id, 'positive' as negative_source from fx_split where split = 'train'
  union all select * from negs)"""


@query("hard_negatives", with_views(NAMES, "select * from negs", negatives_sql()))
def hard_negatives(spark, sf):
    """Five hard negatives per training purchase."""
    return tidy(train_negatives(event_world(spark, sf)))


@query("training_pairs", with_views(NAMES, "select * from tpairs", negatives_sql() + "," + PAIRS_SQL))
def training_pairs(spark, sf):
    w = event_world(spark, sf)
    return tidy(train_pairs(w))


@query("refit_pairs", with_views(NAMES, f"""select * from a union all
select user_id, item_id, cast(1 as bigint), cast(positive_event_id as bigint), item_id, 'positive' from fx_split""",
    "a as (with recursive " + negatives_sql() + " select * from negs union all select * from (with recursive "
    + negatives_sql("split <> 'train'", "true", 52) + " select * from negs) n)"))
def refit_pairs(spark, sf):
    """Pairs of the final refit: earlier negatives kept, new events sampled against all items."""
    w = event_world(spark, sf)
    return tidy(N.refit_pairs(w.events, train_negatives(w), w.events.filter("split <> 'train'"), N.sampling_index(w.items),
                              w.bought))


@query("exclusive_negatives", with_views(NAMES, "select * from negs", negatives_sql()))
def exclusive_negatives(spark, sf):
    """Hard negatives where an item serves a user once."""
    return tidy(train_negatives(event_world(spark, sf)))


@query("negative_mix", with_views(NAMES, """
select negative_source, count(*) as rows, round(count(*) / (select count(*) from negs), 6) as share,
  round((select avg(case when negative_source <> 'L3_random_fallback' then 1.0 else 0.0 end) from negs), 6) as hard_share
from negs group by negative_source""", negatives_sql()))
def negative_mix(spark, sf):
    return tidy(N.negative_mix(train_negatives(event_world(spark, sf))))


@query("negative_conflicts", with_views(NAMES, """select count(*) as conflicts from negs n
where exists (select 1 from fx_events e where e.user_id = n.user_id and e.item_id = n.item_id)""", negatives_sql()))
def negative_conflicts(spark, sf):
    w = event_world(spark, sf)
    return Q.negative_conflicts(train_negatives(w), w.bought)


@query("sample_balance", with_views(NAMES, """
select count(*) filter (label = 1) as positive_samples, count(*) filter (label = 0) as negative_samples,
  round(avg(label), 6) as positive_ratio, count(distinct user_id) as unique_users, count(distinct item_id) as unique_items,
  round(count(*) / count(distinct user_id), 6) as avg_samples_per_user from tpairs""", negatives_sql() + "," + PAIRS_SQL))
def sample_balance(spark, sf):
    w = event_world(spark, sf)
    return tidy(P.sample_balance(train_pairs(w)))


@query("audit_sample", with_views(NAMES, f"""
select user_id, item_id, label, positive_event_id, reference_item_id, negative_source, cast(rn as bigint) as row_in_user,
  i.genre_name, round(i.discount_price, 6) as discount_price, i.price_rate from (
  select *, row_number() over (partition by user_id order by positive_event_id, label desc, item_id) as rn from tpairs
  where user_id in (select user_id from (select distinct user_id from tpairs) d order by {draw(['user_id'], 42)}, user_id limit 3)) x
left join fx_items i using (item_id) where rn <= 12""", negatives_sql() + "," + PAIRS_SQL))
def audit_sample(spark, sf):
    w = event_world(spark, sf)
    return tidy(P.audit_sample(train_pairs(w), w.items))


# --- features as of each event -----------------------------------------------------------------------------------------

def event_frame(w: EventWorld, pairs: DataFrame) -> DataFrame:
    visits = S.history_before(w.visits, w.bounds.tuning_start)
    return FE.event_time_features(pairs, w.users, FE.item_features(w.items), w.part("train"), visits)


EVENT_FRAME_SQL = """
hp as (select s.user_id, s.ts, i.genre_name, i.pref_name, i.discount_price, i.price_rate from fx_split s
  left join fx_items i using (item_id) where split = 'train'),
hv as (select v.user_id, v.ts, i.genre_name from fx_visits v left join fx_items i using (item_id), fx_bounds where v.ts < tuning_start),
q as (select t.*, s.ts as et, i.genre_name as g, i.pref_name as ip, i.discount_price as dp, i.price_rate as pr, u.pref_name as up
  from tpairs t join fx_split s on s.positive_event_id = t.positive_event_id left join fx_items i on i.item_id = t.item_id
  left join fx_users u on u.user_id = t.user_id),
snap as (select e.positive_event_id, count(h.ts) as n, sum(discount_price) as ps, sum(price_rate) as rs, min(h.ts) as f, max(h.ts) as l
  from (select distinct positive_event_id, user_id, et from q) e left join hp h on h.user_id = e.user_id and h.ts < e.et group by all),
vsnap as (select e.positive_event_id, count(h.ts) as v
  from (select distinct positive_event_id, user_id, et from q) e left join hv h on h.user_id = e.user_id and h.ts < e.et group by all),
eframe as (select q.*, n, v, ps, rs, f, l,
  (select count(*) from hp h where h.user_id = q.user_id and h.genre_name = q.g and h.ts < q.et) as gn,
  (select count(*) from hv h where h.user_id = q.user_id and h.genre_name = q.g and h.ts < q.et) as gv,
  (select count(*) from hp h where h.user_id = q.user_id and h.pref_name = q.ip and h.ts < q.et) as rn
  from q join snap using (positive_event_id) join vsnap using (positive_event_id))"""

TRAIN_SQL = ",".join([negatives_sql(), PAIRS_SQL, EVENT_FRAME_SQL])


@query("event_time_features", with_views(NAMES, """
select positive_event_id, user_id, item_id, label, epoch_us(et) as feature_event_time, n as user_purchase_count, v as user_view_count,
  round(ps / nullif(n, 0) + 3.7e-9, 6) as user_avg_purchase_price, round(rs / nullif(n, 0) + 3.7e-9, 6) as user_avg_discount_rate,
  coalesce((epoch_us(et) - epoch_us(f)) // 86400000000, -1) as user_active_days, round(v / nullif(n, 0), 6) as view_to_purchase_ratio,
  coalesce(epoch_us(l), -1) as history_last_purchase_time, gn as user_genre_purchase_count, gv as user_genre_view_count,
  rn as user_pref_item_count, cast(case when up = ip then 1 else 0 end as bigint) as same_region,
  round(gn / nullif(n, 0), 6) as user_genre_purchase_ratio, round(gv / nullif(v, 0), 6) as user_genre_view_ratio,
  round(abs(dp - ps / nullif(n, 0)) + 3.7e-9, 6) as price_gap, round(abs(pr - rs / nullif(n, 0)) + 3.7e-9, 6) as discount_rate_gap
from eframe""", TRAIN_SQL))
def event_time_features(spark, sf):
    """Every training pair with its history strictly before the event."""
    w = event_world(spark, sf)
    frame = event_frame(w, train_pairs(w))
    shift = ("user_avg_purchase_price", "user_avg_discount_rate", "price_gap", "discount_rate_gap")
    shown = frame.select(
        "positive_event_id", "user_id", "item_id", "label", "feature_event_time", "user_purchase_count", "user_view_count",
        *[(F.col(c) + 3.7e-9).alias(c) for c in shift], "user_active_days", "view_to_purchase_ratio",
        "history_last_purchase_time", "user_genre_purchase_count", "user_genre_view_count", "user_pref_item_count",
        "same_region", "user_genre_purchase_ratio", "user_genre_view_ratio")
    return tidy(shown).fillna(-1, ["user_active_days", "history_last_purchase_time"])


@query("query_group_sizes", with_views(NAMES, """
select positive_event_id as query_id, count(*) as group_size from tpairs group by 1""", negatives_sql() + "," + PAIRS_SQL))
def query_group_sizes(spark, sf):
    w = event_world(spark, sf)
    return tidy(E.group_sizes(train_pairs(w), "positive_event_id"))


@query("region_label_crosstab", with_views(NAMES, """
select cast(case when up = ip then 1 else 0 end as bigint) as same_region, count(*) filter (label = 0) as label_0,
  count(*) filter (label = 1) as label_1 from eframe group by 1""", TRAIN_SQL))
def region_label_crosstab(spark, sf):
    w = event_world(spark, sf)
    frame = event_frame(w, train_pairs(w))
    return tidy(P.crosstab(frame, "same_region", "label", [0, 1]))


CHECKS = Q.LEAKAGE_CHECKS


@query("leakage_checks", with_views(NAMES, f"""
select '{CHECKS[0]}' as check_name, (select count(*) from fx_split a join fx_split b using (positive_event_id)
  where a.split = 'train' and b.split <> 'train') = 0 as passed union all
select '{CHECKS[1]}', (select count(*) from eframe where l >= et) = 0 union all
select '{CHECKS[2]}', (select max(c) from (select count(distinct (n, v, ps, rs, f)) as c from eframe group by positive_event_id) x) <= 1
union all select '{CHECKS[3]}', (select max(ts) < any_value(tuning_start) from hv, fx_bounds) union all
select '{CHECKS[4]}', (select max(ts) filter (split = 'train') < min(ts) filter (split = 'early_stop')
  and max(ts) filter (split = 'early_stop') < min(ts) filter (split = 'holdout') from fx_split) union all
select '{CHECKS[5]}', (select count(*) from tpairs where (label = 1) <> (negative_source = 'positive')) = 0 union all
select '{CHECKS[6]}', (select min(least(p, n)) > 0 from (select count(*) filter (label = 1) as p, count(*) filter (label = 0) as n
  from eframe group by coalesce(up = ip, false)) x) union all
select '{CHECKS[7]}', (select count(*) from tpairs where item_id in (select item_id from fx_targets)) = 0 union all
select '{CHECKS[8]}', (select count(*) from negs g where exists (select 1 from fx_events e where e.user_id = g.user_id
  and e.item_id = g.item_id)) = 0 union all
select '{CHECKS[9]}', (select count(*) from tpairs where label = 1) = (select count(*) from fx_split where split = 'train')""",
    TRAIN_SQL))
def leakage_checks(spark, sf):
    w = event_world(spark, sf)
    pairs = train_pairs(w)
    return Q.leakage_checks(w.events, w.bounds, pairs, event_frame(w, pairs),
                            S.history_before(w.visits, w.bounds.tuning_start), w.targets, w.bought)


@query("query_invariant_features")
def query_invariant_features(spark, sf):
    """Feature columns that never vary within a user's training rows."""
    w = event_world(spark, sf)
    return Q.query_invariant_features(event_frame(w, train_pairs(w)))


# --- evaluation pools and cut-off features -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Evaluation:
    """One evaluation part: truth, candidate pool, pairs and their cut-off features."""

    truth: DataFrame
    pairs: DataFrame
    frame: DataFrame
    history: DataFrame


def evaluation(w: EventWorld, part: str) -> Evaluation:
    """early_stop is evaluated against the history before its start, holdout against everything before the holdout."""
    b = w.bounds
    start, end = (b.tuning_start, b.holdout_start) if part == "early_stop" else (b.holdout_start, b.last)
    truth = H.item_sets(w.part(part))
    pool = S.pool_with_truth(w.items, truth, start, end)
    pairs = CA.full_candidate_pairs(truth, pool)
    bought = S.history_before(w.events, start)
    history = H.event_history(bought, S.history_before(w.visits, start), w.items)
    frame = FE.cutoff_features(pairs, FE.user_features(w.users, history.user), FE.item_features(w.items), history)
    return Evaluation(truth, pairs, frame, bought)


EVAL_SQL = """
truth as (select distinct user_id, item_id from fx_split where split = 'holdout'),
epool as (select i.* from fx_items i, fx_bounds where ((disp_from is null or disp_from <= last_ts)
  and (disp_end is null or disp_end >= holdout_start)) or item_id in (select item_id from truth)),
epairs as (select user_id, item_id, case when (user_id, item_id) in (select (user_id, item_id) from truth) then 1 else 0 end as label
  from (select distinct user_id from truth) t, (select item_id from epool) p),
hb as (select s.user_id, s.item_id, s.ts, i.genre_name, i.pref_name, i.discount_price, i.price_rate from fx_split s
  left join fx_items i using (item_id) where split <> 'holdout'),
hw as (select v.user_id, v.item_id, i.genre_name from fx_visits v left join fx_items i using (item_id), fx_bounds
  where v.ts < holdout_start),
hu as (select user_id, count(*) as n, count(distinct item_id) as ui, count(distinct genre_name) as ug, avg(discount_price) as ap,
  quantile_cont(discount_price, 0.5) as mp, avg(price_rate) as ar, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 as ad
  from hb group by user_id),
hvu as (select user_id, count(*) as v, count(distinct item_id) as uv from hw group by user_id),
cframe as (select e.user_id, e.item_id, e.label, coalesce(n, 0) as n, coalesce(ui, 0) as ui, coalesce(ug, 0) as ug,
  coalesce(ap, 0) as ap, coalesce(mp, 0) as mp, coalesce(ar, 0) as ar, coalesce(ad, 0) as ad, coalesce(v, 0) as v, coalesce(uv, 0) as uv,
  coalesce(g.c, 0) as gn, coalesce(r.c, 0) as rn, coalesce(ic.c, 0) as icn, coalesce(gv.c, 0) as gvn,
  case when u.pref_name = i.pref_name then 1 else 0 end as same_region, i.discount_price as dp, i.price_rate as pr
  from epairs e left join fx_users u using (user_id) left join fx_items i using (item_id) left join hu using (user_id)
  left join hvu using (user_id)
  left join (select user_id, genre_name, count(*) as c from hb group by all) g on g.user_id = e.user_id and g.genre_name = i.genre_name
  left join (select user_id, pref_name, count(*) as c from hb group by all) r on r.user_id = e.user_id and r.pref_name = i.pref_name
  left join (select user_id, item_id, count(*) as c from hb group by all) ic on ic.user_id = e.user_id and ic.item_id = e.item_id
  left join (select user_id, genre_name, count(*) as c from hw group by all) gv on gv.user_id = e.user_id and gv.genre_name = i.genre_name)"""


@query("full_candidate_pairs", with_views(NAMES, "select user_id, item_id, cast(label as bigint) as label from epairs", EVAL_SQL))
def full_candidate_pairs(spark, sf):
    """Every holdout user with every item of the holdout pool."""
    return tidy(evaluation(event_world(spark, sf), "holdout").pairs)


@query("candidates_per_user_summary", with_views(NAMES, """
select count(*) as count, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as min, quantile_cont(n, 0.25) as p25,
  quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.75) as p75, max(n) as max
from (select user_id, count(*) as n from epairs group by 1) x""", EVAL_SQL))
def candidates_per_user_summary(spark, sf):
    return tidy(P.group_size_summary(evaluation(event_world(spark, sf), "holdout").pairs, "user_id"))


@query("cutoff_features", with_views(NAMES, """
select user_id, item_id, cast(label as bigint) as label, cast(n as double) as user_purchase_count, cast(ui as double) as user_unique_item_count,
  cast(ug as double) as user_unique_genre_count, round(ap + 3.7e-9, 6) as user_avg_purchase_price,
  round(mp + 3.7e-9, 6) as user_median_purchase_price, round(ar + 3.7e-9, 6) as user_avg_discount_rate, cast(ad as double) as user_active_days,
  cast(v as double) as user_view_count, cast(uv as double) as user_unique_view_item_count,
  round(coalesce(v / nullif(n, 0), 0), 6) as view_to_purchase_ratio, cast(gn as double) as user_genre_purchase_count,
  cast(rn as double) as user_pref_item_count, cast(icn as double) as user_item_purchase_count, cast(gvn as double) as user_genre_view_count,
  cast(same_region as bigint) as same_region, round(gn / nullif(n, 0), 6) as user_genre_purchase_ratio,
  round(gvn / nullif(v, 0), 6) as user_genre_view_ratio, round(abs(dp - ap) + 3.7e-9, 6) as price_gap,
  round(abs(pr - ar) + 3.7e-9, 6) as discount_rate_gap from cframe""", EVAL_SQL))
def cutoff_features(spark, sf):
    frame = evaluation(event_world(spark, sf), "holdout").frame
    shift = ("user_avg_purchase_price", "user_median_purchase_price", "user_avg_discount_rate", "price_gap", "discount_rate_gap")
    return tidy(frame.select(
        "user_id", "item_id", "label", "user_purchase_count", "user_unique_item_count", "user_unique_genre_count",
        *[(F.col(c) + 3.7e-9).alias(c) for c in shift], "user_active_days", "user_view_count", "user_unique_view_item_count",
        "view_to_purchase_ratio", "user_genre_purchase_count", "user_pref_item_count", "user_item_purchase_count",
        "user_genre_view_count", "same_region", "user_genre_purchase_ratio", "user_genre_view_ratio"))


@query("user_features", with_views(NAMES, """
select user_id, u.sex_id, cast(u.age as bigint) as age, u.pref_name as user_pref_name, coalesce(n, 0) as user_purchase_count,
  coalesce(v, 0) as user_view_count from fx_users u left join (select user_id, count(*) as n from fx_events group by 1) a using (user_id)
left join (select user_id, count(*) as v from fx_visits group by 1) b using (user_id)"""))
def user_features(spark, sf):
    w = W.world(spark, sf)
    out = FE.user_features(C.with_age_bucket(w.users), H.full_user_history(w.purchases, w.visits, w.items))
    return tidy(out.select("user_id", "sex_id", "age", "user_pref_name", F.coalesce("user_purchase_count", F.lit(0)).alias(
        "user_purchase_count"), F.coalesce("user_view_count", F.lit(0)).alias("user_view_count")))


@query("item_features", with_views("fx_priced", """
select item_id, genre_name, capsule_text, price_rate, catalog_price, round(discount_price, 6) as discount_price,
  cast(valid_period as double) as valid_period, pref_name as item_pref_name, epoch_us(disp_from) as disp_from,
  round(discount_ratio, 6) as discount_ratio, round(display_days, 6) as display_days, day(disp_from) as disp_day from fx_priced"""))
def item_features(spark, sf):
    out = FE.item_features(C.clean_items(W.all_items_view(spark, sf), "train"))
    return tidy(out.select("item_id", "genre_name", "capsule_text", "price_rate", "catalog_price", "discount_price",
                           "valid_period", "item_pref_name", "disp_from", "discount_ratio", "display_days", "disp_day"))


@query("leave_one_out_features", with_views(NAMES, """
select user_id, item_id, cast(label as bigint) as label, cast(case when p then greatest(n - 1, 0) else n end as double) as user_purchase_count,
  cast(case when p and icn = 1 then greatest(ui - 1, 0) else ui end as double) as user_unique_item_count,
  cast(case when p and gn = 1 then greatest(ug - 1, 0) else ug end as double) as user_unique_genre_count,
  cast(case when p then greatest(gn - 1, 0) else gn end as double) as user_genre_purchase_count,
  cast(case when p then greatest(rn - 1, 0) else rn end as double) as user_pref_item_count,
  round((ap * n - case when p then dp else 0 end) / nullif(case when p then greatest(n - 1, 0) else n end, 0) + 3.7e-9, 6)
    as user_avg_purchase_price from (select *, label = 1 as p from cframe) x""", EVAL_SQL.replace(
    "split = 'holdout'", "split = 'early_stop'").replace("split <> 'holdout'", "split <> 'holdout'")))
def leave_one_out_features(spark, sf):
    """The older feature frame on the tuning pairs, with a history that contains them."""
    w = event_world(spark, sf)
    truth = H.item_sets(w.part("early_stop"))
    pairs = CA.full_candidate_pairs(truth, S.pool_with_truth(w.items, truth, w.bounds.holdout_start, w.bounds.last))
    start = w.bounds.holdout_start
    history = H.event_history(S.history_before(w.events, start), S.history_before(w.visits, start), w.items)
    frame = FE.leave_one_out_features(pairs, FE.user_features(w.users, history.user), FE.item_features(w.items), history)
    return tidy(frame.select(
        "user_id", "item_id", "label", "user_purchase_count", "user_unique_item_count", "user_unique_genre_count",
        "user_genre_purchase_count", "user_pref_item_count",
        (F.col("user_avg_purchase_price") + 3.7e-9).alias("user_avg_purchase_price")))


# --- baselines and metrics ---------------------------------------------------------------------------------------------

BASE_SQL = EVAL_SQL + """,
pop as (select item_id, count(*) as c from hb group by 1),
scored as (select 'global_popularity' as method, user_id, item_id, round(ln(1 + coalesce(c, 0)), 6) as score
    from cframe left join pop using (item_id) union all
  select 'user_preference', user_id, item_id, round(ln(1 + gn) + 0.5 * ln(1 + gvn) + 0.25 * same_region, 6) from cframe),
ranked as (select method, user_id, item_id, score, rank from (select *, row_number() over (partition by method, user_id
  order by score desc, item_id) as rank from scored) x where rank <= 10),
sizes as (select user_id, count(*) as n from truth group by 1),
ap as (select m.method, s.user_id, coalesce(gain, 0) / least(n, 10) as ap from sizes s
  cross join (select distinct method from scored) m left join (
    select method, user_id, sum(h / rank) as gain from (
      select r.method, r.user_id, r.rank, row_number() over (partition by r.method, r.user_id order by r.rank) as h
      from ranked r join truth t on t.user_id = r.user_id and t.item_id = r.item_id) x group by all) g
  on g.user_id = s.user_id and g.method = m.method)"""


def baseline_scores(e: Evaluation) -> DataFrame:
    """(method, user, item, score) of the two untrained baselines."""
    sold = e.history.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_purchases"))
    rows = e.frame.join(sold, "item_id", "left")
    cells = F.array(
        F.struct(F.lit("global_popularity").alias("method"), F.round(SC.global_popularity_score(), 6).alias("score")),
        F.struct(F.lit("user_preference").alias("method"), F.round(SC.preference_score(), 6).alias("score")))
    return rows.select("user_id", "item_id", F.inline(cells))


def baseline_ap(spark, sf) -> DataFrame:
    e = evaluation(event_world(spark, sf), "holdout")
    return V.evaluate(baseline_scores(e), e.truth, by=["method"])


@query("baseline_rankings", with_views(NAMES, "select method, user_id, item_id, score, rank from ranked", BASE_SQL))
def baseline_rankings(spark, sf):
    return tidy(V.rank_predictions(baseline_scores(evaluation(event_world(spark, sf), "holdout")), by=["method"]))


@query("baseline_ap", with_views(NAMES, "select method, user_id, round(ap, 6) as ap from ap", BASE_SQL))
def baseline_ap_query(spark, sf):
    return tidy(baseline_ap(spark, sf))


@query("baseline_map", with_views(NAMES, "select method, round(avg(ap), 6) as map_at_k from ap group by method", BASE_SQL))
def baseline_map(spark, sf):
    return tidy(V.mapk(baseline_ap(spark, sf), ["method"]))


@query("compare_methods", with_views(NAMES, """
select method, 'baseline' as kind, round(avg(ap), 6) as map_at_k, count(*) as users, 'holdout, whole pool' as evaluation_split
from ap group by method""", BASE_SQL))
def compare_methods(spark, sf):
    return tidy(V.compare_methods(baseline_ap(spark, sf), {"global_popularity": "baseline", "user_preference": "baseline"}))


@query("mean_ap_delta", with_views(NAMES, """
select count(*) as users, round(avg(case when method = 'user_preference' then ap else -ap end) * 2, 6) as mean_delta
from ap""".replace("count(*) as users", "count(distinct user_id) as users"), BASE_SQL))
def mean_ap_delta(spark, sf):
    deltas = V.ap_deltas(baseline_ap(spark, sf), "user_preference", "global_popularity")
    return tidy(deltas.agg(F.count(F.lit(1)).alias("users"), F.avg("delta").alias("mean_delta")))


def bootstrap_sql(pairs: list[tuple[str, str, int]], repeats: int = 2000) -> str:
    """Resamples of as many users as there are, drawn by the same integer hash; (reference, challenger, seed) each."""
    first = draw(["r", "j"], 0).replace(" + 0)", " + seed * 15485863)")
    rows = " union all ".join(f"select '{a}' as reference, '{b}' as challenger, {s} as seed" for a, b, s in pairs)
    return f"""
asked as ({rows}),
deltas as (select reference, challenger, seed, a.user_id, round(a.ap - b.ap, 12) as delta from asked join ap a on a.method = reference
  join ap b on b.method = challenger and b.user_id = a.user_id),
placed as (select *, row_number() over (partition by challenger order by delta) - 1 as place, count(*) over (partition by challenger) as users from deltas),
drawn as (select challenger, r, {draw(["d", "r"], 0).replace(" + 0)", " + (seed + 1) * 15485863)")} % users as place
  from (select challenger, seed, users, r, {first} as d from (select distinct challenger, seed, users from placed), range({repeats}) t(r), range(users) u(j))),
means as (select d.challenger, r, avg(delta) as m from drawn d join placed p on p.challenger = d.challenger and p.place = d.place group by all),
ends as (select challenger, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from means group by challenger),
bootstrap as (select a.reference, a.challenger, round(avg(delta), 6) as mean_ap_delta, round(any_value(lo), 6) as ci_low, round(any_value(hi), 6) as ci_high,
  case when any_value(lo) > 0 then 'reference ahead' else 'no clear difference' end as conclusion
  from asked a join deltas d on d.challenger = a.challenger join ends e on e.challenger = a.challenger group by all)"""


@query("paired_bootstrap", with_views(NAMES, "select * from bootstrap", BASE_SQL + "," + bootstrap_sql([("user_preference", "global_popularity", 42)])))
def paired_bootstrap(spark, sf):
    """Mean AP difference of the baselines with its 95 % interval."""
    return tidy(V.paired_bootstrap(baseline_ap(spark, sf), "user_preference", "global_popularity"))


@query("bootstrap_table", with_views(NAMES, "select * from bootstrap", BASE_SQL.replace("ap as (", "ap0 as (", 1) + """,
ap as (select * from ap0 union all select 'even_mix', user_id, avg(ap) from ap0 group by user_id)""" + ","
    + bootstrap_sql([("user_preference", "even_mix", 42), ("user_preference", "global_popularity", 43)])))
def bootstrap_table(spark, sf):
    """The preference baseline against every other method (popularity, and an even mix of both), with verdicts."""
    ap = materialized(baseline_ap(spark, sf).select("method", "user_id", "ap"))
    mix = ap.groupBy("user_id").agg(F.avg("ap").alias("ap")).select(F.lit("even_mix").alias("method"), "user_id", "ap")
    return tidy(V.bootstrap_table(ap.unionByName(mix), "user_preference"))


def _retrieval(spark, sf):
    w = event_world(spark, sf)
    truth = H.item_sets(w.part("holdout"))
    start = w.bounds.holdout_start
    pool = S.pool_with_truth(w.items, truth, start, w.bounds.last)
    return w, truth, pool, S.history_before(w.events, start), S.history_before(w.visits, start)


LIMIT, POPULAR = 40, 6  # limits of popular_random_candidates and retrieval_recall, small enough to bite on small pools


def retrieval_sql(sources: str, seed: int = 42, limit: int = LIMIT, popular: int = POPULAR) -> str:
    """Every source of the candidates, filled up by seeded random draws, cut to the limit, by windows over the whole pool."""
    placed = stratum("j", f"least({limit}, size)", "size", draw(["user_id", "j"], seed))
    return f"""
truth as (select distinct user_id, item_id from fx_split where split = 'holdout'),
tusers as (select distinct user_id from truth),
epool as (select i.* from fx_items i, fx_bounds where ((disp_from is null or disp_from <= last_ts)
  and (disp_end is null or disp_end >= holdout_start)) or item_id in (select item_id from truth)),
hbuys as (select user_id, item_id from fx_split where split <> 'holdout'),
sold as (select item_id, count(*) as n from hbuys group by item_id),
popular as (select item_id from sold where item_id in (select item_id from epool) order by n desc, item_id limit {popular}),
viewed as (select user_id, item_id from (select *, row_number() over (partition by user_id order by ts, event_id, item_id) as k from (
    select user_id, item_id, ts, event_id from (select v.*, row_number() over (partition by v.user_id, v.item_id order by ts, event_id) as f
      from fx_visits v, fx_bounds where ts < holdout_start and v.user_id in (select user_id from tusers) and v.item_id in (select item_id from epool)) x
    where f = 1) y) z where k <= {limit} // 3),
liked as (select distinct b.user_id, i.genre_name from hbuys b join tusers using (user_id) join fx_items i using (item_id) where i.genre_name is not null),
takes as (select *, greatest(20, {limit} // count(*) over (partition by user_id)) as take from liked),
gplace as (select item_id, genre_name, row_number() over (partition by genre_name order by coalesce(n, 0) desc, item_id) as place
  from (select item_id, coalesce(genre_name, '__MISSING_GENRE__') as genre_name from epool) e left join sold using (item_id)),
by_genre as (select t.user_id, g.item_id from takes t join gplace g using (genre_name) where g.place <= least(t.take, {limit})),
for_all as (select user_id, item_id from tusers, popular),
chosen as (select distinct user_id, item_id from ({sources}) c),
placed as (select item_id, row_number() over (order by item_id) - 1 as pos, count(*) over () as size from epool),
drawn as (select user_id, {placed} as pos, {draw(["user_id", "j"], seed + 1)} as ord
  from tusers, range({limit}) t(j), (select max(size) as size from placed) m where j < size),
merged as (select user_id, item_id, 0 as tier, {draw(["user_id", "item_id"], seed + 2)} as ord from chosen
  union all select user_id, item_id, 1, ord from drawn join placed using (pos)),
firsts as (select user_id, item_id, min((tier, ord)) as o from merged group by all),
found as (select user_id, item_id from (select *, row_number() over (partition by user_id order by o, item_id) as k from firsts) f where k <= {limit})"""


WITH_TRUTH = """
candidates as (select user_id, item_id, cast(t.user_id is not null as bigint) as label, cast(f.user_id is not null as bigint) as retrieved
  from (select *, true as here from found) f full outer join truth t using (user_id, item_id))"""
EVERY = "select * from viewed union all select * from by_genre union all select * from for_all"
ALL_SOURCES = retrieval_sql(EVERY) + "," + WITH_TRUTH


@query("retrieval_candidates", with_views(NAMES, "select user_id, item_id, label, retrieved from candidates", retrieval_sql(
    EVERY, limit=MAX_CANDIDATES_PER_USER, popular=POPULAR_CANDIDATES) + "," + WITH_TRUTH))
def retrieval_candidates(spark, sf):
    """Retrieved candidates of holdout users with the sources and limits of a full run."""
    w, truth, pool, bought, seen = _retrieval(spark, sf)
    return tidy(CA.retrieval_candidates(truth, pool, w.items, bought, seen))


@query("popular_random_candidates", with_views(NAMES, """
select user_id, item_id, cast((user_id, item_id) in (select (user_id, item_id) from truth) as bigint) as label, cast(1 as bigint) as retrieved
from found""", retrieval_sql("select * from for_all")))
def popular_random_candidates(spark, sf):
    _, truth, pool, bought, _ = _retrieval(spark, sf)
    return tidy(CA.popular_random_candidates(truth, pool, bought, LIMIT, POPULAR))


@query("retrieval_recall", with_views(NAMES, """
select count(*) filter (label = 1 and retrieved = 1) as hits, count(*) filter (label = 1) as truth_size,
  round(count(*) filter (label = 1 and retrieved = 1) / count(*) filter (label = 1), 6) as recall from candidates""", ALL_SOURCES))
def retrieval_recall(spark, sf):
    w, truth, pool, bought, seen = _retrieval(spark, sf)
    return tidy(CA.retrieval_recall(CA.retrieval_candidates(truth, pool, w.items, bought, seen, LIMIT, POPULAR), truth))


@query("sampled_users", with_views(NAMES, f"""
select user_id from (select distinct user_id from fx_events) d order by {draw(['user_id'], 42)}, user_id limit 100"""))
def sampled_users(spark, sf):
    """A seeded sample of buyers (the sample size is the operator's parameter)."""
    return CA.sample_users(event_world(spark, sf).events, 100, 42)


# --- final predictions -------------------------------------------------------------------------------------------------

TARGET_SQL = """
hb as (select user_id, genre_name, count(*) as c from fx_events join fx_items using (item_id) group by all),
hw as (select user_id, genre_name, count(*) as c from fx_visits join fx_items using (item_id)
  where ts <= (select max(ts) from fx_events) group by all),
tscore as (select u.user_id, t.item_id, round(ln(1 + coalesce(hb.c, 0)) + 0.5 * ln(1 + coalesce(hw.c, 0))
  + 0.25 * case when u.pref_name = t.pref_name then 1 else 0 end, 6) + 0.0 as score from fx_users u cross join fx_targets t
  left join hb on hb.user_id = u.user_id and hb.genre_name = t.genre_name
  left join hw on hw.user_id = u.user_id and hw.genre_name = t.genre_name),
tranked as (select user_id, item_id, score, rank from (select *, row_number() over (partition by user_id
  order by score desc, item_id) as rank from tscore) x where rank <= 10)"""


def preference_targets(spark, sf):
    w = W.world(spark, sf)
    history = H.event_history(w.purchases, S.history_through(w.visits, w.purchases), w.items)
    return w, SC.preference_top(w.users, w.target_items, history.genre, history.genre_view, digits=6)


@query("predict_targets", with_views(NAMES, "select user_id, item_id, score, rank from tranked", TARGET_SQL))
def predict_targets(spark, sf):
    """Every user's ten best of all target items by the preference baseline, through the exact shortlist."""
    return tidy(preference_targets(spark, sf)[1])


FALLBACK_SQL = TARGET_SQL + """,
fb as (select string_agg(item_id, ' ' order by n desc, item_id) as l from (select item_id, coalesce(n, 0) as n from fx_targets
  left join (select genre_name, count(*) as n from fx_events join fx_items using (item_id) group by all) g using (genre_name)
  order by n desc, item_id limit 10) x),
buyers as (select distinct user_id from fx_events),
subm as (select u.user_id, coalesce(l, (select l from fb)) as purchased_items from fx_users u left join (
  select user_id, string_agg(item_id, ' ' order by rank) as l from tranked where user_id in (select user_id from buyers)
  group by user_id) r using (user_id))"""


def fallback_submission(spark, sf):
    """Buyers get their own list, everybody else the items of the most bought genres."""
    w, ranked = preference_targets(spark, sf)
    own = ranked.join(w.purchases.select("user_id").distinct(), "user_id", "left_semi")
    fallback = H.genre_popularity_rank(w.purchases, w.items, w.target_items)
    return w, own, sinks.submission_with_fallback(w.template, own, fallback)


@query("submission_with_fallback", with_views(NAMES, "select user_id, purchased_items from subm", FALLBACK_SQL))
def submission_with_fallback(spark, sf):
    return fallback_submission(spark, sf)[2]


@query("submission_guards", with_views(NAMES, """
select 'few_users_without_list' as check_name, (select count(*) from fx_users where user_id not in (select user_id from buyers))
  <= greatest(1, (select count(*) from fx_users) * 0.001) as passed union all
select 'columns_as_asked', true union all
select 'each_user_once', (select count(*) from subm) = (select count(*) from fx_users)""", FALLBACK_SQL))
def submission_guards(spark, sf):
    w, own, out = fallback_submission(spark, sf)
    return Q.submission_guards(w.template, out, own.select("user_id").distinct())
