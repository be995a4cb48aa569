"""SQL building blocks shared by the oracle queries."""

from __future__ import annotations

from offerlens.functions.constants import RULE_WEIGHTS

M = 2147483647

# The user-item world as common table expressions, in dependency order.
VIEWS = {
    "fx_users": """select c_custkey as user_id, substr(c_mktsegment, 1, 1) as sex_id,
        cast(15 + (c_custkey * 7) % 60 as integer) as age, n_name as pref_name
        from customer join nation on c_nationkey = n_nationkey""",
    "fx_facts": """select event_id, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as item_id, ts, event_type
        from events""",
    "fx_purchases": "select event_id, user_id, item_id, ts from fx_facts where event_type = 'purchase'",
    "fx_visits": "select event_id, user_id, item_id, ts from fx_facts where event_type in ('view', 'click')",
    "fx_items_all": """select p_partkey as item_id, p_type as genre_name, p_brand as capsule_text,
        cast(p_size as double) as price_rate, p_retailprice as catalog_price,
        p_retailprice * (100 - p_size) / 100 as discount_price, n_name as pref_name, p_size * 3 as valid_period,
        timestamp '2024-01-01 00:00:00' + interval '1' day * cast((p_partkey % 5 - 1) * 5 as int) as disp_from,
        case when p_partkey % 11 = 0 then null else timestamp '2024-01-01 00:00:00'
          + interval '1' day * cast((p_partkey % 5 - 1) * 5 + 10 + p_partkey % 15 as int) end as disp_end
        from part join nation on p_partkey % 25 = n_nationkey""",
    "fx_seen": "select distinct item_id from fx_facts where event_type in ('purchase', 'view', 'click')",
    "fx_items": "select * from fx_items_all where item_id in (select item_id from fx_seen)",
    "fx_targets": "select * from fx_items_all where item_id not in (select item_id from fx_seen)",
    "fx_grid": """select first_day + interval '1' day * cast(date_diff('day', first_day, val_start) % 7 as int) as first_start,
        val_start, final_cutoff from (
          select cast(date_trunc('day', min(ts)) as timestamp) as first_day,
                 cast(date_trunc('day', max(ts)) as timestamp) - interval '6' day as val_start,
                 cast(date_trunc('day', max(ts)) as timestamp) + interval '1' day as final_cutoff from fx_purchases) b""",
    "fx_lines": """select o_custkey as user_id, l_partkey as item_id, o_orderdate as ts
        from lineitem join orders on l_orderkey = o_orderkey""",
    "fx_events": """select event_id, user_id, item_id, ts, row_number() over (order by event_id) - 1 as positive_event_id
        from fx_purchases""",
    "fx_bounds": """select max(case when rn = t then ts end) as tuning_start, max(case when rn = h then ts end) as holdout_start,
        max(ts) as last_ts from (
          select ts, row_number() over (order by ts) - 1 as rn,
                 cast(floor(count(*) over () * 0.8) as bigint) as t, cast(floor(count(*) over () * 0.9) as bigint) as h
          from fx_events) p""",
    "fx_split": """select e.*, case when ts < tuning_start then 'train' when ts < holdout_start then 'early_stop'
        else 'holdout' end as split from fx_events e, fx_bounds""",
    "fx_priced": """select *, case when catalog_price - discount_price < 0 then 0.0 else catalog_price - discount_price end
          as discount_amount,
        discount_price / nullif(case when catalog_price > 0 then catalog_price end, 0) as discount_ratio,
        ln(1 + case when catalog_price < 0 then 0 else catalog_price end) as log_catalog_price,
        ln(1 + case when discount_price < 0 then 0 else discount_price end) as log_discount_price,
        (epoch_us(disp_end) - epoch_us(disp_from)) / 86400000000.0 as display_days from fx_items_all""",
}


def views(*names: str) -> str:
    """The named views and everything they need, as the body of a WITH clause."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in wanted:
            return
        for other in VIEWS:
            if other != name and _mentions(VIEWS[name], other):
                need(other)
        wanted.append(name)

    for name in names:
        need(name)
    return ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted)


def _mentions(text: str, name: str) -> bool:
    return name in text.replace("(", " ").replace(")", " ").replace(",", " ").split()


def with_views(names: str, body: str, ctes: str = "") -> str:
    head = views(*names.split())
    return f"with recursive {head}{', ' + ctes if ctes else ''}\n{body}"


def draw(parts: list[str], seed: int) -> str:
    """The integer draw of functions.exprs.draw."""
    factors = (7919, 104729, 1299709)
    terms = " + ".join(f"cast({p} as bigint) * {f}" for p, f in zip(parts, factors))
    h = f"(({terms} + {seed * 15485863}) % {M})"
    return f"(({h} * {h} + {h} * 48271 + 12345) % {M})"


def stratum(j: str, m: str, n: str, drawn: str) -> str:
    low, high = f"(({j}) * ({n}) // ({m}))", f"((({j}) + 1) * ({n}) // ({m}))"
    return f"({low} + ({drawn}) % greatest({high} - {low}, 1))"


def log0(c: str) -> str:
    return f"ln(1 + coalesce({c}, 0))"


def context(cut: str, purchases: str = "fx_purchases", visits: str = "fx_visits", items: str = "fx_items_all",
            prefix: str = "c") -> str:
    """Aggregates before a cut-off (an SQL scalar) as CTEs <prefix>_user, _user_genre, _user_item, _item, _genre."""
    p = prefix
    return f"""
{p}_buys as (select b.*, i.genre_name, i.discount_price from {purchases} b left join {items} i using (item_id)
  where ts < {cut}),
{p}_views as (select v.*, i.genre_name from {visits} v left join {items} i using (item_id) where ts < {cut}),
{p}_user as (select user_id, coalesce(p, 0) as user_purchases, coalesce(v, 0) as user_visits, user_mean_price,
    user_last_purchase from
  (select user_id, count(*) as p, avg(discount_price) as user_mean_price, max(ts) as user_last_purchase
   from {p}_buys group by user_id) a full join (select user_id, count(*) as v from {p}_views group by user_id) b
  using (user_id)),
{p}_user_genre as (select user_id, genre_name, coalesce(p, 0) as user_genre_purchases, coalesce(v, 0) as user_genre_visits
  from (select user_id, genre_name, count(*) as p from {p}_buys where genre_name is not null group by all) a
  full join (select user_id, genre_name, count(*) as v from {p}_views where genre_name is not null group by all) b
  using (user_id, genre_name)),
{p}_user_item as (select user_id, item_id, count(*) as same_item_purchases from {p}_buys group by all),
{p}_item as (select item_id, coalesce(p, 0) as item_purchases, coalesce(v, 0) as item_visits
  from (select item_id, count(*) as p from {p}_buys group by all) a
  full join (select item_id, count(*) as v from {p}_views group by all) b using (item_id)),
{p}_genre as (select genre_name, count(*) as genre_purchases from {p}_buys where genre_name is not null group by all)"""


def codes(items: str = "fx_items_all") -> str:
    return f"""
codes as (select kind, value, row_number() over (partition by kind order by value) as code from (
  select distinct 'genre' as kind, genre_name as value from {items} union all
  select distinct 'capsule', capsule_text from {items} union all
  select 'pref', v from (select pref_name as v from fx_users union select pref_name from {items}) u union all
  select distinct 'sex', sex_id from fx_users) x where value is not null)"""


def pair_features(pairs: str, cut: str, items: str = "fx_items_all", prefix: str = "c", coded: bool = True,
                  extra: str = "") -> str:
    """CTE `feats`: the pair features of a relation (user_id, item_id)."""
    p = prefix
    code_columns = (
        "coalesce(sx.code, 0) as sex_code, coalesce(up.code, 0) as user_pref_code, coalesce(ip.code, 0) as item_pref_code, "
        "coalesce(gc.code, 0) as genre_code, coalesce(cc.code, 0) as capsule_code"
        if coded else "0 as sex_code, 0 as user_pref_code, 0 as item_pref_code, 0 as genre_code, 0 as capsule_code")
    code_joins = """
left join codes sx on sx.kind = 'sex' and sx.value = u.sex_id
left join codes up on up.kind = 'pref' and up.value = u.pref_name
left join codes ip on ip.kind = 'pref' and ip.value = i.pref_name
left join codes gc on gc.kind = 'genre' and gc.value = i.genre_name
left join codes cc on cc.kind = 'capsule' and cc.value = i.capsule_text""" if coded else ""
    return f"""
feats as (select q.user_id, q.item_id, {extra} coalesce(u.age, 0) as age, {code_columns},
  case when u.pref_name = i.pref_name then 1 else 0 end as pref_match, coalesce(i.price_rate, 0) as price_rate,
  {log0('greatest(i.catalog_price, 0)')} as log_catalog_price, {log0('greatest(i.discount_price, 0)')} as log_discount_price,
  {log0('cu.user_mean_price')} as log_user_mean_price,
  abs({log0('greatest(i.discount_price, 0)')} - {log0('cu.user_mean_price')}) as price_distance,
  {log0('cu.user_purchases')} as log_user_purchases, {log0('cu.user_visits')} as log_user_visits,
  greatest(coalesce((epoch_us({cut}) - epoch_us(cu.user_last_purchase)) / 86400000000.0, 365.0), 0) as days_since_purchase,
  {log0('cug.user_genre_purchases')} as log_user_genre_purchases, {log0('cug.user_genre_visits')} as log_user_genre_visits,
  {log0('ci.item_purchases')} as log_item_purchases, {log0('ci.item_visits')} as log_item_visits,
  {log0('cg.genre_purchases')} as log_genre_purchases, {log0('cui.same_item_purchases')} as log_same_item_purchases
from {pairs} q left join fx_users u on u.user_id = q.user_id left join {items} i on i.item_id = q.item_id
left join {p}_user cu on cu.user_id = q.user_id
left join {p}_user_genre cug on cug.user_id = q.user_id and cug.genre_name = i.genre_name
left join {p}_user_item cui on cui.user_id = q.user_id and cui.item_id = q.item_id
left join {p}_item ci on ci.item_id = q.item_id left join {p}_genre cg on cg.genre_name = i.genre_name{code_joins})"""


RULE_SQL = " + ".join(f"{w} * {c}" for c, w in RULE_WEIGHTS.items())
POPULARITY_SQL = "log_item_purchases + 0.2 * log_genre_purchases"

FEATURE_INT = ["sex_code", "user_pref_code", "item_pref_code", "genre_code", "capsule_code"]


def feature_list(names: list[str]) -> str:
    """The feature columns in the types of tidy()."""
    return ", ".join(f"cast({n} as bigint) as {n}" if n in FEATURE_INT else f"round(cast({n} as double), 6) + 0.0 as {n}"
                     for n in names)
