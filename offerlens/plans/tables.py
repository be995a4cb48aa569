"""Queries on single tables: scans, profiles, cleaning, translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import exprs as X
from offerlens.functions.constants import TRANSLATION_FIELDS
from offerlens.operators import clean as C
from offerlens.operators import profile as P
from offerlens.operators.sampling import sampling_index
from offerlens.plans.registry import query, tidy
from offerlens.plans.sql import with_views
from offerlens.sources import tables as T
from offerlens.sources import views as W

ITEM_SQL = """item_id, genre_name, capsule_text, price_rate, catalog_price, round(discount_price, 6) as discount_price,
  pref_name, cast(valid_period as bigint) as valid_period, epoch_us(disp_from) as disp_from,
  coalesce(epoch_us(disp_end), -1) as disp_end"""


@query("scan_purchases", with_views("fx_purchases", "select event_id, user_id, item_id, epoch_us(ts) as ts from fx_purchases"))
def scan_purchases(spark, sf):
    return tidy(W.purchases_view(spark, sf))


@query("scan_orders_projection", "select o_custkey, o_orderstatus from orders where o_totalprice > 100000")
def scan_orders_projection(spark, sf):
    return T.read_table(W.configure(spark), sf, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"]).filter(
        "o_totalprice > 100000").drop("o_totalprice")


@query("known_items", with_views("fx_items", f"select {ITEM_SQL} from fx_items"))
def known_items(spark, sf):
    return tidy(W.world(spark, sf).items).fillna(-1, ["disp_end"])


@query("target_items", with_views("fx_targets", f"select {ITEM_SQL} from fx_targets"))
def target_items(spark, sf):
    return tidy(W.world(spark, sf).target_items).fillna(-1, ["disp_end"])


@query("required_columns_present", """select 'purchases' as table_name, count(*) as row_count from events
  where event_type = 'purchase' union all select 'users', count(*) from customer""")
def required_columns_present(spark, sf):
    w = W.world(spark, sf)
    out = None
    for name in ("purchases", "users"):
        df = T.require_columns(getattr(w, name), T.REQUIRED_COLUMNS[name], name)
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


DICTIONARY_SQL = """
raw as (select n_nationkey as o, ' ' || n_name || ' ' as jpn, 'EN ' || n_name as en from nation where n_nationkey % 5 <> 4
  union all select 100 + n_nationkey, n_name, 'LATE ' || n_name from nation where n_nationkey % 3 = 0
  union all select 200 + n_nationkey, n_name, null from nation),
pref_dict as (select src, dst from (select trim(jpn) as src, trim(en) as dst,
    row_number() over (partition by trim(jpn) order by o desc) as rn from raw where jpn is not null and en is not null) x
  where rn = 1),
genre_dict as (select distinct p_type as src, 'EN ' || p_type as dst from part where p_type <> 'SMALL'),
dict as (select 'pref' as kind, src, dst from pref_dict union all select 'genre', src, dst from genre_dict)"""


def dictionaries(spark, sf):
    """Region and genre dictionaries: blanks, repeats and gaps included, as hand-made files have them."""
    nation, part = W.star_table(spark, sf, "nation"), W.star_table(spark, sf, "part")
    key, name = F.col("n_nationkey"), F.col("n_name")
    raw = (nation.filter(key % 5 != 4).select(key.alias("o"), F.concat(F.lit(" "), name, F.lit(" ")).alias("Jpn"),
                                              F.concat(F.lit("EN "), name).alias(" EN"))
           .unionByName(nation.filter(key % 3 == 0).select((key + 100).alias("o"), name.alias("Jpn"),
                                                           F.concat(F.lit("LATE "), name).alias(" EN")))
           .unionByName(nation.select((key + 200).alias("o"), name.alias("Jpn"), F.lit(None).cast("string").alias(" EN"))))
    genres = part.filter("p_type <> 'SMALL'").select(F.col("p_type").alias("src")).distinct().select(
        F.lit("genre").alias("kind"), "src", F.concat(F.lit("EN "), "src").alias("dst"))
    return T.clean_dictionary(raw, "pref", "o").unionByName(genres)


@query("dictionary_last_wins", f"with {DICTIONARY_SQL} select kind, src, dst from dict")
def dictionary_last_wins(spark, sf):
    return dictionaries(spark, sf)


@query("translated_items", with_views("fx_items_all", """
select item_id, genre_name, pref_name, coalesce(g.dst, genre_name) as genre_name_en, coalesce(p.dst, pref_name) as pref_name_en
from fx_items_all i left join dict g on g.kind = 'genre' and g.src = i.genre_name
left join dict p on p.kind = 'pref' and p.src = i.pref_name""", DICTIONARY_SQL))
def translated_items(spark, sf):
    items = W.all_items_view(spark, sf).select("item_id", "genre_name", "pref_name")
    return C.translate(items, {"genre_name": "genre", "pref_name": "pref", "small_area_name": "small_area"},
                       dictionaries(spark, sf))


def _report_sql(table: str, relation: str, column: str, kind: str) -> str:
    return f"""select '{table}' as table_name, '{column}' as column_name, count(d.dst) as translated_rows,
      count(r.{column}) as total_non_null, count(distinct case when d.dst is null then r.{column} end) as unmatched_unique
      from {relation} r left join dict d on d.kind = '{kind}' and d.src = r.{column}"""


@query("translation_report", with_views("fx_users fx_items fx_targets", " union all ".join([
    _report_sql("items", "fx_items", "genre_name", "genre"), _report_sql("items", "fx_items", "pref_name", "pref"),
    _report_sql("target_items", "fx_targets", "genre_name", "genre"),
    _report_sql("target_items", "fx_targets", "pref_name", "pref"), _report_sql("users", "fx_users", "pref_name", "pref"),
]), DICTIONARY_SQL))
def translation_report(spark, sf):
    w = W.world(spark, sf)
    tables = {"items": w.items, "target_items": w.target_items, "users": w.users, "purchases": w.purchases}
    return C.translation_report(tables, TRANSLATION_FIELDS, dictionaries(spark, sf), {"genre", "pref"})


@query("unmatched_values", with_views("fx_users", """
select distinct pref_name as value from fx_users where pref_name not in (select src from dict where kind = 'pref')
order by value limit 10""", DICTIONARY_SQL))
def unmatched_values(spark, sf):
    return C.unmatched_values(W.users_view(spark, sf), "pref_name", "pref", dictionaries(spark, sf))


@query("table_profile", """
select 'customer' as table_name, count(*) as row_count, cast(5 as bigint) as column_count,
  'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as column_names, 'bigint,string,int,double,string' as column_types
from customer union all
select 'part', count(*), cast(6 as bigint), 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice', 'bigint,string,string,string,int,double'
from part""")
def table_profile(spark, sf):
    return P.table_profile({n: W.star_table(spark, sf, n) for n in ("customer", "part")})


@query("null_counts", with_views("fx_items_all", """select column_name, cast(n as bigint) as null_count from (
  select 'disp_end' as column_name, count(*) - count(disp_end) as n from fx_items_all union all
  select 'disp_from', count(*) - count(disp_from) from fx_items_all union all
  select 'genre_name', count(*) - count(genre_name) from fx_items_all) x where n > 0"""))
def null_counts(spark, sf):
    return P.null_counts(W.all_items_view(spark, sf))


@query("preview_purchases", with_views("fx_purchases", """select event_id, user_id, item_id, epoch_us(ts) as ts from fx_purchases
  order by event_id limit 5"""))
def preview_purchases(spark, sf):
    return tidy(P.preview(W.purchases_view(spark, sf), 5, [F.col("event_id")]))


@query("purchases_per_user_summary", with_views("fx_lines", """
select count(*) as count, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as min,
  quantile_cont(n, 0.25) as p25, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.75) as p75, max(n) as max
from (select user_id, count(*) as n from fx_lines group by user_id) x"""))
def purchases_per_user_summary(spark, sf):
    return tidy(P.group_size_summary(W.order_lines_view(spark, sf), "user_id"))


@query("region_by_sex_crosstab", with_views("fx_users", """select pref_name,
  count(*) filter (sex_id = 'A') as "sex_id_A", count(*) filter (sex_id = 'B') as "sex_id_B",
  count(*) filter (sex_id = 'F') as "sex_id_F", count(*) filter (sex_id = 'H') as "sex_id_H",
  count(*) filter (sex_id = 'M') as "sex_id_M" from fx_users group by pref_name"""))
def region_by_sex_crosstab(spark, sf):
    return P.crosstab(W.users_view(spark, sf), "pref_name", "sex_id", ["A", "B", "F", "H", "M"])


@query("event_type_counts", "select event_type, count(*) as rows from events group by event_type")
def event_type_counts(spark, sf):
    return P.value_counts(W.star_table(spark, sf, "events"), "event_type")


@query("unique_counts", with_views("fx_lines", """select count(*) as events, count(distinct (user_id, item_id)) as unique_pairs,
  count(distinct user_id) as users from fx_lines"""))
def unique_counts(spark, sf):
    return tidy(P.unique_counts(W.order_lines_view(spark, sf)))


@query("parsed_times", """select o_orderkey, case when o_orderkey % 7 = 0 then -1
  else epoch_us(cast(cast(o_orderdate as date) as timestamp)) end as placed from orders""")
def parsed_times(spark, sf):
    orders = W.star_table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tidy(C.parse_time(orders.select("o_orderkey", text.alias("placed")), ["placed"], fmt="yyyy-MM-dd")).fillna(
        -1, ["placed"])


@query("numbers_or_null", """select p_partkey, case when p_partkey % 9 = 0 then null else cast(p_size as double) end as size_text,
  cast(null as double) as weight from part""")
def numbers_or_null(spark, sf):
    part = W.star_table(spark, sf, "part")
    text = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return C.to_number(part.select("p_partkey", text.alias("size_text")), ["size_text", "weight"])


@query("rows_with_keys", """select o_orderkey, case when o_orderkey % 10 <> 0 then o_custkey end as user_id from orders
  where o_orderkey % 10 <> 0 and o_custkey is not null""")
def rows_with_keys(spark, sf):
    orders = W.star_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("user_id"))
    return C.drop_null_keys(orders, ["user_id"])


@query("first_purchase_per_user", with_views("fx_lines", """select user_id, item_id, epoch_us(ts) as ts from (
  select *, row_number() over (partition by user_id order by ts, item_id) as rn from fx_lines) x where rn = 1"""))
def first_purchase_per_user(spark, sf):
    return tidy(C.dedupe_first(W.order_lines_view(spark, sf), ["user_id"], [F.col("ts"), F.col("item_id")]).select(
        "user_id", "item_id", "ts"))


@query("referential_filter", """select f.event_id, f.user_id, f.item_id from (
  select event_id, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 25 as item_id from events) f
  where user_id in (select c_custkey from customer) and item_id in (select p_partkey from part)""")
def referential_filter(spark, sf):
    facts = W.facts_view(spark, sf).select("event_id", "user_id", (F.col("item_id") * 25).alias("item_id"))
    items = W.star_table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    return C.referential_filter(facts, W.users_view(spark, sf), items).select("event_id", "user_id", "item_id")


@query("event_ids", with_views("fx_events", "select event_id, cast(positive_event_id as bigint) as positive_event_id from fx_events"))
def event_ids(spark, sf):
    return C.assign_event_id(W.purchases_view(spark, sf), "event_id").select("event_id", "positive_event_id")


@query("age_buckets", with_views("fx_users", """select user_id, cast(age as bigint) as age, case when age <= 19 then '<20'
  when age <= 29 then '20-29' when age <= 39 then '30-39' when age <= 49 then '40-49' when age <= 59 then '50-59'
  when age is not null then '60+' end as age_bucket from fx_users"""))
def age_buckets(spark, sf):
    return tidy(C.with_age_bucket(W.users_view(spark, sf)).select("user_id", "age", "age_bucket"))


@query("price_features", with_views("fx_priced", """select item_id, round(discount_amount, 6) as discount_amount,
  round(discount_ratio, 6) as discount_ratio, round(log_catalog_price, 6) as log_catalog_price,
  round(log_discount_price, 6) as log_discount_price from fx_priced"""))
def price_features(spark, sf):
    return tidy(C.with_price_features(W.all_items_view(spark, sf)).select(
        "item_id", "discount_amount", "discount_ratio", "log_catalog_price", "log_discount_price"))


@query("display_days", with_views("fx_priced", "select item_id, round(display_days, 6) as display_days from fx_priced"))
def display_days(spark, sf):
    return tidy(C.with_display_days(W.all_items_view(spark, sf)).select("item_id", "display_days"))


@query("calendar_parts", with_views("fx_items_all", """select item_id, year(disp_from) as disp_year, month(disp_from) as disp_month,
  cast(isodow(disp_from) - 1 as bigint) as disp_weekday, day(disp_from) as disp_day from fx_items_all"""))
def calendar_parts(spark, sf):
    return tidy(C.with_calendar_parts(W.all_items_view(spark, sf)).select(
        "item_id", "disp_year", "disp_month", "disp_weekday", "disp_day"))


@query("clean_items", with_views("fx_priced", """select item_id, genre_name, price_rate, round(discount_price, 6) as discount_price,
  cast(valid_period as double) as valid_period, cast(null as double) as disp_period, round(discount_ratio, 6) as discount_ratio,
  round(display_days, 6) as display_days, month(disp_from) as disp_month, 'train' as item_split from fx_priced"""))
def clean_items(spark, sf):
    return tidy(C.clean_items(W.all_items_view(spark, sf), "train").select(
        "item_id", "genre_name", "price_rate", "discount_price", "valid_period", "disp_period", "discount_ratio",
        "display_days", "disp_month", "item_split"))


@query("renamed_and_tagged", with_views("fx_items fx_targets", """
select item_id, pref_name as item_pref_name, 'train' as item_split from fx_items
union all select item_id, pref_name, 'test' from fx_targets"""))
def renamed_and_tagged(spark, sf):
    w = W.world(spark, sf)
    return C.with_split(w.items, "train").unionByName(C.with_split(w.target_items, "test")).select(
        "item_id", F.col("pref_name").alias("item_pref_name"), "item_split")


@query("finite_ratios", """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, round(l_extendedprice / nullif(l_tax, 0), 6) as per_tax
  from lineitem""")
def finite_ratios(spark, sf):
    rows = W.star_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax")
    ratio = X.null_if_infinite(X.safe_ratio(F.col("l_extendedprice"), F.col("l_tax")))
    return tidy(rows.select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("per_tax")))


@query("missing_markers", """select event_id, coalesce(case when event_type <> 'error' then event_type end, '__MISSING__') as event_type
  from events""")
def missing_markers(spark, sf):
    events = W.star_table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return C.missing_marker(events, ["event_type"])


@query("price_bands", with_views("fx_priced", """select item_id, cast(case when x <= 5.5 then 0 when x <= 6.5 then 1
  when x <= 7.5 then 2 when x <= 8.5 then 3 else 4 end as bigint) as price_band from (
  select item_id, coalesce(log_discount_price, (select median(log_discount_price) from fx_priced), 0) as x from fx_priced) y"""))
def price_bands(spark, sf):
    return tidy(sampling_index(C.with_price_features(W.all_items_view(spark, sf))).select("item_id", "price_band"))
