"""Queries with trained scorers: boosted trees, factorization, rankers.  Trees differ between engines, so most of them are
checked by their rows and by invariants; preparation steps have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions.constants import PAIR_FEATURES
from offerlens.operators import encode as E
from offerlens.operators import features as FE
from offerlens.operators import history as H
from offerlens.operators import metrics as V
from offerlens.operators import models as M
from offerlens.operators import requests as R
from offerlens.operators import sampling as N
from offerlens.operators import scoring as SC
from offerlens.operators import split as S
from offerlens.operators.numbering import column_medians
from offerlens.operators.topk import top_k
from offerlens.plans import serving
from offerlens.plans.events import (
    EVAL_SQL, NAMES, TRAIN_SQL, baseline_scores, evaluation, event_frame, event_world, train_negatives, train_pairs)
from offerlens.plans.ranking import validation_setup, validation_truth, weekly_frame
from offerlens.plans.registry import query, tidy
from offerlens.plans.sql import with_views
from offerlens.session import materialized
from offerlens.sources import views as W


def training_frame(spark, sf):
    w = event_world(spark, sf)
    return w, materialized(event_frame(w, train_pairs(w)))


@query("exact_medians", """
select 'l_extendedprice' as column_name, round(quantile_cont(l_extendedprice, 0.5), 6) as median from lineitem union all
select 'l_quantity', round(quantile_cont(l_quantity, 0.5), 6) from lineitem union all
select 'l_discount', round(quantile_cont(l_discount, 0.5), 6) from lineitem""")
def exact_medians(spark, sf):
    """Exact medians of several columns of the large fact in two passes."""
    lines = W.star_table(spark, sf, "lineitem")
    medians = column_medians(lines, ["l_extendedprice", "l_quantity", "l_discount"])
    one = lines.select(F.lit(1)).limit(1)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("median")) for c, m in medians.items()])
    return tidy(one.select(F.inline(cells)))


@query("preprocessor_codes", with_views(NAMES, """
select kind, value, row_number() over (partition by kind order by value) as code from (
  select distinct 'genre_name' as kind, coalesce(i.genre_name, '__MISSING_GENRE__') as value from tpairs join fx_items i using (item_id)
  union select 'capsule_text', coalesce(capsule_text, '__MISSING__') from tpairs join fx_items i using (item_id)
  union select 'item_pref_name', coalesce(pref_name, '__MISSING_PREF__') from tpairs join fx_items i using (item_id)
  union select 'sex_id', coalesce(sex_id, '__MISSING__') from tpairs join fx_users u using (user_id)
  union select 'user_pref_name', coalesce(pref_name, '__MISSING__') from tpairs join fx_users u using (user_id)
  union select 'age_bucket', case when age <= 19 then '<20' when age <= 29 then '20-29' when age <= 39 then '30-39'
    when age <= 49 then '40-49' when age <= 59 then '50-59' else '60+' end from tpairs join fx_users u using (user_id)) x""", TRAIN_SQL))
def preprocessor_codes(spark, sf):
    return tidy(E.fit_preprocessor(training_frame(spark, sf)[1]).codes)


@query("preprocessor_fills", with_views(NAMES, """
select 'user_purchase_count' as column_name, cast(quantile_cont(n, 0.5) as double) as fill from eframe union all
select 'user_view_count', cast(quantile_cont(v, 0.5) as double) from eframe union all
select 'user_avg_purchase_price', round(quantile_cont(ps / nullif(n, 0), 0.5) + 3.7e-9, 6) from eframe union all
select 'price_gap', round(quantile_cont(abs(dp - ps / nullif(n, 0)), 0.5) + 3.7e-9, 6) from eframe union all
select 'user_genre_view_ratio', round(quantile_cont(gv / nullif(v, 0), 0.5) + 3.7e-9, 6) from eframe""", TRAIN_SQL))
def preprocessor_fills(spark, sf):
    prep = E.fit_preprocessor(training_frame(spark, sf)[1])
    shown = ["user_purchase_count", "user_view_count", "user_avg_purchase_price", "price_gap", "user_genre_view_ratio"]
    shift = {"user_avg_purchase_price", "price_gap", "user_genre_view_ratio"}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(prep.fills[c] + (3.7e-9 if c in shift else 0.0)).alias("fill"))
                      for c in shown])
    return tidy(prep.codes.select(F.lit(1)).limit(1).select(F.inline(cells)))


@query("model_matrix", with_views(NAMES, """
select q.positive_event_id, q.user_id, q.item_id, q.label, cast(dense_rank() over (order by coalesce(g, '__MISSING_GENRE__')) as bigint)
  as genre_name, cast(coalesce(n, 0) as double) as user_purchase_count,
  round(cast(cast(coalesce(ps / nullif(n, 0), (select quantile_cont(ps / nullif(n, 0), 0.5) from eframe)) as float) as double), 1)
    as user_avg_purchase_price
from eframe q""", TRAIN_SQL))
def model_matrix(spark, sf):
    """Codes and filled numbers of the training frame (three of its columns are shown)."""
    _, frame = training_frame(spark, sf)
    out = E.transform_numeric(frame, E.fit_preprocessor(frame))
    return tidy(out.select("positive_event_id", "user_id", "item_id", "label", "genre_name", "user_purchase_count",
                           F.round(F.col("user_avg_purchase_price").cast("double"), 1).alias("user_avg_purchase_price")))


@query("raw_category_matrix", with_views(NAMES, """
select positive_event_id, user_id, item_id, coalesce(g, '__MISSING_GENRE__') as genre_name, coalesce(ip, '__MISSING_PREF__') as item_pref_name,
  cast(v as double) as user_view_count from eframe""", TRAIN_SQL))
def raw_category_matrix(spark, sf):
    _, frame = training_frame(spark, sf)
    out = E.transform_raw_categories(frame, E.fit_preprocessor(frame))
    return tidy(out.select("positive_event_id", "user_id", "item_id", "genre_name", "item_pref_name", "user_view_count"))


def weekly_model(spark, sf, include_validation=False):
    w, grid, frame, codes = weekly_frame(spark, sf, include_validation)
    return w, grid, codes, M.fit_binary_gbt(materialized(frame), codes)


def gbt_ranking(spark, sf, w, model, codes, ctx, pool, cutoff_us):
    """Every user's ten best pool items by the model: the whole product is scored, ten rows per user leave a task."""
    rows = FE.product_features(w.users.withColumn("cutoff", FE.X.ts_lit(cutoff_us)), pool, ctx, codes)
    scored = M.probability(model, rows)
    return top_k(scored.select("user_id", "item_id", F.round("score", 6).alias("score")), ["user_id"], F.col("score"), 10,
                 [F.col("item_id")])


@query("boosted_trees_top10")
def boosted_trees_top10(spark, sf):
    """Binary boosted trees on the weekly frame, ranked over the validation candidates."""
    w, _, codes, model = weekly_model(spark, sf)
    _, grid, ctx, pool = validation_setup(spark, sf)
    return tidy(gbt_ranking(spark, sf, w, model, codes, ctx, pool, grid.val_start))


@query("boosted_trees_map10")
def boosted_trees_map10(spark, sf):
    w, _, codes, model = weekly_model(spark, sf)
    _, grid, ctx, pool = validation_setup(spark, sf)
    ranked = gbt_ranking(spark, sf, w, model, codes, ctx, pool, grid.val_start)
    return tidy(V.map_at_k_all_users(w.users, validation_truth(w, grid), ranked))


@query("boosted_trees_importance")
def boosted_trees_importance(spark, sf):
    _, _, _, model = weekly_model(spark, sf, include_validation=True)
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(PAIR_FEATURES, values)]
    return tidy(spark.createDataFrame(rows, "feature string, importance double"))


@query("factorization_mean", with_views("fx_lines", """
select round(avg(r), 6) as mean_rating, count(*) as ratings from (select ln(1 + count(*)) as r from fx_lines group by user_id, item_id) x"""))
def factorization_mean(spark, sf):
    """The ratings a factorization starts from."""
    ratings = W.order_lines_view(spark, sf).groupBy("user_id", "item_id").agg(F.log1p(F.count(F.lit(1))).alias("r"))
    return tidy(ratings.agg(F.avg("r").alias("mean_rating"), F.count(F.lit(1)).alias("ratings")))


def factorization(spark, sf):
    """A factorization of the purchases before the validation week, the users and the week's candidates."""
    w = W.world(spark, sf)
    grid = S.week_grid(w.purchases)
    model = M.fit_factorization(materialized(S.history_before(w.purchases, grid.val_start)))
    return M.factor_top(w.users, S.candidates_in_window(w.items, grid.val_start), model)


@query("factorization_top10")
def factorization_top10(spark, sf):
    """Biased factorization ranked over the validation candidates, through bounds and not through the product."""
    return tidy(factorization(spark, sf)[0])


@query("all_methods_map10")
def all_methods_map10(spark, sf):
    """The validation week by all four methods: rules, popularity, factorization and boosted trees side by side."""
    w, _, codes, model = weekly_model(spark, sf)
    _, grid, ctx, pool = validation_setup(spark, sf)
    columns = ["method", "user_id", "item_id", "rank"]
    lists = SC.score_all(w.users, pool, ctx, grid.val_start, digits=6).select(*columns)
    for method, ranked in (("boosted_trees", gbt_ranking(spark, sf, w, model, codes, ctx, pool, grid.val_start)),
                           ("factorization", factorization(spark, sf)[0])):
        lists = lists.unionByName(ranked.withColumn("method", F.lit(method)).select(*columns))
    return tidy(V.map_at_k_all_users(w.users, validation_truth(w, grid), materialized(lists), by=["method"]))


@query("ranked_requests_by_model")
def ranked_requests_by_model(spark, sf):
    """Every customer's request answered by the trained trees where the request leaves the method open."""
    w, _, codes, model = weekly_model(spark, sf, include_validation=True)
    _, grid, requests = serving.setup(spark, sf)
    ctx = H.cutoff_context(w.purchases, w.visits, w.all_items, grid.final_cutoff)
    ranked, _ = R.rank_requests(requests, w.users, w.all_items, w.target_items, ctx, grid.final_cutoff, grid.final_cutoff, codes,
                                lambda rows: M.probability(model, rows))
    return tidy(ranked)


@query("factorization_work")
def factorization_work(spark, sf):
    """How many user-item pairs the bounds leave to be scored."""
    scored = factorization(spark, sf)[1]
    return tidy(scored.agg(F.count(F.lit(1)).alias("users"), F.sum("scored").alias("pairs_scored")))


def fitted(spark, sf, kind: str):
    """A ranker with the rounds of a full run; the boosted ones take their number of trees from the tuning pool."""
    w, frame = training_frame(spark, sf)
    if kind not in M.LOSSES:
        return w, frame, M.fit_ranker(kind, frame)
    e = evaluation(w, "early_stop")
    return w, frame, M.fit_ranker(kind, frame, e.frame, e.truth)


def _ranker_query(kind: str):
    @query(f"{kind}_ranker_ap")
    def run(spark, sf):
        w, _, ranker = fitted(spark, sf, kind)
        e = evaluation(w, "holdout")
        return tidy(V.evaluate(M.score_ranker(ranker, e.frame), e.truth))
    return run


boosted_ranker_ap, lambda_ranker_ap, pairwise_ranker_ap, forest_ranker_ap = (_ranker_query(k) for k in M.KINDS)


@query("tuned_tree_count")
def tuned_tree_count(spark, sf):
    """The number of trees chosen by MAP on the tuning pool."""
    _, frame, ranker = fitted(spark, sf, "boosted")
    return frame.agg(F.count(F.lit(1)).alias("training_rows")).withColumn("trees", F.lit(ranker.iterations).cast("bigint"))


@query("ranker_importance")
def ranker_importance(spark, sf):
    _, _, ranker = fitted(spark, sf, "forest")
    return tidy(M.feature_importance(ranker, spark))


@query("ranker_comparison")
def ranker_comparison(spark, sf):
    """A trained ranker beside the untrained baselines on the holdout, best first."""
    w, _, ranker = fitted(spark, sf, "pairwise")
    e = evaluation(w, "holdout")
    scored = M.score_ranker(ranker, e.frame).select(F.lit("pairwise").alias("method"), "user_id", "item_id", "score")
    ap = V.evaluate(scored.unionByName(baseline_scores(e)), e.truth, by=["method"])
    return tidy(V.compare_methods(ap, {"global_popularity": "baseline", "user_preference": "baseline"}))


@query("refit_top10_targets")
def refit_top10_targets(spark, sf):
    """The final refit on every event with negatives added for the later ones, then all target items ranked for all users."""
    w = event_world(spark, sf)
    pairs = materialized(N.refit_pairs(w.events, train_negatives(w), w.events.filter("split <> 'train'"),
                                       N.sampling_index(w.items), w.bought))
    visits = S.history_through(w.visits, w.events)
    frame = materialized(FE.event_time_features(pairs, w.users, FE.item_features(w.items), w.events, visits))
    ranker = M.fit_ranker("pairwise", frame, iterations=50)
    history = H.event_history(w.events, visits, w.items)
    people, offers = FE.user_features(w.users, history.user), FE.item_features(w.targets)
    pairs = M.target_pairs(ranker, w.users, w.targets, people, offers, history)
    rows = FE.cutoff_features(pairs, people, offers, history)
    return tidy(V.rank_predictions(M.score_ranker(ranker, rows)))


@query("evaluation_query_sizes", with_views(NAMES, "select user_id as query_id, count(*) as group_size from epairs group by 1", EVAL_SQL))
def evaluation_query_sizes(spark, sf):
    return tidy(E.group_sizes(evaluation(event_world(spark, sf), "holdout").pairs))
