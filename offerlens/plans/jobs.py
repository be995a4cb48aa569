"""Whole runs: the weekly model from tables to submissions and a report, and the event-time comparison with its refit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.constants import TOP_K
from offerlens.functions.exprs import ts_lit
from offerlens.operators import audit as Q
from offerlens.operators import candidates as CA
from offerlens.operators import clean as C
from offerlens.operators import encode as E
from offerlens.operators import features as FE
from offerlens.operators import history as H
from offerlens.operators import metrics as V
from offerlens.operators import models as M
from offerlens.operators import sampling as N
from offerlens.operators import scoring as SC
from offerlens.operators import split as S
from offerlens.operators.topk import top_k
from offerlens.session import materialized
from offerlens.sources import sinks
from offerlens.sources.views import World


@dataclass(frozen=True)
class WeeklyRun:
    """The results of a weekly run: a report row, the final lists (method, user, item, score, rank), model and codes."""

    report: DataFrame
    ranked: DataFrame
    model: PipelineModel
    codes: DataFrame


def _rank_by_model(users: DataFrame, pool: DataFrame, ctx: H.Context, cutoff_us: int, model: PipelineModel,
                   codes: DataFrame) -> DataFrame:
    pairs = CA.pool_pairs(users.select("user_id"), pool.select("item_id")).withColumn("cutoff", ts_lit(cutoff_us))
    scored = M.probability(model, FE.pair_features(pairs, users, pool, ctx, codes))
    return top_k(scored.select("user_id", "item_id", "score"), ["user_id"], F.col("score"), TOP_K, [F.col("item_id")])


def _rank_by_factors(users: DataFrame, pool: DataFrame, model: M.Factorization) -> DataFrame:
    return M.factor_top(users, pool, model, TOP_K, digits=12)[0]


def weekly_run(w: World, trees: int = 160, max_users: int | None = None, factor_epochs: int = 20) -> WeeklyRun:
    """Train on all weeks but the last, measure on the last, refit with it and rank the target items.

    The validation week joins the training sample only after it was measured.
    """
    users = S.limit_users(w.users, max_users) if max_users else w.users
    grid = S.week_grid(w.purchases)
    codes = materialized(E.entity_codes(w.users, w.all_items))
    pairs = materialized(N.weekly_pairs(users, w.purchases, w.items, grid, include_validation=True))
    ctx = H.weekly_context_of(pairs, w.purchases, w.visits, w.all_items, w.all_items, grid, True)
    frame = materialized(FE.pair_features(pairs.withColumn("cutoff", grid.start_of(F.col("week"))), users, w.all_items, ctx,
                                          codes))
    training = F.col("week") < grid.train_weeks
    model = M.fit_binary_gbt(frame.filter(training), codes, iterations=trees)

    pool = S.candidates_in_window(w.items, grid.val_start)
    truth = S.labels_in_window(w.purchases, grid.val_start).join(users.select("user_id"), "user_id", "left_semi")
    before = S.history_before(w.purchases, grid.val_start)
    at_val = H.cutoff_context(w.purchases, w.visits, w.all_items, grid.val_start)
    lists = SC.score_all(users, pool, at_val, grid.val_start)
    lists = lists.unionByName(_rank_by_model(users, pool, at_val, grid.val_start, model, codes).withColumn(
        "method", F.lit("boosted_trees")))
    factors = M.fit_factorization(materialized(before), epochs=factor_epochs)
    lists = lists.unionByName(_rank_by_factors(users, pool, factors).withColumn("method", F.lit("factorization")))
    maps = V.map_at_k_all_users(users, truth, materialized(lists), by=["method"])
    by_method = maps.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "map_at_k")))).alias("map_at_10"))

    def size(df: DataFrame, condition: str = "true"):
        return df.agg(F.count(F.when(F.expr(condition), 1)).alias("n")).scalar()

    def day(us: int):
        return F.date_format(ts_lit(us), "yyyy-MM-dd")

    weeks = grid.train_weeks
    report = by_method.select(
        day(grid.first_start).alias("first_train_week"), day(grid.train_starts[-1]).alias("last_train_week"),
        F.lit(weeks).alias("train_weeks"), F.lit(weeks + 1).alias("final_train_weeks"),
        day(grid.val_start).alias("validation_start"), size(users).alias("validation_users"),
        size(pool).alias("validation_candidates"), size(truth).alias("validation_truth_purchase_rows"),
        V.candidate_coverage(truth, pool).scalar().alias("candidate_truth_coverage"),
        V.known_item_share(pool, before).select("known_share").scalar().alias("known_candidate_fraction"), "map_at_10",
        size(frame, f"week < {weeks} and label = 1").alias("train_positive_rows"),
        size(frame, f"week < {weeks} and label = 0").alias("train_negative_rows"),
        size(frame, "label = 1").alias("final_positive_rows"), size(w.target_items).alias("target_candidates"))

    final = M.fit_binary_gbt(frame, codes, iterations=trees)
    at_end = H.cutoff_context(w.purchases, w.visits, w.all_items, grid.final_cutoff)
    ranked = SC.score_all(users, w.target_items, at_end, grid.final_cutoff).unionByName(
        _rank_by_model(users, w.target_items, at_end, grid.final_cutoff, final, codes).withColumn(
            "method", F.lit("boosted_trees")))
    return WeeklyRun(materialized(report), materialized(ranked), final, codes)


def write_weekly_run(run: WeeklyRun, template: DataFrame, folder: str) -> None:
    """Model, codes, report and one submission per method below `folder`."""
    sinks.save_model(run.model, f"{folder}/model")
    sinks.save_codes(run.codes, f"{folder}/codes")
    sinks.write_report(run.report, f"{folder}/report")
    for method in ("popularity", "rules", "boosted_trees"):
        out = sinks.submission(template, run.ranked.filter(F.col("method") == method))
        sinks.write_submission(out, f"{folder}/submission_{method}")


@dataclass(frozen=True)
class EventRun:
    """The results of an event-time run: methods by MAP, intervals against the best, checks and the final submission."""

    comparison: DataFrame
    intervals: list[DataFrame]
    checks: DataFrame
    best: str
    submission: DataFrame


def event_run(w: World, kinds: tuple[str, ...] = M.KINDS, rounds: int = 500, repeats: int = 2000,
              max_users: int | None = None) -> EventRun:
    """Split by time, sample hard negatives, train and compare the rankers on the holdout, refit the best on everything."""
    users, items = C.with_age_bucket(w.users), C.with_price_features(w.items)
    targets = C.with_price_features(w.target_items)
    tagged, bounds = S.temporal_three_way_split(C.assign_event_id(w.purchases, "event_id"))
    events = materialized(tagged)
    bought, train = H.item_sets(events), events.filter("split = 'train'")
    meta = FE.item_features(items)
    negatives = materialized(N.exclusive_hard_negatives(train, N.sampling_index(S.training_pool(items, bounds.tuning_start)), bought))
    pairs = N.training_pairs(train, negatives)
    seen = S.history_before(w.visits, bounds.tuning_start)
    frame = materialized(FE.event_time_features(pairs, users, meta, train, seen))
    checks = materialized(Q.leakage_checks(events, bounds, pairs, frame, seen, targets, bought))
    Q.require_passed(checks)

    def pool_frame(part: str, start: int, end: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        truth = H.item_sets(events.filter(F.col("split") == part))
        if max_users is not None:
            truth = truth.join(CA.sample_users(truth, max_users, seed), "user_id", "left_semi")
        truth = materialized(truth)
        past = S.history_before(events, start)
        history = H.event_history(past, S.history_before(w.visits, start), w.items)
        product = CA.full_candidate_pairs(truth, S.pool_with_truth(items, truth, start, end), max_users, seed)
        return truth, materialized(FE.cutoff_features(product, FE.user_features(users, history.user), meta, history)), past

    tuning_truth, tuning, _ = pool_frame("early_stop", bounds.tuning_start, bounds.holdout_start, 42)
    truth, holdout, past = pool_frame("holdout", bounds.holdout_start, bounds.last, 43)
    rankers = {k: M.fit_ranker(k, frame, tuning, tuning_truth, iterations=None if k in M.LOSSES else 50, rounds=rounds)
               for k in kinds}
    sold = past.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_purchases"))
    scored = holdout.join(sold, "item_id", "left").select("user_id", "item_id", F.inline(F.array(
        F.struct(F.lit("global_popularity").alias("method"), SC.global_popularity_score().alias("score")),
        F.struct(F.lit("user_preference").alias("method"), SC.preference_score().alias("score")))))
    for kind, ranker in rankers.items():
        scored = scored.unionByName(M.score_ranker(ranker, holdout).select(
            "user_id", "item_id", F.lit(kind).alias("method"), "score"))
    ap = materialized(V.evaluate(scored, truth, by=["method"]))
    best = M.select_best(ap, kinds)
    others = [m for m in (*kinds, "global_popularity", "user_preference") if m != best]
    intervals = [V.paired_bootstrap(ap, best, m, repeats, 42 + i) for i, m in enumerate(others)]

    later = events.filter("split <> 'train'")
    visits = S.history_through(w.visits, events)
    everything = materialized(N.refit_pairs(events, negatives, later, N.sampling_index(items), bought))
    final = M.refit(rankers[best], materialized(FE.event_time_features(everything, users, meta, events, visits)))
    history = H.event_history(events, visits, w.items)
    people, offers = FE.user_features(users, history.user), FE.item_features(targets)
    rows = FE.cutoff_features(M.target_pairs(final, w.template, targets, people, offers, history), people, offers, history)
    ranked = materialized(V.rank_predictions(M.score_ranker(final, rows)))
    sinks.require_few_missing(w.template, ranked)
    fallback = H.genre_popularity_rank(w.purchases, w.items, w.target_items)
    kinds_of = {"global_popularity": "baseline", "user_preference": "baseline"}
    return EventRun(V.compare_methods(ap, kinds_of), intervals, checks, best,
                    sinks.submission_with_fallback(w.template, ranked, fallback))
