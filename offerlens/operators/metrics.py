"""Average precision at k and what is built on it.

Two metrics share a name and stay apart: map_at_k_all_users cuts a list first and divides by all users; per_user_ap
removes repeats first and knows truth users only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions.constants import BOOTSTRAP_REPEATS, TOP_K
from offerlens.functions.exprs import DRAW_FACTORS, DRAW_MODULUS, DRAW_MULTIPLIER, DRAW_SHIFT
from offerlens.operators.topk import top_k_distinct

BETTER, TIED, EVALUATED_ON = "reference ahead", "no clear difference", "holdout, whole pool"


def _precision_sum(ranked: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per list: sum of hits-so-far / rank over its hits.  Lists hold at most k rows here."""
    labels = truth.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    hits = ranked.join(labels, ["user_id", "item_id"])
    so_far = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    return hits.select(*keys, (so_far / F.col("rank")).alias("gain")).groupBy(*keys).agg(F.sum("gain").alias("gain"))


def _truth_sizes(truth: DataFrame, k: int) -> DataFrame:
    return truth.select("user_id", "item_id").distinct().groupBy("user_id").agg(
        F.least(F.count(F.lit(1)), F.lit(k)).alias("depth"))


def map_at_k_all_users(users: DataFrame, truth: DataFrame, ranked: DataFrame, k: int = TOP_K,
                       by: list[str] | None = None) -> DataFrame:
    """MAP@k over all users: the list is cut to k, a repeated item keeps its rank but counts once, users without
    truth score 0 and stay in the denominator.  `by` adds columns such as the method."""
    by = by or []
    # Only hits count, and few rows of the lists are hits.
    hits = ranked.filter(F.col("rank") <= k).join(truth.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    cut = hits.groupBy(*by, "user_id", "item_id").agg(F.min("rank").alias("rank"))
    cut = cut.join(users.select("user_id").distinct(), "user_id", "left_semi")
    gains = _precision_sum(cut, truth, [*by, "user_id"]).join(_truth_sizes(truth, k), "user_id")
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    ap = F.sum(F.col("gain") / F.col("depth"))
    if not by:
        return gains.agg((F.coalesce(ap, F.lit(0.0)) / total).alias("map_at_k"))
    methods = ranked.select(*by).distinct()
    return methods.join(gains.groupBy(*by).agg(ap.alias("_ap")), by, "left").select(
        *by, (F.coalesce("_ap", F.lit(0.0)) / total).alias("map_at_k"))


def per_user_ap(truth: DataFrame, ranked: DataFrame, k: int = TOP_K, by: list[str] | None = None) -> DataFrame:
    """AP@k per truth user: repeats are removed before the cut; a truth user without a list scores 0."""
    by = by or []
    keys = [*by, "user_id"]
    known = ranked.join(truth.select("user_id").distinct(), "user_id", "left_semi")
    first = known.groupBy(*keys, "item_id").agg(F.min("rank").alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "item_id"))
    cut = first.withColumn("rank", place).filter(F.col("rank") <= k)
    gains = _precision_sum(cut, truth, keys)
    sizes = _truth_sizes(truth, k)
    if by:
        methods = F.array_sort(F.collect_set(F.struct(*by)))
        sizes = sizes.select("user_id", "depth", F.inline(ranked.select(*by).distinct().agg(methods.alias("m")).scalar()))
    return sizes.join(gains, keys, "left").select(
        *keys, (F.coalesce("gain", F.lit(0.0)) / F.col("depth")).alias("ap"))


def mapk(ap: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean AP over truth users."""
    return ap.groupBy(*(by or [])).agg(F.avg("ap").alias("map_at_k"))


def rank_predictions(scored: DataFrame, k: int = TOP_K, by: list[str] | None = None) -> DataFrame:
    """Distinct ranked items per user from scored rows."""
    return top_k_distinct(scored, [*(by or []), "user_id"], "item_id", "score", k)


def evaluate(scored: DataFrame, truth: DataFrame, k: int = TOP_K, by: list[str] | None = None) -> DataFrame:
    """AP per truth user of scored rows."""
    return per_user_ap(truth, rank_predictions(scored, k, by), k, by)


def ap_deltas(ap: DataFrame, reference: str, challenger: str) -> DataFrame:
    """Per user AP(reference) - AP(challenger), users known to both methods."""
    both = ap.filter(F.col("method").isin(reference, challenger)).groupBy("user_id").agg(
        F.max(F.when(F.col("method") == reference, F.col("ap"))).alias("r"),
        F.max(F.when(F.col("method") == challenger, F.col("ap"))).alias("c"))
    return both.filter("r is not null and c is not null").select("user_id", (F.col("r") - F.col("c")).alias("delta"))


DRAWS_A_ROW = 1 << 20


def _places(replicate: np.ndarray, number: np.ndarray, users: int, seed: int) -> np.ndarray:
    """The user, by place, of each draw: an integer hash of replicate and draw, mixed twice; the same in any engine."""
    def mixed(a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
        h = (a * DRAW_FACTORS[0] + b * DRAW_FACTORS[1] + own * DRAW_FACTORS[3]) % DRAW_MODULUS
        return (h * h + h * DRAW_MULTIPLIER + DRAW_SHIFT) % DRAW_MODULUS

    return mixed(mixed(replicate, number % DRAW_MODULUS, seed), replicate, seed + 1) % users


def paired_bootstrap(ap: DataFrame, reference: str, challenger: str, repeats: int = BOOTSTRAP_REPEATS,
                     seed: int = 42) -> DataFrame:
    """Mean AP difference with a 95 % interval from `repeats` resamples of as many users as there are, with replacement.

    Users with the same difference are interchangeable: a draw is a place among the users in order of their differences, found
    among the counts of the distinct ones.  AP@k takes few values, so that table stays small however many users there
    are; the draws are spread over tasks in rows of `DRAWS_A_ROW`, and a row gives one sum.
    """
    counted = ap_deltas(ap, reference, challenger).groupBy(F.round("delta", 12).alias("delta")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("delta").toArrow()
    spark = ap.sparkSession
    delta, upto = counted["delta"].to_numpy(), np.cumsum(counted["n"].to_numpy())
    users = int(upto[-1]) if len(upto) else 0
    parts = max(1, -(-users // DRAWS_A_ROW))
    known = spark.sparkContext.broadcast((delta, upto))

    def drawn(batches):
        delta, upto = known.value
        for b in batches:
            ids = b.column(0).to_numpy()
            sums = []
            for i in ids.tolist():
                replicate, part = divmod(i, parts)
                number = np.arange(part * DRAWS_A_ROW, min((part + 1) * DRAWS_A_ROW, users), dtype=np.int64)
                place = _places(np.full(len(number), replicate, np.int64), number, users, seed)
                sums.append(float(delta[np.searchsorted(upto, place, "right")].sum()))
            yield pa.RecordBatch.from_pydict({"replicate": ids // parts, "s": np.array(sums)})

    draws = spark.range(repeats * parts if users else 0).mapInArrow(drawn, "replicate bigint, s double").groupBy("replicate").agg(
        (F.sum("s") / F.lit(users)).alias("mean"))
    # One number per replicate is left; its percentiles are exact.
    ci = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    mean = float((delta * counted["n"].to_numpy()).sum() / users) if users else None
    return draws.agg(ci.alias("ci")).filter("ci is not null").select(
        F.lit(reference).alias("reference"), F.lit(challenger).alias("challenger"), F.lit(mean).cast("double").alias("mean_ap_delta"),
        F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"),
        F.when(F.col("ci")[0] > 0, BETTER).otherwise(TIED).alias("conclusion"))


def bootstrap_table(ap: DataFrame, reference: str, repeats: int = BOOTSTRAP_REPEATS, seed: int = 42) -> DataFrame:
    """paired_bootstrap of the reference against every other method of `ap`, the methods in order of their names."""
    methods = sorted(r.method for r in ap.select("method").distinct().collect() if r.method != reference)
    out = None
    for i, m in enumerate(methods):
        row = paired_bootstrap(ap, reference, m, repeats, seed + i)
        out = row if out is None else out.unionByName(row)
    return out if out is not None else paired_bootstrap(ap, reference, reference, repeats, seed).limit(0)


def compare_methods(ap: DataFrame, kinds: dict[str, str], split: str = EVALUATED_ON) -> DataFrame:
    """Methods by MAP, best first."""
    kind = F.lit("ranker")
    for method, name in kinds.items():
        kind = F.when(F.col("method") == method, name).otherwise(kind)
    return ap.groupBy("method").agg(F.avg("ap").alias("map_at_k"), F.count(F.lit(1)).alias("users")).select(
        "method", kind.alias("kind"), "map_at_k", "users", F.lit(split).alias("evaluation_split")).orderBy(
        F.desc("map_at_k"), "method")


def candidate_coverage(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of truth rows whose item is a candidate (0 without truth)."""
    by_item = truth.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    known = candidates.select("item_id").distinct().withColumn("hit", F.lit(1))
    rows = by_item.join(known, "item_id", "left")
    return rows.agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0))
                    .alias("coverage"))


def known_item_share(candidates: DataFrame, purchases: DataFrame) -> DataFrame:
    """Share of candidates with earlier purchases."""
    bought = purchases.select("item_id").distinct().withColumn("hit", F.lit(1))
    return candidates.join(bought, "item_id", "left").agg(
        F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("known"),
        (F.count("hit") / F.count(F.lit(1))).alias("known_share"))
