"""Data-quality checks; each is one small aggregate, and together they make one table (check, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions.constants import NON_FEATURES, SHARED_HISTORY, SOURCE_POSITIVE
from offerlens.functions.exprs import ts_lit
from offerlens.operators.history import constant_in_group
from offerlens.operators.split import SplitBounds


def negative_conflicts(negatives: DataFrame, bought: DataFrame) -> DataFrame:
    """How many negatives the user did buy."""
    return negatives.join(bought.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").agg(
        F.count(F.lit(1)).alias("conflicts"))


# The checks of leakage_checks in their order.
LEAKAGE_CHECKS = ("events_of_later_parts_left_out", "history_older_than_event", "one_history_for_an_event", "visits_older_than_tuning",
                  "parts_follow_in_time", "labels_agree_with_source", "region_leaves_label_open", "targets_never_labelled",
                  "negatives_never_bought", "positives_all_present")


def _check(df: DataFrame, name: str, passed: Column, otherwise: bool = False) -> DataFrame:
    """One row; `otherwise` is the verdict where there is nothing to judge."""
    return df.agg(F.coalesce(passed, F.lit(otherwise)).alias("passed")).select(F.lit(name).alias("check_name"), "passed")


def _none(df: DataFrame, name: str) -> DataFrame:
    return _check(df, name, F.count(F.lit(1)) == 0)


def _ordered(events: DataFrame) -> DataFrame:
    spans = events.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))

    def of(split: str, c: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(c)))

    return _check(spans, LEAKAGE_CHECKS[4],
                  (of("train", "hi") < of("early_stop", "lo")) & (of("early_stop", "hi") < of("holdout", "lo")))


def leakage_checks(events: DataFrame, bounds: SplitBounds, pairs: DataFrame, frame: DataFrame, history_visits: DataFrame,
                   targets: DataFrame, bought: DataFrame) -> DataFrame:
    """Ten checks on a split and its training frame; a missing part and a frame without rows fail the order and region checks.

    - `events`: all purchase events with `split`; `pairs`: the labelled training pairs; `frame`: their event-time
      features; `history_visits`: the visits given to the features; `targets`: items that must not be labelled;
      `bought`: all-time pairs.
    """
    train = events.filter("split = 'train'")
    later = events.filter("split <> 'train'").select("positive_event_id")
    region = frame.groupBy("same_region").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"))
    shared = constant_in_group(frame, "positive_event_id", SHARED_HISTORY)
    provenance = (F.col("label") == 1) != (F.col("negative_source") == SOURCE_POSITIVE)
    positives = pairs.filter("label = 1").select("positive_event_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    kept = positives.unionByName(train.select("positive_event_id", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(
        "positive_event_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    checks = [
        _none(train.join(later, "positive_event_id", "left_semi"),
              LEAKAGE_CHECKS[0]),
        _none(frame.filter(F.col("history_last_purchase_time") >= F.col("feature_event_time")),
              LEAKAGE_CHECKS[1]),
        _none(shared.filter("max_distinct > 1"), LEAKAGE_CHECKS[2]),
        _none(history_visits.filter(F.col("ts") >= ts_lit(bounds.tuning_start)),
              LEAKAGE_CHECKS[3]),
        _ordered(events),
        _none(pairs.filter(provenance), LEAKAGE_CHECKS[5]),
        _check(region, LEAKAGE_CHECKS[6],
               F.min(F.least("p", "n")) > 0),
        _none(pairs.join(targets.select("item_id"), "item_id", "left_semi"),
              LEAKAGE_CHECKS[7]),
        _none(pairs.filter("label = 0").join(bought.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"),
              LEAKAGE_CHECKS[8]),
        _check(kept, LEAKAGE_CHECKS[9], F.sum(F.abs(F.col("a") - F.col("b"))) == 0, True),
    ]
    return reduce(DataFrame.unionByName, checks)


def require_passed(checks: DataFrame) -> None:
    """Raise with the names of failed checks (the table has one row per check)."""
    failed = [r["check_name"] for r in checks.filter(~F.col("passed")).collect()]
    if failed:
        raise AssertionError(f"leakage checks failed: {failed}")


def query_invariant_features(frame: DataFrame, group: str = "user_id") -> DataFrame:
    """Feature columns that never vary within a ranking query."""
    columns = [c for c in frame.columns if c not in NON_FEATURES]
    return constant_in_group(frame, group, columns).filter("max_distinct <= 1").select("column_name")


def submission_guards(template: DataFrame, submission: DataFrame, filled_before: DataFrame) -> DataFrame:
    """Guards of a submission as (check_name, passed): few users fell back, the columns fit, no user is lost or doubled."""
    missing = template.join(filled_before.select("user_id"), "user_id", "left_anti").agg(
        F.count(F.lit(1)).alias("n")).scalar()
    users = template.agg(F.count(F.lit(1)).alias("n"))
    few = users.select(F.lit("few_users_without_list").alias("check_name"),
                       (missing <= F.greatest(F.lit(1.0), F.col("n") * 0.001)).alias("passed"))
    columns = users.select(F.lit("columns_as_asked").alias("check_name"),
                           F.lit(submission.columns == ["user_id", "purchased_items"]).alias("passed"))
    rows = submission.agg(F.count(F.lit(1)).alias("rows"), F.count("purchased_items").alias("lists"))
    expected = users.scalar()
    whole = rows.select(F.lit("each_user_once").alias("check_name"),
                        ((F.col("rows") == expected) & (F.col("lists") == expected)).alias("passed"))
    return few.unionByName(columns).unionByName(whole)


def disjoint(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Set relations of two key columns: sizes of both sets, their intersection and differences."""
    both = left.select(*keys).distinct().withColumn("l", F.lit(1)).join(
        right.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "full_outer")
    return both.agg(F.count("l").alias("left_size"), F.count("r").alias("right_size"),
                    F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("common"),
                    F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"),
                    F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def one_row_a_key(right: DataFrame, keys: list[str]) -> DataFrame:
    """The table, failing where a row is read whose key repeats: the check is part of the plan and costs no job of its own.

    Rows with a null key can't be met by a join and are left out."""
    rest = [c for c in right.columns if c not in keys]
    message = F.concat(F.lit(f"the right side repeats {keys}: "), F.to_json(F.struct(*keys)))
    held = right.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.lit(True).alias("_met"), *rest])).alias("_row"))
    kind = held.schema["_row"].dataType
    held = held.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message).cast(kind)))
    return held.select(*keys, "_row")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False,
                   complete: bool = False) -> DataFrame:
    """A left or inner join that fails on duplicate right keys, duplicate left keys (one_to_one) and missing matches (complete).

    Each check is an expression over the join's own rows and raises when the result is computed."""
    rest = [c for c in right.columns if c not in keys]
    joined = left.join(one_row_a_key(right, keys), keys, how)
    met = F.col("_row")
    if complete:
        message = F.concat(F.lit(f"some rows find no match on {keys}: "), F.to_json(F.struct(*keys)))
        joined = joined.withColumn("_row", F.when(met.isNotNull(), met).otherwise(F.raise_error(message).cast(joined.schema["_row"].dataType)))
    if one_to_one:
        # A hot left key would be an error anyway; counting it is one window over the join's own partitioning.
        many = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
        message = F.concat(F.lit(f"the left side repeats {keys}: "), F.to_json(F.struct(*keys)))
        joined = joined.withColumn("_row", F.when(many, F.raise_error(message).cast(joined.schema["_row"].dataType)).otherwise(met))
    return joined.select(*left.columns, *[met[c].alias(c) for c in rest])
