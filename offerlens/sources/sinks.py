"""Writers: submissions, reports, codes and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.constants import TOP_K
from offerlens.operators.audit import validated_join


def item_strings(ranked: DataFrame, k: int = TOP_K) -> DataFrame:
    """Each user's first k distinct items joined by blanks, in rank order."""
    cut = ranked.filter(F.col("rank") <= k).groupBy("user_id", "item_id").agg(F.min("rank").alias("rank"))
    pairs = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return cut.groupBy("user_id").agg(
        F.array_join(F.transform(pairs, lambda p: p["item_id"].cast("string")), " ").alias("purchased_items"))


def submission(template: DataFrame, ranked: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row per template user; users without a list get an empty text, a repeated template user is an error."""
    return validated_join(template.select("user_id"), item_strings(ranked, k), ["user_id"], one_to_one=True).select(
        "user_id", F.coalesce("purchased_items", F.lit("")).alias("purchased_items"))


def submission_with_fallback(template: DataFrame, ranked: DataFrame, fallback: DataFrame, k: int = TOP_K) -> DataFrame:
    """As submission, but users without a list get the common fallback list (rank, item_id)."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    common = fallback.filter(F.col("rank") <= k).agg(
        F.array_join(F.transform(pairs, lambda p: p["item_id"].cast("string")), " ").alias("l")).scalar()
    return validated_join(template.select("user_id"), item_strings(ranked, k), ["user_id"], one_to_one=True).select(
        "user_id", F.coalesce("purchased_items", common).alias("purchased_items"))


def require_few_missing(template: DataFrame, ranked: DataFrame, share: float = 0.001) -> None:
    """Refuse a submission in which more than max(1, share) users have no list."""
    users = template.count()
    missing = template.join(ranked.select("user_id").distinct(), "user_id", "left_anti").count()
    if missing > max(1, share * users):
        raise ValueError(f"{missing} of {users} users have no ranking")


def write_submission(df: DataFrame, path: str, order: str = "user_id") -> None:
    """CSV with a header, rows in template order (range-partitioned, so no task holds all rows)."""
    df.orderBy(order).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def save_codes(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").parquet(path)


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: Transformer, path: str) -> None:
    """Store a fitted model as a pipeline, so that load_model needs no class."""
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
