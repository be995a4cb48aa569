"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import bpe, exact_dedup, fingerprints, main_text, merkle, mixing, near_dup, ngram_lm, quality, sharding, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; joins on hot keys may be split by Spark."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality")
def op1(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_toxicity")
def op2(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_sharding")
def op3(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"), shards=16)


@query("op4_exact_dedup", exact_dedup.SQL)
def op4(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op5_ngram_lm")
def op5(spark, folder):
    return ngram_lm.score_documents(table(spark, folder, "documents"))


@query("op6_near_dup")
def op6(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85).drop("tk", "component")


@query("op7_bpe")
def op7(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"))


@query("op8_fingerprints")
def op8(spark, folder):
    return fingerprints.compare_edits(table(spark, folder, "documents"))


@query("op9_mixing")
def op9(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).drop("tag")


@query("op10_token_counts")
def op10(spark, folder):
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, folder, "documents")))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark, folder):
    return merkle.verify(merkle.manifest(table(spark, folder, "documents")))


@query("op11_vector_codes", vector_codes.SQL)
def op11(spark, folder):
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query("op13_main_text")
def op13(spark, folder):
    return main_text.extract(table(spark, folder, "pages"))
