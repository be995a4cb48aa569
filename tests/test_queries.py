"""Registered queries beside their SQL on the smallest tables; check_oracles.py runs all of them on any folder."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
import check_oracles
from offerlens import session
from offerlens.session import materialized

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "rules_top10", "popularity_top10", "rules_map10", "rules_top10_targets", "submission_rules", "translation_report",
    "weekly_training_pairs", "weekly_user_snapshots", "weekly_genre_snapshots_order_lines", "hard_negatives", "lines_before_order",
    "last_purchase_before_visit", "user_history", "three_way_split", "cutoff_features", "baseline_ap", "predict_targets",
    "submission_with_fallback", "rejected_requests", "ranked_requests", "exact_medians", "item_codes", "validation_report",
    "retrieval_candidates", "popular_random_candidates", "paired_bootstrap",
]
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(FOLDER)


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert set(QUICK) <= set(sql)


@needs_data
def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert [f.simpleString() for f in df.schema] == ["user_id:bigint", "item_id:bigint", "score:double", "rank:bigint"]
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert check_oracles.difference(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_the_shared_folder_of_the_cluster_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    df = materialized(spark.range(5))
    assert df.count() == 5 and len(set(os.listdir(folder)) - before) == 1


def test_intermediate_tables_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {})
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert materialized(spark.range(3)).count() == 3 and materialized(spark.range(4)).count() == 4
    assert session.discard(spark) == 2 and set(os.listdir(folder)) == before and session.discard(spark) == 0


def test_broadcasts_go_by_size_in_memory(spark, make, tmp_path):
    session.configure(spark)
    assert session._bytes("10MB") == 10 << 20 and session._bytes("256k") == 256 << 10 and session._bytes("-1") == -1 and session._bytes("99b") == 99
    # 300,000 rows in some 20 MB of memory and far fewer of files: no table for the driver to hand out.
    path = str(tmp_path / "long")
    spark.range(300_000).selectExpr("id div 1000 as k", "repeat('x', 40) as t").coalesce(1).write.parquet(path)
    files = sum(f.stat().st_size for f in (tmp_path / "long").glob("*.parquet"))
    assert files < session.BROADCAST_BYTES and spark.conf.get("spark.sql.sources.fileCompressionFactor") == "10"


@pytest.mark.parametrize("name, cases", [
    ("spark.sql.autoBroadcastJoinThreshold", [("256k", "256k"), ("-1", "-1"), ("1g", str(session.BROADCAST_BYTES))]),
    ("spark.sql.adaptive.advisoryPartitionSizeInBytes", [("8m", "8m"), ("64MB", str(session.PARTITION_BYTES))])])
def test_a_cluster_may_ask_for_less(spark, name, cases):
    before = spark.conf.get(name)
    try:
        for asked, got in cases:
            spark.conf.set(name, asked)
            session.configure(spark)
            assert spark.conf.get(name) == got
    finally:
        spark.conf.set(name, before)


def test_a_common_list_is_given_in_many_tasks(spark, make):
    from offerlens.operators import scoring

    users = spark.range(400).select(scoring.F.col("id").alias("user_id")).coalesce(1)
    ranked = make([(7, 2.0, 1), (8, 1.0, 2)], "item_id int, score double, rank int")
    out = scoring.give_to_all(users, ranked).withColumn("part", scoring.F.spark_partition_id())
    assert out.count() == 800 and out.select("part").distinct().count() > 1


def test_retrieval_candidates_keeps_the_limits_of_a_full_run(monkeypatch):
    """Sources are cut by the limits of a full run only, in the query as in its SQL."""
    from offerlens.plans import events

    asked = {}

    class Stop(Exception):
        pass

    def retrieval(truth, pool, items, purchases, visits, max_per_user=events.MAX_CANDIDATES_PER_USER, popular=events.POPULAR_CANDIDATES, seed=42):
        asked.update(limit=max_per_user, popular=popular)
        raise Stop

    class World:
        items = None

    monkeypatch.setattr(events, "_retrieval", lambda spark, sf: (World, None, None, None, None))
    monkeypatch.setattr(events.CA, "retrieval_candidates", retrieval)
    with pytest.raises(Stop):
        events.retrieval_candidates(None, "")
    assert asked == {"limit": 500, "popular": 100}
    sql = entry.oracle_sql()["retrieval_candidates"]
    assert "limit 100)" in sql and "k <= 500)" in sql
