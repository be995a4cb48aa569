import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlens.functions import exprs as X
from offerlens.operators import encode as E
from offerlens.operators import features as FE
from offerlens.operators import history as H
from offerlens.operators.candidates import pool_pairs, product

CUT = 1704672000_000000  # 2024-01-08


@pytest.fixture(scope="module")
def shop(make):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    genre, region = ["a", "b", "", None], ["x", "y", "", None]
    users = make([(u, "m" if u % 3 else None, None if u % 7 == 0 else 20 + u, region[u % 4]) for u in range(40)] + [(None, "m", 30, "x")],
                 "user_id long, sex_id string, age int, pref_name string")
    items = make([(i, genre[i % 4], f"c{i % 5}", None if i % 9 == 0 else float(i), 100.0 + i, None if i % 11 == 0 else float(i * 10 - 50), region[i // 4 % 4])
                  for i in range(60)],
                 "item_id long, genre_name string, capsule_text string, price_rate double, catalog_price double, discount_price double, pref_name string")
    facts = make([(rng.randrange(25), rng.randrange(60), start + timedelta(hours=rng.randrange(200))) for _ in range(500)],
                 "user_id long, item_id long, ts timestamp")
    ctx = H.cutoff_context(facts.filter("user_id % 2 = 0"), facts, items, CUT)
    return users, items, ctx, E.entity_codes(users, items)


def test_the_product_has_the_features_of_its_pairs(shop):
    users, items, ctx, codes = shop
    pool = items.filter("item_id % 3 > 0")
    for table in (codes, None):
        pairs = pool_pairs(users.select("user_id"), pool.select("item_id")).select("user_id", "item_id").withColumn("cutoff", X.ts_lit(CUT))
        want = FE.pair_features(pairs, users, pool, ctx, table)
        got = FE.product_features(users.withColumn("cutoff", X.ts_lit(CUT)), pool, ctx, table)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 41 * 40
    assert got.filter("log_same_item_purchases > 0").count() > 0 and got.filter("log_user_genre_visits > 0").count() > 0


def test_a_repeated_item_of_a_stored_pool_is_an_error(shop):
    users, items, ctx, _ = shop
    with pytest.raises(Exception, match="repeat|more than once|duplicate|twice"):
        FE.product_features(users.withColumn("cutoff", X.ts_lit(CUT)), items.unionByName(items.limit(3)), ctx).collect()


def test_one_block_still_goes_to_many_tasks(spark, make):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # users too many to be sent whole
    try:
        out = product(make([(u,) for u in range(500)], "user_id int"), make([(i,) for i in range(10)], "item_id int"), "item_id")
        tasks = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(r["count"] for r in tasks) == 5000 and len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
