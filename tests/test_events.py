from datetime import datetime, timezone

import pytest
from conftest import rows_of

from offerlens.operators import audit as Q
from offerlens.operators import features as FE
from offerlens.operators import history as H
from offerlens.operators import split as S


@pytest.fixture(scope="module")
def small(make):
    """A reader with three purchases in March; books and films, two regions."""
    users = make([("reader", "f", 52, "North", "50s")], "user_id string, sex_id string, age int, pref_name string, age_bucket string")
    items = make([("atlas", "book", "North", 30.0, 15.0, "p"), ("novel", "book", "South", 18.0, 25.0, "q"), ("drama", "film", "North", 9.0, 60.0, "q")],
                 "item_id string, genre_name string, item_pref_name string, discount_price double, price_rate double, capsule_text string")
    at = lambda day, hour=0: datetime(2021, 3, day, hour)
    bought = make([("reader", "novel", at(5), 11), ("reader", "drama", at(9, 8), 12), ("reader", "atlas", at(20), 13)],
                  "user_id string, item_id string, ts timestamp, positive_event_id long")
    seen = make([("reader", "atlas", at(4)), ("reader", "atlas", at(9, 7)), ("reader", "drama", at(9, 8)), ("reader", "drama", at(10))],
                "user_id string, item_id string, ts timestamp")
    pairs = make([("reader", "novel", 1, 11, "novel", "positive"), ("reader", "atlas", 0, 11, "novel", "test"),
                  ("reader", "drama", 1, 12, "drama", "positive"), ("reader", "atlas", 0, 12, "drama", "test"),
                  ("reader", "atlas", 1, 13, "atlas", "positive")],
                 "user_id string, item_id string, label int, positive_event_id long, reference_item_id string, negative_source string")
    return users, items, bought, seen, pairs


def test_history_ends_before_the_event(small):
    users, items, bought, seen, pairs = small
    f = FE.event_time_features(pairs, users, items, bought, seen)
    assert f.count() == pairs.count()
    counts = f.select("positive_event_id", "user_purchase_count", "user_view_count").distinct()
    assert rows_of(counts, "positive_event_id", "user_purchase_count", "user_view_count") == [(11, 0, 1), (12, 1, 2), (13, 2, 4)]
    assert f.filter("history_last_purchase_time >= feature_event_time").isEmpty()
    rows = {(r["positive_event_id"], r["item_id"]): r for r in f.collect()}
    unknown = rows[11, "novel"]
    assert unknown["user_avg_purchase_price"] is None and unknown["price_gap"] is None and unknown["user_active_days"] is None
    atlas, drama = rows[12, "atlas"], rows[12, "drama"]
    assert (atlas["user_genre_purchase_count"], drama["user_genre_purchase_count"]) == (1, 0)
    assert (atlas["user_genre_view_count"], drama["user_genre_view_count"]) == (2, 0)
    assert atlas["price_gap"] == 12.0 and (atlas["same_region"], rows[11, "novel"]["same_region"]) == (1, 0)
    last = rows[13, "atlas"]
    assert last["user_active_days"] == 15 and last["view_to_purchase_ratio"] == 2.0 and last["user_avg_purchase_price"] == 13.5


def test_missing_categories_still_match(make, small):
    users, items, bought, seen, pairs = small
    from pyspark.sql import functions as F
    bare = items.withColumn("genre_name", F.when(F.col("genre_name") != "book", F.col("genre_name")))
    f = FE.event_time_features(pairs, users, bare, bought, seen)
    row = f.filter("positive_event_id = 12 and item_id = 'atlas'").first()
    assert row["genre_name"] == "__MISSING_GENRE__" and row["user_genre_purchase_count"] == 1


def test_invariant_features(small):
    users, items, bought, seen, pairs = small
    f = FE.event_time_features(pairs, users, items, bought, seen)
    names = {r["column_name"] for r in Q.query_invariant_features(f, "positive_event_id").collect()}
    assert {"user_purchase_count", "user_view_count", "sex_id"} <= names and "genre_name" not in names


def test_null_counts_as_a_value(make):
    df = make([(1, None), (1, 2), (2, None), (2, None)], "g int, x int")
    assert H.constant_in_group(df, "g", ["x"]).first()["max_distinct"] == 2
    assert H.constant_in_group(df.filter("g = 2"), "g", ["x"]).first()["max_distinct"] == 1


def test_cutoff_frame_defaults_to_zero_and_leave_one_out_adjusts(make, small):
    users, items, bought, seen, _ = small
    plain = items.withColumnRenamed("item_pref_name", "pref_name")
    history = H.event_history(bought, seen, plain)
    frame = FE.user_features(users, history.user)
    pairs = make([("reader", "drama", 1), ("stranger", "drama", 0)], "user_id string, item_id string, label int")
    rows = {r["user_id"]: r for r in FE.cutoff_features(pairs, frame, items, history).collect()}
    assert rows["reader"]["user_avg_purchase_price"] == 19.0 and rows["reader"]["user_median_purchase_price"] == 18.0
    assert rows["stranger"]["user_avg_purchase_price"] == 0.0 and rows["stranger"]["price_gap"] == 9.0
    out = {r["user_id"]: r for r in FE.leave_one_out_features(pairs, frame, items, history).collect()}
    assert out["reader"]["user_purchase_count"] == 2 and out["reader"]["user_avg_purchase_price"] == 24.0
    assert out["reader"]["user_unique_item_count"] == 2 and out["reader"]["user_unique_genre_count"] == 1
    assert out["stranger"]["user_avg_purchase_price"] is None


def test_checks_fail_where_a_part_or_the_frame_is_missing(make):
    events = make([(1, 1, 1, datetime(2021, 3, 1), "train")], "positive_event_id long, user_id int, item_id int, ts timestamp, split string")
    assert Q._ordered(events).first()["passed"] is False


def test_an_event_without_a_time_is_in_no_part(make):
    events = make([(1, datetime(2021, 3, 1)), (2, None), (3, datetime(2021, 3, 9))], "id int, ts timestamp")
    us = lambda day: int(datetime(2021, 3, day, tzinfo=timezone.utc).timestamp()) * 1_000_000
    tagged = S.tag_split(events, S.SplitBounds(us(1), us(5), us(8), us(9)))
    assert rows_of(tagged, "id", "split") == [(1, "train"), (2, None), (3, "holdout")]
