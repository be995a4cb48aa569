import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from offerlens.operators import candidates as CA


def brute(owners, genres, items, k, w):
    known = {}
    for o, g in genres:
        known.setdefault(o, set()).add(g)
    out = {}
    for o, pref, price in owners:
        scored = []
        for i, g, r, base, lp in items:
            bonus = (0.9 if g is not None and g in known.get(o, ()) else 0) + (1.1 if pref is not None and pref == r else 0)
            scored.append((-(base - w * abs(lp - price) + bonus), i))
        out[o] = {i for _, i in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("w", [0.08, 0.0, 1.5])
def test_shortlist_holds_the_best_of_every_owner(make, w):
    rng = random.Random(7)
    genres, regions = ["g1", "g2", "g3", None], ["r1", "r2", None]
    # A third of the items are copies of one another, and one genre holds most of the rest.
    items = [(i, "g1", "r1", 1.0, 6.0) for i in range(100)]
    items += [(i, rng.choice(["g1", "g1", "g1", *genres]), rng.choice(regions), rng.choice([0.1, 0.5, 1.0, 1.2, rng.random() * 2]),
               rng.choice([5.0, 6.0, rng.uniform(4, 8)])) for i in range(100, 300)]
    rng.shuffle(items)
    owners = [(o, rng.choice(regions), rng.choice([0.0, rng.uniform(4, 8)])) for o in range(60)]
    likes = [(o, rng.choice(genres[:3])) for o in range(50) for _ in range(o % 4)]
    got = {}
    for r in CA.shortlist(make(owners, "o int, pref_name string, log_price double"), make(likes, "o int, genre_name string"),
                          make(items, "item_id int, genre_name string, pref_name string, base double, log_price double"),
                          ["o"], 5, w).collect():
        got.setdefault(r["o"], set()).add(r["item_id"])
    want = brute(owners, likes, items, 5, w)
    assert all(want[o] <= got[o] for o, _, _ in owners)
    assert sum(map(len, got.values())) < len(owners) * len(items) / 2


def test_shortlist_with_known_bonuses_leaves_out_what_the_kth_item_beats(make):
    """Each owner's bonuses decide: beside the k best only what rounding could lift is left; an empty text is no missing one."""
    rng = random.Random(11)
    genres, regions, k = ["g1", "g2", "g3", "", None], ["r1", "r2", "", None], 5
    items = [(i, rng.choice(genres), rng.choice(regions), rng.random() * 2, rng.uniform(4, 8)) for i in range(400)]
    items += [(i, rng.choice(["", None]), rng.choice(["", None]), 3.0, 5.0) for i in range(400, 430)]
    owners = [(o, rng.choice(regions), rng.choice([0.0, rng.uniform(4, 8)])) for o in range(60)]
    likes = [(o, g, rng.random() * 2) for o in range(50) for g in rng.sample(genres[:4], o % 4)]
    pairs = CA.shortlist(make(owners, "o int, pref_name string, log_price double"), make(likes, "o int, genre_name string, bonus double"),
                         make(items, "item_id int, genre_name string, pref_name string, base double, log_price double"), ["o"], k, 0.5, 1.1)
    got = rows_of(pairs, "o", "item_id")
    assert len(set(got)) == len(got)
    bonus = {(o, g): b for o, g, b in likes}
    for o, home, price in owners:
        score = {i: base - 0.5 * abs(lp - price) + bonus.get((o, g), 0) + 1.1 * (home is not None and home == r) for i, g, r, base, lp in items}
        best = sorted(items, key=lambda x: (-score[x[0]], x[0]))
        bar, mine = score[best[k - 1][0]], {i for p, i in got if p == o}
        assert {x[0] for x in best[:k]} <= mine and all(score[i] >= bar - 2 * CA.SLACK for i in mine)


def test_shortlist_of_a_pool_smaller_than_k(make):
    out = CA.shortlist(make([(1, "r", 0.0)], "o int, pref_name string, log_price double"), make([], "o int, genre_name string"),
                       make([(7, "g", "x", 0.5, 1.0)], "item_id int, genre_name string, pref_name string, base double, log_price double"),
                       ["o"], 10, 0.08)
    assert rows_of(out, "o", "item_id") == [(1, 7)]


def test_product_of_users_and_pool(make):
    users, pool = make([(u,) for u in range(37)], "user_id int"), make([(i,) for i in range(23)] * 2, "item_id int")
    out = CA.pool_pairs(users, pool, block_rows=5, salts=3)
    assert rows_of(out, "user_id", "item_id", "candidate_pos") == [(u, i, i) for u in range(37) for i in range(23)]
    assert CA.pool_pairs(users, pool.limit(0)).count() == 0


@pytest.fixture(scope="module")
def shop(make):
    pool = make([(i, f"g{i % 3}") for i in range(60)], "item_id int, genre_name string")
    truth = make([(1, 59), (1, 58), (2, 0)], "user_id int, item_id int")
    bought = make([(9, i % 10, i) for i in range(50)] + [(1, 4, 99)], "user_id int, item_id int, event_id int").withColumn(
        "ts", F.timestamp_seconds("event_id"))
    seen = make([(1, 30 + i, i) for i in range(20)] + [(1, 30, 50), (1, 777, 0)], "user_id int, item_id int, event_id int").withColumn(
        "ts", F.timestamp_seconds("event_id"))
    return truth, pool, bought, seen


def test_retrieval_respects_its_sources_and_limit(shop):
    truth, pool, bought, seen = shop
    out = CA.retrieval_candidates(truth, pool, pool, bought, seen, max_per_user=45, popular=4)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["user_id"], {})[r["item_id"]] = (r["label"], r["retrieved"])
    for user, items in rows.items():
        assert sum(found for _, found in items.values()) == 45
    # user 1 has 15 viewed, 20 of the bought genre and 4 popular items: fewer than 45, so all of them are kept.
    assert set(range(30, 45)) <= {i for i, (_, found) in rows[1].items() if found}
    assert {1, 4, 7, 10} <= {i for i, (_, found) in rows[1].items() if found}
    assert {0, 1, 2, 3} <= {i for i, (_, found) in rows[2].items() if found}
    assert all(i in rows[1] for i in (58, 59)) and rows[1][59][0] == 1 and rows[2][0] == (1, 1)
    recall = CA.retrieval_recall(out, truth).first()
    hits = sum(rows[u][i][1] for u, i in ((1, 59), (1, 58), (2, 0)))
    assert (recall["hits"], recall["truth_size"]) == (hits, 3)


def test_retrieval_cuts_when_sources_exceed_the_limit(shop):
    truth, pool, bought, seen = shop
    out = CA.retrieval_candidates(truth, pool, pool, bought, seen, max_per_user=12, popular=10)
    n = dict(rows_of(out.groupBy("user_id").agg(F.sum("retrieved").alias("n")), "user_id", "n"))
    assert n == {1: 12, 2: 12}


def test_popular_then_random(shop):
    truth, pool, bought, _ = shop
    out = CA.popular_random_candidates(truth, pool, bought, max_per_user=20, popular=6)
    per_user = {}
    for r in out.collect():
        per_user.setdefault(r["user_id"], set()).add(r["item_id"])
    assert all(len(v) == 20 for v in per_user.values())
    top = {r["item_id"] for r in bought.groupBy("item_id").count().orderBy(F.desc("count"), "item_id").limit(6).collect()}
    assert all(top <= v for v in per_user.values())
    assert per_user[1] != per_user[2]
    whole = CA.popular_random_candidates(truth, pool, bought, max_per_user=500, popular=6)
    assert whole.count() == 120


def test_shortlist_is_short_where_prices_are_equal(make):
    # Bases lie closer together than the score can move within a wide band of prices, but nobody's price differs from another's.
    items = [(i, "g", "r", 1.0 + i * 1e-4, 6.0 + i * 1e-5) for i in range(200)]
    owners = [(o, "r", 0.0) for o in range(40)]
    pairs = CA.shortlist(make(owners, "o int, pref_name string, log_price double"), make([], "o int, genre_name string"),
                         make(items, "item_id int, genre_name string, pref_name string, base double, log_price double"), ["o"], 5, 0.08)
    got = rows_of(pairs, "o", "item_id")
    assert got == [(o, i) for o in range(40) for i in range(195, 200)]


def test_shortlist_spreads_its_owners(spark, make):
    items = [(i, "g", "r", float(i), 6.0) for i in range(30)]
    owners = make([(o, "r", 0.0) for o in range(400)], "o int, pref_name string, log_price double").coalesce(1)
    pairs = CA.shortlist(owners, make([], "o int, genre_name string"),
                         make(items, "item_id int, genre_name string, pref_name string, base double, log_price double"), ["o"], 3, 0.08)
    assert pairs.select("o", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count() > 1
