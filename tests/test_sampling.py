import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from offerlens.operators import sampling as N
from offerlens.operators import split as S

D0 = datetime(2024, 1, 1)
START = 1704067200_000000


@pytest.fixture(scope="module")
def shop(make):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        lo = None if i % 13 == 0 else D0 + timedelta(days=rng.randrange(0, 8), hours=rng.randrange(24))
        hi = None if i % 7 == 0 else (lo or D0) + timedelta(days=rng.randrange(3, 20))
        # Most items share one genre and one price band.
        rows.append((i, "hot" if i % 3 else f"g{i % 2}", rng.choice([6.0, 6.1, 7.9, None]), float(rng.randrange(90)),
                     float(rng.randrange(60)), lo, hi))
    items = make(rows, "item_id int, genre_name string, log_discount_price double, price_rate double, valid_period double, "
                       "disp_from timestamp, disp_end timestamp")
    events = [(e, 1 if e % 3 == 0 else rng.randrange(2, 12), rng.randrange(80), D0 + timedelta(days=rng.randrange(4, 14), hours=e % 24))
              for e in range(60)]
    bought = make(events, "positive_event_id int, user_id int, item_id int, ts timestamp")
    return items, bought, rows, events


def brute(rows, events, n, meta, everyone=None):
    """The leveled choice by a plain walk over events, without draws."""
    attrs = {r[0]: r for r in rows}
    owned = {}
    for _, u, i, _ in everyone or events:
        owned.setdefault(u, set()).add(i)

    def dist(a, b):
        return abs((a[2] or 0) - (b[2] or 0)) + abs(a[3] - b[3]) / 100 + 0.25 * abs(a[4] - b[4]) / 365

    out = {}
    for e, u, i, ts in events:
        ok = [r for r in rows if r[0] not in owned[u] and (r[5] is None or r[5] <= ts) and (r[6] is None or r[6] >= ts)]
        ref = attrs[i]
        first = sorted((r for r in ok if r[1] == ref[1]), key=lambda r: (dist(r, ref), r[0]))[:n]
        rest = [r for r in ok if r not in first and meta[r[0]] == meta[i]]
        second = sorted(rest, key=lambda r: (dist(r, ref), r[0]))[:n - len(first)]
        out[e] = ([r[0] for r in first], [r[0] for r in second], len(ok))
    return out


def test_hard_negatives_equal_a_plain_walk(shop):
    items, bought, rows, events = shop
    index = N.sampling_index(items)
    meta = dict(rows_of(index, "item_id", "price_band"))
    want = brute(rows, events, 5, meta)
    got = {}
    for r in N.hard_negatives(bought, index, bought.select("user_id", "item_id").distinct()).collect():
        got.setdefault(r["positive_event_id"], {}).setdefault(r["negative_source"], set()).add(r["item_id"])
    for e, (first, second, size) in want.items():
        found = got.get(e, {})
        assert found.get(N.SOURCE_GENRE, set()) == set(first)
        assert found.get(N.SOURCE_BAND, set()) == set(second)
        assert sum(len(v) for v in found.values()) == min(5, size)


def test_levels_open_in_order_without_a_cut(make):
    # 400 items of the genre, 300 of them bought by the user: 100 are eligible, so no event needs another level.
    day = datetime(2024, 1, 5)
    rows = [(i, "A" if i < 400 else "B", 3.0 + i / 1000, 10.0, 5, None, None) for i in range(450)]
    items = make(rows, "item_id int, genre_name string, log_discount_price double, price_rate double, valid_period int, "
                       "disp_from timestamp, disp_end timestamp")
    bought = make([(e, 1, e, day) for e in range(300)], "positive_event_id int, user_id int, item_id int, ts timestamp")
    out = N.hard_negatives(bought, N.sampling_index(items), bought.select("user_id", "item_id"))
    assert rows_of(out.groupBy("negative_source").count(), "negative_source", "count") == [(N.SOURCE_GENRE, 1500)]
    assert out.filter("positive_event_id = 299").agg(F.min("item_id"), F.max("item_id")).first() == (300, 304)


def test_exclusive_negatives_equal_a_walk(shop):
    items, bought, rows, events = shop
    index = N.sampling_index(items)
    owned = bought.select("user_id", "item_id").distinct()
    out = N.exclusive_hard_negatives(bought, index, owned, n=3).collect()
    taken = {}
    for r in out:
        taken.setdefault(r["positive_event_id"], set()).add(r["item_id"])
    meta = dict(rows_of(index, "item_id", "price_band"))
    used = {}
    for event in sorted(events):
        e, u, *_ = event
        first, second, _ = brute([r for r in rows if r[0] not in used.get(u, set()) or r[0] == event[2]], [event], 3, meta, events)[e]
        mine = taken.get(e, set())
        assert set(first) | set(second) <= mine and len(mine) <= 3
        assert not mine & used.get(u, set())
        used.setdefault(u, set()).update(mine)
    again = N.exclusive_hard_negatives(bought.repartition(5), index.repartition(3), owned, n=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_five_hundred_like_events_of_one_user_take_no_more_jobs(make, spark):
    day = datetime(2024, 1, 5)
    rows = [(i, "A" if i < 900 else "B", 3.0 + i / 1000, 10.0, 5, None, None) for i in range(1200)]
    items = make(rows, "item_id int, genre_name string, log_discount_price double, price_rate double, valid_period int, "
                       "disp_from timestamp, disp_end timestamp")
    index = N.sampling_index(items)

    def run(count):
        bought = make([(e, 1, 0, day) for e in range(count)] + [(1000 + e, 2 + e % 3, e, day) for e in range(9)],
                      "positive_event_id int, user_id int, item_id int, ts timestamp")
        spark.sparkContext.setJobGroup(f"like{count}", "")
        out = N.exclusive_hard_negatives(bought, index, bought.select("user_id", "item_id").distinct(), n=2).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"like{count}"))
        spark.sparkContext.setJobGroup("after", "")
        return out, jobs

    few, few_jobs = run(5)
    _, more_jobs = run(400)
    many, many_jobs = run(500)
    assert more_jobs <= few_jobs + 3
    assert many_jobs <= few_jobs + 20  # the genre runs out, and the two other levels open, once
    # Item 0 is the user's own; the events take the next nearest two by two, 899 of the genre, then others of the band.
    by_event = {}
    for r in many:
        if r.user_id == 1:
            by_event.setdefault(r.positive_event_id, []).append(r.item_id)
    assert [sorted(by_event[e]) for e in range(449)] == [[2 * e + 1, 2 * e + 2] for e in range(449)]
    assert len({i for own in by_event.values() for i in own}) == 1000 and all(len(own) == 2 for own in by_event.values())
    assert [r for r in sorted(map(tuple, few)) if r[0] > 1] == [r for r in sorted(map(tuple, many)) if r[0] > 1]


def test_events_left_short_bring_one_list_and_no_second_round(make, spark):
    day = datetime(2024, 1, 5)
    items = make([(i, "A" if i < 12 else "B", 3.0 + i / 1000, 10.0, 5, None, None) for i in range(40)],
                 "item_id int, genre_name string, log_discount_price double, price_rate double, valid_period int, disp_from timestamp, "
                 "disp_end timestamp")
    bought = make([(e, e % 3, e % 12, day) for e in range(18)], "positive_event_id int, user_id int, item_id int, ts timestamp")
    index = N.sampling_index(items)
    spark.sparkContext.setJobGroup("short", "")
    out = N.exclusive_hard_negatives(bought, index, bought.select("user_id", "item_id").distinct(), n=3).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("short"))
    spark.sparkContext.setJobGroup("after", "")
    # Four items of the genre are the user's own; the eight left serve three events, and the price band serves the rest.
    assert len(out) == 54 and len({(r.user_id, r.item_id) for r in out}) == 54
    assert sum(r.negative_source == N.SOURCE_GENRE for r in out) == 24 and not any(r.negative_source == N.SOURCE_RANDOM for r in out)
    assert jobs <= 35


def test_weekly_pairs(make):
    grid = S.WeekGrid(START, START + 2 * S.WEEK_US, START + 3 * S.WEEK_US)
    items = make([(i, D0 + timedelta(days=i % 9), D0 + timedelta(days=i % 9 + 6)) for i in range(120)],
                 "item_id int, disp_from timestamp, disp_end timestamp")
    users = make([(u,) for u in range(40)], "user_id int")
    buys = [(u % 45, (u * 7) % 120, D0 + timedelta(days=u % 21, hours=3)) for u in range(300)] + [(0, 3, D0 + timedelta(days=3))] * 100
    bought = make(buys, "user_id int, item_id int, ts timestamp")
    out = N.weekly_pairs(users, bought, items, grid)
    rows = [tuple(r) for r in out.select("week", "user_id", "item_id", "label").collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    pool = {w: {r["item_id"] for r in S.candidates_in_window(items, START + w * S.WEEK_US).select("item_id").collect()} for w in (0, 1)}
    truth = {(int((t - D0).days // 7), u, i) for u, i, t in buys}
    assert {r[:3] for r in rows if r[3]} == {t for t in truth if t[0] < 2 and t[1] < 40 and t[2] in pool[t[0]]}
    assert all(r[2] in pool[r[0]] for r in rows) and not any(r[:3] in truth for r in rows if not r[3])
    for w in (0, 1):
        for u in range(40):
            assert sum(1 for r in rows if r[:2] == (w, u) and not r[3]) == 8
    drawn = {r[2] for r in rows if not r[3] and r[0] == 0}
    assert len(drawn) > 0.9 * len(pool[0])


def test_few_candidates_are_drawn_once_each(make):
    grid = S.WeekGrid(START, START + S.WEEK_US, START + 2 * S.WEEK_US)
    items = make([(i, D0, D0 + timedelta(days=3)) for i in range(5)], "item_id int, disp_from timestamp, disp_end timestamp")
    out = N.weekly_pairs(make([(1,)], "user_id int"), make([(1, 2, D0)], "user_id int, item_id int, ts timestamp"), items, grid)
    assert rows_of(out, "item_id", "label") == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0)]


def test_weekly_draws_are_dealt_by_week_and_user_once(make, capsys):
    """No shuffle of its own takes the purchases out of the draws; a null item stays among them."""
    grid = S.WeekGrid(START, START + S.WEEK_US, START + 2 * S.WEEK_US)
    items = make([(i if i else None, D0, D0 + timedelta(days=3)) for i in range(6)], "item_id int, disp_from timestamp, disp_end timestamp")
    bought = make([(1, i, D0) for i in (1, 2, 2, None)] + [(None, 3, D0), (2, None, D0)], "user_id int, item_id int, ts timestamp")
    out = N.weekly_pairs(make([(1,), (1,), (2,), (None,)], "user_id int"), bought, items, grid)
    held = {}
    for r in out.collect():
        held.setdefault((r["user_id"], r["label"]), []).append(r["item_id"])
    assert {k: sorted(v, key=str) for k, v in held.items()} == {
        (1, 1): [1, 2], (1, 0): [3, 4, 5, None], (2, 0): [1, 2, 3, 4, 5, None]}
    out.explain()
    assert "LeftAnti" not in capsys.readouterr().out


def test_negative_mix(make):
    df = make([("L1_same_genre_similar",)] * 3 + [("L3_random_fallback",)], "negative_source string")
    assert rows_of(N.negative_mix(df), "negative_source", "rows", "share", "hard_share") == [
        ("L1_same_genre_similar", 3, 0.75, 0.75), ("L3_random_fallback", 1, 0.25, 0.75)]
