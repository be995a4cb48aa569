from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from offerlens.operators import split as S

T0 = datetime(2011, 7, 1)


def events(spark, offsets_hours):
    return spark.createDataFrame([(i, int(h * 3600)) for i, h in enumerate(offsets_hours)], "item_id bigint, s bigint").select(
        F.lit(1).alias("user_id"), "item_id", F.timestamp_seconds(F.col("s") + F.lit(1309478400)).alias("ts"))


def test_grid_of_fifty_weeks(spark):
    days = (datetime(2012, 6, 23) - T0).days
    grid = S.week_grid(events(spark, [10, days * 24 + 23.9]))
    assert grid.train_weeks == 50 and len(grid.train_starts) == 50
    to_day = lambda us: (datetime(1970, 1, 1) + timedelta(microseconds=us)).date().isoformat()
    assert (to_day(grid.first_start), to_day(grid.val_start), to_day(grid.final_cutoff)) == (
        "2011-07-03", "2012-06-17", "2012-06-24")


def test_too_few_weeks(spark):
    with pytest.raises(ValueError, match="two whole weeks"):
        S.week_grid(events(spark, [0, 24]))
    with pytest.raises(ValueError):
        S.week_grid(events(spark, [0]).limit(0))


def test_window_bounds_differ(make):
    d = datetime
    items = make([(1, d(2020, 1, 8), d(2020, 1, 9)), (2, d(2020, 1, 1), d(2020, 1, 1)), (3, None, d(2020, 1, 3)),
                  (4, d(2020, 1, 2), None)], "item_id int, disp_from timestamp, disp_end timestamp")
    start, end = 1577836800_000000, 1578441600_000000  # 2020-01-01 and 2020-01-08
    assert rows_of(S.candidates_in_window(items, start), "item_id") == [(2,)]
    assert rows_of(S.active_items(items, start, end), "item_id") == [(1,), (2,), (3,), (4,)]


def test_weekly_candidates_equal_the_window_of_each_week(make):
    d, day = datetime(2020, 1, 1), timedelta(days=1)
    rows = [(i, d + day * (i % 23 - 5) + timedelta(hours=i % 5 * 6), d + day * (i % 23 - 5 + i % 9)) for i in range(200)]
    items = make(rows, "item_id int, disp_from timestamp, disp_end timestamp")
    grid = S.WeekGrid(1577836800_000000, 1577836800_000000 + 3 * S.WEEK_US, 1577836800_000000 + 4 * S.WEEK_US)
    got = rows_of(S.weekly_candidates(items, grid, True), "week", "item_id")
    want = sorted((w, r[0]) for w in range(4) for r in S.candidates_in_window(items, grid.first_start + w * S.WEEK_US).select(
        "item_id").collect())
    assert got == want


def test_three_way_split_matches_sorted_positions(spark):
    hours = [float(h) for h in range(50)] + [39.0] * 5
    tagged, b = S.temporal_three_way_split(events(spark, hours))
    order = sorted(hours)
    base = 1309478400_000000
    assert b.tuning_start == base + int(order[int(55 * 0.8)] * 3600e6)
    assert b.holdout_start == base + int(order[int(55 * 0.9)] * 3600e6)
    n = dict(rows_of(tagged.groupBy("split").count(), "split", "count"))
    assert sum(n.values()) == 55 and set(n) == {"train", "early_stop", "holdout"}
    assert n["train"] == sum(h < order[44] for h in hours)


def test_split_errors(spark):
    with pytest.raises(ValueError, match="three events"):
        S.split_bounds(events(spark, [1, 2]))
    with pytest.raises(ValueError, match="empty"):
        S.temporal_three_way_split(events(spark, [5, 5, 5, 5]))
