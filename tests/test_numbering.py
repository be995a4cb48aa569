import random
import statistics

import pytest
from conftest import rows_of

from offerlens.operators.numbering import column_medians, grouped_median, numbered, times_at_positions


def test_positions_follow_the_order_across_buckets(make):
    ids = [5, 250_000, 99_999, 100_000, -7, 1_000_000, 42]
    df = make([(i,) for i in ids], "id bigint")
    assert rows_of(numbered(df, "pos", "id"), "id", "pos") == [(v, i) for i, v in enumerate(sorted(ids))]


def test_positions_per_group_with_nulls_and_texts(make):
    df = make([("a", "x"), ("a", "b"), (None, "q"), ("a", "bb"), (None, "c")], "g string, v string")
    out = numbered(df, "pos", "v", ["g"], "size")
    assert {(r["g"], r["v"]): (r["pos"], r["size"]) for r in out.collect()} == {
        ("a", "b"): (0, 3), ("a", "bb"): (1, 3), ("a", "x"): (2, 3), (None, "c"): (0, 2), (None, "q"): (1, 2)}


def test_times_at_positions_equal_sorted_list(make, spark):
    rng = random.Random(1)
    seconds = [rng.randrange(0, 5 * 86400) for _ in range(500)] + [86400] * 200
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint").selectExpr("timestamp_seconds(s) as ts")
    wanted = sorted(seconds)
    for p in (0, 1, 350, 698, 699):
        assert times_at_positions(df, "ts", [p]) == [wanted[p] * 1_000_000]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_medians_are_exact(make, n):
    rng = random.Random(n)
    values = [float(rng.randrange(50)) if i % 3 else 7.0 for i in range(n)]
    df = make([(i % 3, v, None) for i, v in enumerate(values)], "k int, v double, w double")
    assert column_medians(df, ["v", "w"]) == {"v": statistics.median(values), "w": None}
    per_key = {k: statistics.median(values[k::3]) for k in range(3) if values[k::3]}
    assert dict(rows_of(grouped_median(df, ["k"], "v", "m"), "k", "m")) == per_key


@pytest.mark.parametrize("n", [100_001, 100_000])
def test_median_of_shuffled_and_repeated_values(spark, n):
    df = spark.range(n).selectExpr("cast(id * 7919 % 100003 as double) as v", "cast(id % 2 as double) as w", "cast(null as double) as z")
    want = {"v": statistics.median(i * 7919 % 100_003 for i in range(n)), "w": statistics.median(i % 2 for i in range(n)), "z": None}
    assert column_medians(df, ["v", "w", "z"]) == want


def test_median_of_ten_million_equal_values(spark):
    df = spark.range(10_000_000).selectExpr("0.1 as v", "case when id < 3 then -1e300 when id % 2 = 0 then -0.25 else 1e-310 end as w")
    assert column_medians(df, ["v", "w"]) == {"v": 0.1, "w": -0.25}


def test_median_of_signs_zeros_and_extremes(make):
    values = [-float("inf"), -1e308, -2.5, -0.0, 0.0, 5e-324, 3.0, float("inf"), float("nan"), None]
    finite = [v for v in values if v is not None and v == v]
    assert column_medians(make([(v,) for v in values], "v double"), ["v"]) == {"v": statistics.median(finite)}


def test_a_group_with_most_rows_is_numbered_in_many_ranges(spark):
    df = spark.range(20_000).selectExpr("case when id % 3 > 0 then null else cast(id % 5 as string) end as g", "id * 7919 % 20011 as v").repartition(6)
    rows = numbered(df, "pos", "v", ["g"], "size", "first").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r)
    assert len(rows) == 20_000
    for own in groups.values():
        own.sort(key=lambda r: r.v)
        assert [r.pos for r in own] == list(range(len(own))) and {r.size for r in own} == {len(own)} and len({r["first"] for r in own}) == 1
    firsts = {g: own[0]["first"] for g, own in groups.items()}
    assert [g for g, _ in sorted(firsts.items(), key=lambda x: x[1])] == [None, *sorted(g for g in firsts if g is not None)]


def test_positions_of_clustered_ids_and_common_prefixes(make):
    rng = random.Random(2)
    ids = [rng.randrange(1000) + 5 * 10**17 for _ in range(400)] + [9 * 10**18, -(9 * 10**18)]
    ids = sorted(set(ids))
    df = make([(i,) for i in ids], "id bigint").repartition(5)
    assert [r["pos"] for r in numbered(df, "pos", "id").orderBy("id").collect()] == list(range(len(ids)))
    names = sorted({f"customer-東-{rng.randrange(10**6)}" for _ in range(300)} | {"customer-東", "customer-東-"})
    df = make([(s,) for s in names], "id string").repartition(5)
    assert {r["id"]: r["pos"] for r in numbered(df, "pos", "id").collect()} == {s: i for i, s in enumerate(names)}
