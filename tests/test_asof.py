import random

from conftest import rows_of
from pyspark.sql import functions as F

from offerlens.functions.constants import DAY_US
from offerlens.operators.asof import Measure, asof_latest, asof_measures, running_state


def frames(make, seed=3):
    rng = random.Random(seed)
    # One key owns a third of all events; instants repeat and fall on bucket borders.
    keys = ["hot"] * 60 + [rng.choice(["a", "b", None]) for _ in range(120)]
    events = [(k, rng.randrange(0, 12) * 21_600 * 1_000_000, float(rng.randrange(9))) for k in keys]
    queries = [(i, rng.choice(["hot", "a", "b", "c", None]), rng.randrange(0, 14) * 21_600 * 1_000_000) for i in range(80)]
    to_ts = "timestamp_micros(us) as ts"
    return (events, queries, make(events, "k string, us bigint, x double").selectExpr("k", to_ts, "x"),
            make(queries, "q bigint, k string, us bigint").selectExpr("q", "k", to_ts))


def test_measures_equal_brute_force_and_exclude_equal_times(make):
    events, queries, e, q = frames(make)
    for bucket in (DAY_US, DAY_US // 4, 30 * DAY_US):
        out = asof_measures(q, e, ["k"], {"n": Measure("sum", F.lit(1).cast("bigint")), "s": Measure("sum", F.col("x")),
                                          "lo": Measure("min", F.col("x")), "hi": Measure("max", F.col("x"))},
                            bucket_us=bucket)
        got = {r["q"]: (r["n"], r["s"], r["lo"], r["hi"]) for r in out.collect()}
        assert len(got) == len(queries)
        for i, k, us in queries:
            xs = [x for kk, t, x in events if kk == k and t < us]
            assert got[i] == ((len(xs), sum(xs), min(xs), max(xs)) if xs else (None,) * 4)


def test_latest_state(make):
    _, _, e, q = frames(make, 4)
    states = e.groupBy("k", F.col("ts").alias("state_time")).agg(F.max("x").alias("x"))
    out = asof_latest(q, states, ["k"])
    held = states.collect()
    for r in out.collect():
        asked = next(x for x in q.collect() if x["q"] == r["q"])
        past = [s for s in held if s["k"] == asked["k"] and s["state_time"] < asked["ts"]]
        best = max(past, key=lambda s: s["state_time"], default=None)
        assert (r["state_time"], r["x"]) == ((best["state_time"], best["x"]) if best else (None, None))


def test_running_state_folds_ties(make):
    e = make([("a", 1, 1.0), ("a", 1, 2.0), ("a", 86_400 * 1_000_000 * 3, 4.0)], "k string, us bigint, x double").selectExpr(
        "k", "timestamp_micros(us) as ts", "x")
    out = running_state(e, ["k"], {"n": Measure("sum", F.lit(1).cast("bigint")), "s": Measure("sum", F.col("x"))})
    assert rows_of(out, "n", "s") == [(2, 3.0), (3, 7.0)]
