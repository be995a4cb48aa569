"""Strict as-of lookups: what was known about a key before an instant, equal instants excluded.

Time is cut into buckets.  A key's events are folded per instant before the shuffle; whole earlier buckets arrive as one
running total, and only the query's own bucket is walked instant by instant.  A key that owns a large share of all rows
is therefore spread over its buckets instead of landing in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions.constants import DAY_US
from offerlens.functions.exprs import micros


@dataclass(frozen=True)
class Measure:
    """A running value: `how` is sum, min or max; `value` is an expression on the events."""

    how: str
    value: Column

    def fold(self, c: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.how](c)

    def combine(self, a: Column, b: Column) -> Column:
        if self.how == "sum":
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        if self.how == "min":
            return F.when(a.isNull() | (b < a), b).otherwise(a)
        return F.when(a.isNull() | (b > a), b).otherwise(a)


def asof_measures(queries: DataFrame, events: DataFrame, keys: list[str], measures: dict[str, Measure],
                  query_time: str = "ts", event_time: str = "ts", bucket_us: int = DAY_US) -> DataFrame:
    """Add to each query row the measures over the events of its keys strictly before its time (null without any).

    Null keys match null keys.  `bucket_us` is the width of a time bucket; narrow it where one key is hot within a day.
    """
    names = list(measures)
    folded = (events.select(*keys, micros(event_time).alias("_us"), *[m.value.alias(n) for n, m in measures.items()])
              .groupBy(*keys, "_us").agg(*[measures[n].fold(F.col(n)).alias(n) for n in names]))
    types = dict(folded.dtypes)
    bucket = F.floor(F.col("_us") / F.lit(bucket_us)).cast("bigint").alias("_bucket")
    folded = folded.select("*", bucket)
    payload = [c for c in queries.columns if c not in keys]
    asked = queries.select(*keys, micros(query_time).alias("_us"), F.struct(*payload).alias("_query")).select("*", bucket)

    # Events and queries share one exchange by key and bucket: both readers below ask for the same columns of it, so
    # Spark runs it once.
    query_type = dict(asked.dtypes)["_query"]
    rows = folded.select(*keys, "_bucket", "_us", F.lit(None).cast(query_type).alias("_query"), *names).unionByName(
        asked.select(*keys, "_bucket", "_us", "_query", *[F.lit(None).cast(types[n]).alias(n) for n in names]))
    rows = rows.repartition(*[F.col(k) for k in keys], F.col("_bucket"))

    # Totals of whole buckets, queried buckets without events included; then a running total over a key's buckets.
    totals = rows.groupBy(*keys, "_bucket").agg(
        *[measures[n].fold(F.col(n)).alias(n) for n in names], F.max("_us").alias("_seen"), F.count("_query").alias("_asked"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_bucket", "_asked", *[
        measures[n].fold(F.col(n)).over(earlier).alias(f"_c_{n}") for n in names]).filter("_asked > 0").drop("_asked")

    # The query's own bucket, instant by instant.
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    walked = rows.select(*keys, "_bucket", "_query", *[measures[n].fold(F.col(n)).over(inside).alias(f"_w_{n}")
                                                       for n in names]).filter(F.col("_query").isNotNull())
    on = [walked[k].eqNullSafe(carried[k]) for k in [*keys, "_bucket"]]
    joined = walked.join(carried, on, "left")
    return joined.select(*[walked[k] for k in keys], F.col("_query.*"),
                         *[measures[n].combine(F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n in names])


def asof_latest(queries: DataFrame, states: DataFrame, keys: list[str], query_time: str = "ts",
                state_time: str = "state_time", bucket_us: int = DAY_US) -> DataFrame:
    """Attach the columns of the latest state row strictly before each query's time.

    Where a key has several states at one instant the largest row is taken; fold such states beforehand.
    """
    payload = [c for c in states.columns if c not in (*keys, state_time)]
    latest = Measure("max", F.struct(micros(state_time).alias("_t"), *[F.col(c) for c in payload]))
    out = asof_measures(queries, states, keys, {"_latest": latest}, query_time, state_time, bucket_us)
    return out.select(*keys, *[c for c in queries.columns if c not in keys],
                      F.timestamp_micros("_latest._t").alias(state_time),
                      *[F.col(f"_latest.{c}").alias(c) for c in payload])


def running_state(events: DataFrame, keys: list[str], measures: dict[str, Measure], ts: str = "ts",
                  bucket_us: int = DAY_US) -> DataFrame:
    """One row per key and instant with the measures over all events up to and including it (equal instants folded)."""
    names = list(measures)
    folded = (events.select(*keys, F.col(ts), *[m.value.alias(n) for n, m in measures.items()])
              .groupBy(*keys, ts).agg(*[measures[n].fold(F.col(n)).alias(n) for n in names])
              .withColumn("_bucket", F.floor(micros(ts) / F.lit(bucket_us)).cast("bigint")))
    totals = folded.groupBy(*keys, "_bucket").agg(*[measures[n].fold(F.col(n)).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_bucket", *[measures[n].fold(F.col(n)).over(earlier).alias(f"_c_{n}")
                                                for n in names])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    walked = folded.select(*keys, "_bucket", ts, *[measures[n].fold(F.col(n)).over(inside).alias(f"_w_{n}")
                                                   for n in names])
    on = [walked[k].eqNullSafe(carried[k]) for k in [*keys, "_bucket"]]
    return walked.join(carried, on, "left").select(
        *[walked[k] for k in keys], walked[ts].alias("state_time"),
        *[measures[n].combine(F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n in names])
