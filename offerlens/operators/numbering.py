"""Row numbers, order statistics and medians without sorting a whole table in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions.exprs import day_number, micros
from offerlens.session import materialized

_PLACES = 33  # row numbers inside a partition take so many low bits of Spark's increasing ids


def numbered(df: DataFrame, name: str, order: str | list[str], group: list[str] | None = None, with_size: str | None = None,
             with_first: str | None = None) -> DataFrame:
    """Add 0-based positions in `order` within each group (the whole table without one); nulls come first.

    The rows are cut into sorted ranges by Spark and written once; the rows of a group in the ranges before are added to a
    row's place in its own range.  What is shifted is one row for each range and group in it, so no task sees more than a
    range, whatever the size of a group.  `order` must be unique within a group for a stable result, and ranges can't part
    equal keys.  `with_size` names a column for the rows of the group, `with_first` one for a number of the group: unique
    and rising in the order of the groups.
    """
    group = group or []
    keys = [*group, *([order] if isinstance(order, str) else order)]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = materialized(ranges).withColumn("_range", F.shiftright("_id", _PLACES))
    held = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_at"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = materialized(held.select(*group, "_range", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
                                    F.sum("_n").over(whole).alias("_size"), F.min("_at").over(whole).alias("_first")))
    joined = rows.join(held, [rows[k].eqNullSafe(held[k]) for k in [*group, "_range"]])
    extra = [F.col(c).cast("bigint").alias(n) for c, n in (("_size", with_size), ("_first", with_first)) if n]
    return joined.select(*[rows[c] for c in df.columns], (F.col("_id") - F.col("_at") + F.col("_shift")).cast("bigint").alias(name), *extra)


def day_histogram(df: DataFrame, ts: str) -> list[tuple[int, int, int, int]]:
    """(day, rows, first instant, last instant) in day order: the calendar of a table, one row per day."""
    rows = df.filter(F.col(ts).isNotNull()).groupBy(day_number(ts).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(micros(ts)).alias("lo"), F.max(micros(ts)).alias("hi")).collect()
    return sorted((r["d"], r["n"], r["lo"], r["hi"]) for r in rows)


def times_at_positions(df: DataFrame, ts: str, positions: list[int],
                       days: list[tuple[int, int, int, int]] | None = None) -> list[int]:
    """The event times (epoch micros) at 0-based positions of the time-sorted table.

    Day counts locate the day of each position, counts per second its second, counts per instant the answer, so no step
    ranks more rows than a day has seconds or a second has microseconds.  The driver receives one row per day and the
    answers.
    """
    days = day_histogram(df, ts) if days is None else days
    wanted = []
    for position in positions:
        seen = 0
        for day, n, *_ in days:
            if position < seen + n:
                break
            seen += n
        wanted.append((day, position - seen))
    out = []
    for day, place in wanted:
        # From the day to the second holding the place, from the second to the instant.
        inside = df.filter(day_number(ts) == day)
        second = F.floor(micros(ts) / F.lit(1_000_000)).cast("bigint")
        found, rest = _first_reaching(inside, second, place)
        out.append(_first_reaching(inside.filter(second == found), micros(ts), rest)[0])
    return out


def _first_reaching(df: DataFrame, key: Column, place: int) -> tuple[int, int]:
    """The smallest key whose running count passes `place`, and the place left within that key."""
    counts = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.select("k", "n", upto.alias("upto")).filter(F.col("upto") > place)
    row = hit.agg(F.min(F.struct("k", "n", "upto")).alias("x")).first()["x"]
    return row["k"], place - (row["upto"] - row["n"])


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of `value` per key (mean of the middle two), nulls skipped.

    Equal values are counted before the shuffle by key, so a key costs its distinct values and not its rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return middle_of_counts(counts, keys, value, name)


def middle_of_counts(counts: DataFrame, keys: list[str], value: str, name: str, below: Column | None = None,
                     total: Column | None = None) -> DataFrame:
    """The median of (keys, value, _n) counts; for counts of a middle part only, `below` gives the rows before it and
    `total` all rows of the key."""
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_n").over(by_value) + (below if below is not None else F.lit(0))
    size = total if total is not None else F.sum("_n").over(Window.partitionBy(*keys))
    placed = counts.select(*keys, value, "_n", upto.alias("_upto"), size.alias("_size"))
    lower_rank = F.floor((F.col("_size") + 1) / 2)
    upper_rank = F.floor(F.col("_size") / 2) + 1

    def at(rank: Column) -> Column:
        inside = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
        return F.max(F.when(inside, F.col(value)))

    return placed.groupBy(*keys).agg(((at(lower_rank) + at(upper_rank)) / 2.0).alias(name))


def _ordered_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the doubles; both zeros are one value."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.uint64(bits).view(np.float64))


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of many numeric columns of one table (None for a column without values; null and NaN don't count).

    Radix select: doubles become 64-bit keys in the same order, and four passes count the next 16 bits of the keys that share
    the bits found so far, for all columns and both middle ranks at once.  A pass sends 65,536 counts a rank and task at most,
    so neither the rows nor repeats of a value make a step larger.  The driver receives a few numbers for each column.
    """
    if not columns:
        return {}
    table = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = table.agg(*[F.count(c).alias(c) for c in table.columns]).first()
    ranks = {(i, half): r for i in range(len(columns)) if sizes[i] for half, r in ((0, (sizes[i] - 1) // 2), (1, sizes[i] // 2))}
    prefix = dict.fromkeys(ranks, 0)
    for step in range(4 if ranks else 0):
        shift = 48 - 16 * step
        wanted: dict[int, list[int]] = {}
        for (i, _), p in prefix.items():
            wanted.setdefault(i, [])
            if p not in wanted[i]:
                wanted[i].append(p)

        def counted(batches, wanted=wanted, shift=shift):
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for i, prefixes in wanted.items():
                    keys = _ordered_keys(b.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                    for p in prefixes:
                        own = keys if shift == 48 else keys[keys >> np.uint64(shift + 16) == np.uint64(p)]
                        n = np.bincount((own >> np.uint64(shift)).astype(np.int64) & 0xFFFF, minlength=1 << 16)
                        total[i, p] = total.get((i, p), 0) + n
            for (i, p), n in total.items():
                digits = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(digits), i, np.int32)), "p": pa.array(np.full(len(digits), p, np.uint64).view(np.int64)),
                                                  "d": pa.array(digits.astype(np.int32)), "n": pa.array(n[digits].astype(np.int64))})

        counts = table.mapInArrow(counted, "i int, p bigint, d int, n bigint").groupBy("i", "p", "d").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i", "p").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
        asked = df.sparkSession.createDataFrame([(i, half, int(np.uint64(prefix[i, half]).view(np.int64)), r) for (i, half), r in ranks.items()],
                                                "i int, half int, p bigint, r bigint")
        found = (counts.withColumn("upto", upto).join(asked, ["i", "p"]).filter("upto > r and upto - n <= r")
                 .select("i", "half", "d", (F.col("r") - F.col("upto") + F.col("n")).alias("r")).collect())
        for f in found:
            prefix[f.i, f.half] = prefix[f.i, f.half] << 16 | f.d
            ranks[f.i, f.half] = f.r
    value = {at: _value_of(p) for at, p in prefix.items()}
    return {c: (value[i, 0] + value[i, 1]) / 2.0 if (i, 0) in value else None for i, c in enumerate(columns)}
