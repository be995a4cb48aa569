"""Sources mixed to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times.  The whole part is certain; the fractional parts
are rounded in pairs: mass (copies times words) moves from one document to the other, in a random direction with the
chances that keep every expectation, until one of the two is whole.  The source's total mass never changes in a pair, so only
the last undecided document of a source moves its total; in the last group of a source single changes of mind then bring the total as
near to the target as they can.  Documents are paired within hash parts of a source, in falling
size, so that what is left over is small; what is left over of the parts is paired again in a tree with fixed fan-in.
A source of any size, also one with a third of all rows, is split over as many parts as its rows need.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.words import WORD
from offerlens.session import materialized

PART_ROWS, FAN_IN, EPS = 4096, 64, 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for each row (source, source_size).

    Sources by code point, null last, have the weights in turn and share the total; a target stops at `most` times its
    source's size and the excess goes to the others by weight.  Filling all targets to one level per weight says that at once:
    in rising order of limit per weight, the level is the rest of the total over the rest of the weights at the first
    source that it doesn't fill.  The table has a row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weight = F.sum("source_size").over(every), F.sum("w").over(every)
    t = t.withColumn("level", (total - F.coalesce(F.sum("limit").over(past), F.lit(0.0)))
                     / (weight - F.coalesce(F.sum("w").over(past), F.lit(0.0))))
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))
    t = t.withColumn("first", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.least("limit", F.col("first") * F.col("w")).alias("target"))


def _undecided(p: np.ndarray) -> np.ndarray:
    return (p > EPS) & (p < 1 - EPS)


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities, given in falling order of size; returns them and the place of the one still undecided (-1: none).

    Each document in turn is paired with the next few, taken together, as soon as these can give or take all the mass that
    makes it whole; they share the transfer by size.  Those for which the rest is too small are paired one with one at
    the end.  Every step keeps all expectations and the total mass.
    """
    p = p.copy()
    n, late = len(p), []
    for j in range(n):
        if not EPS < p[j] < 1 - EPS:
            p[j] = round(p[j])
            continue
        up, down, m = (1 - p[j]) * size[j], p[j] * size[j], 2
        while True:
            rest = slice(j + 1, min(n, j + 1 + m))
            free = _undecided(p[rest])
            q, mass = p[rest][free], size[rest][free].sum()
            if len(q) and up <= q.min() * mass and down <= (1 - q.max()) * mass:
                taken = rng.random() < p[j]
                p[rest] = np.where(free, p[rest] + (-up if taken else down) / mass, p[rest])
                p[j] = float(taken)
                break
            if j + 1 + m >= n:
                late.append(j)
                break
            m *= 2
    open_at = -1
    for i in late:
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        up = min((1 - p[i]) * size[i], p[j] * size[j])   # mass that can move from j to i
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if rng.random() * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        open_at = i if EPS < p[i] < 1 - EPS else j if EPS < p[j] < 1 - EPS else -1
    done = ~_undecided(p)
    p[done] = np.round(p[done])
    return p, open_at


def settle(p: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounded probabilities whose total mass is as near to the one before rounding as single changes of mind bring it.

    While it helps, the document whose other choice leaves the least of what is missing or too much takes it, first ones on
    ties; only documents that had a choice are looked at.  This serves the last group of a source, where no other
    document is left to take up a large one's mass.
    """
    p, free = p.copy(), np.flatnonzero(_undecided(before))
    missing = float((before * size).sum() - (p * size).sum())
    while len(free):
        change = np.where(p[free] > 0.5, -size[free], size[free])
        after = np.abs(missing - change)
        best = int(after.argmin())
        if after[best] >= abs(missing) - EPS:
            break
        p[free[best]] = 1 - p[free[best]]
        missing -= change[best]
    return p


SCHEMA = "k bigint, tag bigint, source string, size bigint, source_size bigint, target double, whole int, p double, part bigint, open boolean"


def _round(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k", "tag"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        name = pdf["source"].iloc[0]
        rng = np.random.default_rng([seed, 0 if name is None else zlib.crc32(name.encode()) + 1, int(pdf["part"].iloc[0]) + 1, int(last)])
        before, size = pdf["p"].to_numpy(float), np.maximum(pdf["size"].to_numpy(float), 1e-300)
        p, left = pivot(before, size, rng)
        pdf["open"] = False
        if last:
            if left >= 0:
                p[left] = float(rng.random() < p[left])
            p = settle(p, before, size)
        elif left >= 0:
            pdf.loc[left, "open"] = True
        pdf["p"] = p
        return pdf
    return run


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 17, key: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: (key, size, source_size, target, taken, copies, tag).

    `size` counts the words of a text (null: 0), `copies` says how often the mix takes the row, `taken` is copies times
    size.  A row without words has copies 1 if its source's share reaches a whole copy, else 0; it moves no total.  Null is a
    source of its own.  Draws depend on seed, source and the rows alone, so reruns agree whatever the partitions.  Rows
    that repeat a key are rounded one by one.  An empty table gives an empty result.
    """
    c = lambda name: F.col(f"`{name}`")
    size = F.coalesce(F.regexp_count(c(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = materialized(docs.select(c(key).cast("bigint").alias("k"), row_tag(key, text, source).alias("tag"),
                                    c(source).cast("string").alias("source"), size.alias("size")))
    sizes = materialized(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    goal = targets(sizes.select("source", "source_size"), weights, most)
    goal = materialized(goal.join(sizes.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    most_rows = goal.agg(F.max("n")).first()[0] or 0

    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    parts = F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("bigint")
    g = goal.withColumnRenamed("source", "s2")
    rows = rows.join(g, F.col("source").eqNullSafe(F.col("s2"))).select(
        "k", "tag", "source", "size", "source_size", "target",
        F.floor(share + F.lit(EPS)).cast("int").alias("whole"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), share - F.floor(share + F.lit(EPS)))).otherwise(F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("k", "tag"), parts).alias("part"), F.lit(True).alias("open"))

    done, left, n = [], rows, -(-most_rows // PART_ROWS)
    while True:
        last = n <= 1
        out = materialized(left.groupBy("source", "part").applyInPandas(_round(seed, last), SCHEMA))
        done.append(out.filter(~F.col("open")))
        if last:
            break
        left = out.filter("open").withColumn("part", F.floor(F.col("part") / FAN_IN))
        n = -(-n // FAN_IN)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    copies = F.col("whole") + F.round("p").cast("int")
    return result.select(F.col("k").alias(key), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                         copies.alias("copies"), "tag")


def row_tag(key: str, text: str, source: str):
    """A number that tells rows apart by content; equal for equal rows."""
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(f"`{source}`"), F.lit(1))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Rows that are equal in key, text and source share their copies; where such rows differ in other columns, one of them stands
    for all.
    """
    draws = mix(docs, key=key, text=text, source=source, **options).groupBy(F.col("tag").alias("__tag")).agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter("__copies > 0")
    joined = docs.withColumn("__tag", row_tag(key, text, source)).join(draws, "__tag")
    one = joined.filter("__rows = 1").unionByName(joined.filter("__rows > 1").dropDuplicates(["__tag"]))
    return one.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
