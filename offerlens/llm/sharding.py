"""Documents into shards by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Groups of equal texts are the items.  Groups that hold more than 1/(64 shards) of any total are placed one by one (three
times 64 for each shard at most); all others are dealt by hash to parcels of eight graded weights.  So the driver places a number of
items that the parameters bound, whatever the corpus holds: the largest first, each on the shard whose residual capacity
has the highest dot product with the item, and small parcels last to even out.  A group too large for a shard is split by
hash of the key into parts that fit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.words import WORD
from offerlens.session import materialized

LEVELS, PER_LEVEL, FINE = 8, 512, 64


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows: shares of the totals), largest first, by dot product with residual capacity.

    The byte column counts sixteen times, since equal bytes are the promise and the others the aim.
    """
    weight = np.array([16.0] + [1.0] * (items.shape[1] - 1))
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    where = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))) if len(items) else ():
        fits = (left + 1e-12 >= items[i]).all(axis=1)
        score = left @ (weight * items[i])
        where[i] = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        left[where[i]] -= items[i]
    return where


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, size, text_crc32, law, shard, slot, grown_shard, tokens).

    `size` is the text's UTF-8 bytes plus 1, `law` is 'bytes': sizes of the shards are near equal.  `slot` numbers a
    shard's rows from 0 without gaps.  Null text counts as empty; empty texts form a group; null keys and repeated rows
    are placed like others, and a number of the row parts those of one key; a text longer than a shard's share fills a shard of its own;
    ties of groups go by their hash; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialized(docs.select(
        F.col(f"`{key}`").alias("k"), t.alias("t")).select(
        "k", (F.octet_length("t") + F.lit(1)).cast("bigint").alias("size"),
        F.crc32("t").alias("text_crc32"), F.regexp_count("t", F.lit(WORD)).cast("bigint").alias("tokens"),
        F.xxhash64("t").alias("g"), F.xxhash64(F.col("k"), F.monotonically_increasing_id()).alias("spread")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    totals = [max(1, int(x)) for x in total]

    # The parcel of a light group: level by halving shares, then one of the level's parcels.
    level = F.least(F.lit(LEVELS - 1), F.length(F.regexp_extract(F.lpad(F.bin(F.pmod(F.col("g"), F.lit(1 << 20))), 20, "0"), "^0*", 0)))
    parcel = level * PER_LEVEL + F.pmod(F.shiftright("g", 24), F.lit(PER_LEVEL))
    groups = rows.groupBy("g").agg(F.sum("size").alias("a"), F.sum("tokens").alias("b"), F.count(F.lit(1)).alias("c"))
    share = F.greatest(*[F.col(c) / F.lit(float(n)) for c, n in zip("abc", totals, strict=True)])
    groups = materialized(groups.withColumn("share", share))
    bound = 1.0 / (FINE * shards)
    heavy = groups.filter(F.col("share") > bound).orderBy(F.desc("share"), "g").collect()  # 3 * FINE * shards rows at most
    light = (groups.filter(F.col("share") <= bound).groupBy(parcel.alias("p")).agg(*[F.sum(c).alias(c) for c in "abc"])
             .orderBy("p").collect())  # LEVELS * PER_LEVEL rows at most
    # A group above a shard's capacity goes in parts, eight for each shard that it would fill.
    pieces = [(r.g, math.ceil(8 * r.share * shards) if r.share * shards > 1 else 1) for r in heavy]
    split = spark.createDataFrame(pieces, "g bigint, n int")
    labels, vectors = [], []
    cut = rows.join(F.broadcast(split.filter("n > 1")), "g").groupBy("g", F.pmod("spread", "n").cast("int").alias("p")).agg(
        F.sum("size").alias("a"), F.sum("tokens").alias("b"), F.count(F.lit(1)).alias("c"))
    for r in sorted([*cut.collect(), *({"g": r.g, "p": 0, "a": r.a, "b": r.b, "c": r.c} for r in heavy if r.share * shards <= 1)], key=lambda r: (r["g"], r["p"])):
        labels.append((r["g"], r["p"]))
        vectors.append([r[c] / x for c, x in zip("abc", totals, strict=True)])
    for r in light:
        labels.append((int(r.p), -1))
        vectors.append([r[c] / x for c, x in zip("abc", totals, strict=True)])
    where = place(np.array(vectors).reshape(-1, 3), shards)

    placed = spark.createDataFrame([(a, b, int(s)) for (a, b), s in zip(labels, where, strict=True)], "item bigint, piece int, shard int")
    rows = rows.join(F.broadcast(split), "g", "left")
    rows = rows.withColumn("item", F.when(F.col("n").isNull(), parcel.cast("bigint")).otherwise(F.col("g")))
    rows = rows.withColumn("piece", F.when(F.col("n").isNull(), -1).otherwise(F.pmod("spread", "n").cast("int")))
    rows = rows.join(F.broadcast(placed), ["item", "piece"])

    # Slots: rows are numbered within many small parts of a shard; the parts' sizes give where each part starts.
    parts = max(16, math.ceil(totals[2] / (shards * 20_000)))
    rows = materialized(rows.withColumn("part", F.pmod(F.shiftright("spread", 8), F.lit(parts)))
                        .select("k", "size", "text_crc32", "tokens", "shard", "part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "part").orderBy("k", "text_crc32")))
    return numbered.join(starts, ["shard", "part"]).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("r") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
