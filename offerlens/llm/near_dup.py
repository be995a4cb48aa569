"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's set holds the hashes of its distinct word shingles; its sketch the k smallest.  Documents with equal sets form
   a class, and only classes go on: copies are never expanded into pairs.
2. Two sets of Jaccard similarity J share at least `t` of the k smallest values of their union, except with a chance
   below `MISS` (see `needed`); sets that fit into the sketch share a certain number.  Each value of the union's k smallest that both hold is
   in both sketches.  So with one order of the values, rare ones first, two similar sketches meet among the first
   s - t + 1 of their s values, and only those go to the inverted lists.  Common passages seldom get there.
3. The full sets of the classes that meet another there go to inverted lists of their own, now by the exact form of that
   rule: sets of n shingles that share the wanted part of their union meet among the first n - t + 1 of their shingles, rare ones
   first, where t is that part of n.  The places at which two sets meet bound what they can share; pairs that cannot reach the
   similarity are never made.
4. Lists give links without pairing all members: each list's most shared class, and one drawn by hash, are compared to all
   others of the list.  Links merge classes to components, and only what the lists still hold in different components is
   paired, so no link between different components is lost.
5. A pair goes on if the sketch of its union has `t` shared values, and is a link if the full sets confirm it.

The full sets are read again from the texts for those classes only, picked by a bitmap of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm import words as W
from offerlens.llm.keep import keep_rows, text_number
from offerlens.session import materialized

KEPT, MISS, BITS = 64, 1e-6, 24


def needed(k: int, percent: int, miss: float = MISS) -> int:
    """The largest t such that of the k smallest of a union fewer than t are shared with a chance below `miss`.

    They are a draw without repeats from a union of which at least `percent` % is shared; a draw with repeats misses
    more often, and its binomial tail is summed here.
    """
    j, tail, t = percent / 100, 0.0, 0
    while True:
        tail += math.comb(k, t) * j**t * (1 - j) ** (k - t)
        if tail >= miss:
            return t
        t += 1


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer words than a shingle count as one shingle of all."""
    h, at = W.word_hashes(buf, offs)
    n = len(h)
    full = W.chain(*[h[i: n - size + 1 + i] for i in range(size)]) if n >= size else h[:0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a: b - size + 1].view(np.int64))
        elif b > a:
            yield W.chain(*[h[i: i + 1] for i in range(a, b)], np.full(1, b - a, np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    u = s.view(np.uint64)
    return tuple(int(W.mix(u ^ np.uint64(c)).sum().view(np.int64)) for c in (0x51ED2701, 0xA5A5F00D)) if len(u) else (0, 0)


def sketched(docs: DataFrame, size: int, k: int, key: str, text: str) -> DataFrame:
    """(key, tk, n, d1, d2, sketch) for each row: a number of the text, the set's size, its identity and its k smallest."""
    schema = "k bigint, tk bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>"

    def run(batches):
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t"):
                found = [(len(s), *_digests(s), s[:k]) for s in shingle_sets(buf, offs, size)]
                n, d1, d2, low = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([
                    rows.column("k"), rows.column("tk"), *[pa.array(x, pa.int64()) for x in (n, d1, d2)],
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, low)]), pa.int32()), pa.array(np.concatenate(low)))],
                    ["k", "tk", "n", "d1", "d2", "sketch"])

    return _rows(docs, key, text).mapInArrow(run, schema)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), text_number(text).alias("tk"), t.alias("t"))


def _bitmap(numbers: DataFrame) -> dict[int, bytes]:
    """A bitmap of 2^BITS bits that has the bit of each number, in pieces of 4 KB; 2 MB at most."""
    bit = F.pmod("tk", F.lit(1 << BITS)) + 1
    rows = numbers.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(
        F.bitmap_construct_agg("p").alias("bits")).collect()
    return {r.b: bytes(r.bits) for r in rows}


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(cid, s) for the classes `wanted` (cid, d1, d2, tk): their sets, made anew from one text of each."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for b, piece in _bitmap(wanted).items():
        bits[(b - 1) * 4096: b * 4096] = np.frombuffer(piece, np.uint8)
    box = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            tk = batch.column("tk").to_numpy()
            bit = tk % (1 << BITS)  # of a texts' copies in a batch one is enough
            first = np.zeros(len(tk), bool)
            first[np.unique(tk, return_index=True)[1]] = True
            picked = first & ((box.value[bit >> 3] >> (bit & 7) & 1) == 1) & ~np.isin(tk, seen)
            seen = np.concatenate([seen, tk[picked]])[-10_000:]
            for _, buf, offs in W.slices(batch.filter(pa.array(picked)), "t"):
                sets = list(shingle_sets(buf, offs, size))
                d1, d2 = zip(*map(_digests, sets), strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))],
                    ["d1", "d2", "s"])

    found = _rows(docs, key, text).select("tk", "t").mapInArrow(run, "d1 bigint, d2 bigint, s array<bigint>")
    return materialized(found.join(wanted.select("cid", "d1", "d2"), ["d1", "d2"]).groupBy("cid").agg(F.any_value("s").alias("s")))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end of the edges (a, b): the smallest number in its component.

    Labels are lowered to the least of the neighbours' and then to the label's own label, until none changes; each round is
    written to the shared folder.
    """
    both = materialized(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = materialized(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(now, both.b == now.v).groupBy("a").agg(F.min("root").alias("near"))
        low = now.join(near, now.v == near.a).select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        top = now.select(F.col("v").alias("u"), F.col("root").alias("up"))
        new = materialized(low.join(top, low.root == top.u).select("v", "was", F.least("root", "up").alias("root")))
        if new.filter("root <> was").isEmpty():
            return new.select("v", "root")
        now = new.select("v", "root")


def _enough(i: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * i >= percent * (a + b - i)


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of class numbers that are links."""
    c = classes.select("cid", "n", "sketch")
    for end in "ab":
        pairs = pairs.join(c.select(F.col("cid").alias(end), F.col("n").alias("n" + end), F.col("sketch").alias("s" + end)), end)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    least = F.least(F.lit(needed(k, percent)), F.ceil(F.size("sa") * F.lit(percent) / 100), F.ceil(F.size("sb") * F.lit(percent) / 100))
    near = materialized(pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).filter(shared >= least).select("a", "b"))
    for end in "ab":
        near = near.join(sets.select(F.col("cid").alias(end), F.col("s").alias("f" + end)), end)
    return near.filter(_enough(F.size(F.array_intersect("fa", "fb")), F.size("fa"), F.size("fb"), percent)).select("a", "b")


def _prefixes(values: DataFrame, size: DataFrame) -> DataFrame:
    """(value, cid, hits, rest, n): the values of each class that another class holds too and that stand, rare ones first, in its prefix.

    `size` has (cid, n, t): the number of values and how many a partner must share.  Values that no other class holds are first
    in the order; `hits` counts the shared ones, `rest` the values from this one on.
    """
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    values = values.join(shared, "value")  # a hot value is split by the adaptive join
    mine = Window.partitionBy("cid")  # as many rows as a sketch or a document has values
    values = values.select("value", "cid", F.row_number().over(mine.orderBy("df", "value")).alias("r"), F.count(F.lit(1)).over(mine).alias("hits"))
    values = values.filter(F.col("r") <= F.col("hits")).join(size, "cid")
    return values.filter(F.col("hits") - F.col("r") >= F.col("t") - 1).select(
        "value", "cid", "hits", (F.col("hits") - F.col("r") + 1).alias("rest"), "n")


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int, k: int, key: str, text: str) -> DataFrame:
    """(cid, root) of every class that is linked with another."""
    part = lambda n: F.ceil(n * F.lit(percent) / 100)
    s = F.size("sketch")
    sketches = _prefixes(classes.select("cid", F.explode("sketch").alias("value")),
                         classes.select("cid", s.alias("n"), F.least(F.lit(needed(k, percent)), part(s)).alias("t")))
    met = _of_two(materialized(sketches.select("value", "cid")), "cid").select("cid").distinct()
    wanted = materialized(met.join(classes, "cid").select("cid", "d1", "d2", "tk", "n", "sketch"))
    sets = full_sets(docs, wanted, size, key, text)
    lists = materialized(_prefixes(sets.select("cid", F.explode("s").alias("value")), wanted.select("cid", "n", part(F.col("n")).alias("t"))))
    lists = materialized(_of_two(lists, "cid"))

    draw = F.xxhash64("value", "cid")
    member = F.struct("cid", "rest", "n")
    hubs = lists.groupBy("value").agg(F.max_by(member, F.struct("hits", "cid")).alias("first"), F.max_by(member, F.struct(draw, "cid")).alias("drawn"))
    other = hubs.select("value", F.explode(F.array_distinct(F.array("first", "drawn"))).alias("h")).select(
        "value", F.col("h.cid").alias("cid2"), F.col("h.rest").alias("rest2"), F.col("h.n").alias("n2"))
    possible = F.least("rest", "rest2") * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    pair = [F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")]
    found = materialized(lists.join(other, (lists.value == other.value) & (F.col("cid") != F.col("cid2")) & possible).select(*pair).distinct())
    links = materialized(confirmed(found, wanted, sets, percent, k))
    roots = components(links)

    rest = lists.join(roots.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rest = materialized(_of_two(materialized(rest), "root"))
    other = rest.select(F.col("value").alias("value2"), F.col("cid").alias("cid2"), F.col("root").alias("root2"), F.col("rest").alias("rest2"), F.col("n").alias("n2"))
    apart = rest.join(other, (F.col("value") == F.col("value2")) & (F.col("cid") < F.col("cid2")) & (F.col("root") != F.col("root2")) & possible)
    apart = materialized(apart.select(*pair).distinct().join(found, ["a", "b"], "left_anti"))
    late = materialized(confirmed(apart, wanted, sets, percent, k))
    if not late.isEmpty():
        roots = components(links.union(late))
    return roots.select(F.col("v").alias("cid"), "root")


def _of_two(lists: DataFrame, column: str) -> DataFrame:
    """The lists whose members differ in the column."""
    apart = lists.groupBy("value").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo < hi").select("value")
    return lists.join(apart, "value", "left_semi")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = KEPT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, n_shingles, component_id, kept, tk, component).

    Words and letters as in `words`; a set holds the distinct shingles of `size` words, or all words as one where there
    are fewer.  Documents whose sets are equal or share at least `percent` % of their union are linked; `component_id`
    is the smallest key that links reach, and the rows with that key are `kept`.  Texts without words (null, empty, white space) are linked
    with nothing: their component is their own key.  A null key is never the smallest of several.  Rows that repeat a key
    and text are equal sets.  An empty table gives an empty result; other columns are ignored.  `tk` is a number of the text,
    `component` one of the component (null for texts without words).
    """
    rows = materialized(sketched(docs, size, k, key, text))
    some = rows.filter("n > 0")
    classes = materialized(some.groupBy("d1", "d2", "n").agg(
        F.min("k").alias("least"), F.min("tk").alias("tk"), F.any_value("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()))
    roots = linked_classes(docs, classes, size, percent, k, key, text)
    named = classes.select("cid", "d1", "d2", "n", "least").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialized(named)
    joined = roots.select("root").distinct().join(named, "root").groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(joined, "root", "left").select("d1", "d2", "n", "root", F.coalesce("component_id", "least").alias("component_id"))
    out = some.drop("sketch").join(named, ["d1", "d2", "n"]).select("k", "n", "component_id", "tk", "root").union(
        rows.filter("n = 0").select("k", "n", F.col("k").alias("component_id"), "tk", F.lit(None).cast("bigint")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id",
                      F.col("k").eqNullSafe(F.col("component_id")).alias("kept"), "tk", F.col("root").alias("component"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs with the smallest key of their component, one for each, and those without words."""
    found = near_duplicates(docs, size, percent, key=key, text=text, **options).withColumnRenamed(key, "k")
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "tk")).alias("f"))
    kept = first.select("f.k", "f.tk").union(found.filter("component is null").select("k", "tk"))
    return keep_rows(docs, kept, key, text)
