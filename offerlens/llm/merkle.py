"""A Merkle manifest of documents with nested-interval labels.

Every node of a source's tree carries the interval of leaf ranks that it covers.  A level is built from the one below by
grouping three neighbouring intervals; from the top down, a containment join inside the buckets of a level (a parent's interval
starts at a multiple of its width, so the bucket of a child is its start divided by that width) attaches each node's ancestors,
and the parent's interval without the node's own leaves its siblings, those before and those behind.  The subroots of the sources
are the leaves of one more tree of the same kind.

A level's tables shrink to a third from level to level, a parent holds three children at most, and leaf ranks come from sorted
ranges, so neither a source with most of the rows nor many sources meet in one task.  The driver gets the size of the largest
source and the root.

Defined cases: nulls are hashed as `-` (a null source is a source of its own and comes first, null keys come first in a source);
a null key has no checksum and is not tampered with; rows with one key are ordered by their leaf; wholly equal rows are leaves of their
own; empty and very long texts are hashed whole; a lone leaf is its subroot and a lone subroot the root; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators.numbering import numbered
from offerlens.session import materialized

FANOUT = 3
_STEP = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A field as it is hashed: its UTF-8 byte count, a colon and the value; `-` for null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(nodes: Column) -> Column:
    """The digests of an array of nodes in one string."""
    return F.array_join(F.transform(nodes, lambda n: n["d"]), "")


def leaves_of(docs: DataFrame, fields: list[str], key: str, source: str, text: str) -> DataFrame:
    """(k, s, leaf, seen): the leaf of each row, and the leaf of what is seen of it: line feeds of the text are missing where 2
    divides the checksum of the key."""
    def leaf(t: Column) -> Column:
        return digest(*[field(t if f == text else F.col(f"`{f}`")) for f in fields])

    own = F.col(f"`{text}`")
    tampered = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 2 == 0
    d = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), leaf(own).alias("leaf"),
                    F.when(tampered & own.contains("\n"), leaf(F.replace(own, F.lit("\n"), F.lit("")))).alias("changed"))
    return d.select("k", "s", "leaf", F.coalesce("changed", "leaf").alias("seen"))


def ascend(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The inner levels above (g, lo, hi, n, d) leaves, each with the nodes it was made of, and the top (g, n, d) of each group.

    Level i has intervals of 3^(i+1) leaves; a group ends with the level that covers its n leaves by one node."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, width = [], leaves.select("g", "lo", "hi", "n", "d"), 1
    while width < most:
        below, width = width, width * FANOUT
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "d")))
        nodes = (nodes.filter(F.col("n") > below).groupBy("g", F.floor(F.col("lo") / width).alias("b")).agg(F.max("n").alias("n"), kids.alias("kids"))
                 .select("g", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n",
                         F.sha2(joined(F.col("kids")), 256).alias("d"), "kids"))
        nodes = materialized(nodes)
        levels.append(nodes)
    tops = leaves.filter("n = 1").select("g", "n", "d")
    for level in levels:
        tops = tops.unionByName(level.filter("lo = 0 and hi = n").select("g", "n", "d"))
    return levels, tops


def attach(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with `path`, the siblings before and behind at each level from the leaf up, and the columns of `tops` (g, n,
    path and others), whose path goes on where the group's tree ends."""
    carried = [c for c in tops.columns if c not in ("g", "n")]
    above, width = None, FANOUT ** len(levels)
    for i in range(len(levels), -1, -1):
        # Parents of the nodes of level i: the level above, and the tops of groups that end with this level.
        ended = tops.filter((F.col("n") <= width) & (F.col("n") > width // FANOUT)).withColumns(
            {"lo": F.lit(0).cast("bigint"), "hi": F.col("n"), "kids": F.lit(None).cast("array<struct<lo:bigint,hi:bigint,d:string>>")})
        needed = ["g", "lo", "hi", "kids", *carried]
        parents = ended.select(*needed) if above is None else above.select(*needed).unionByName(ended.select(*needed))
        p = parents.select(F.col("g").alias("pg"), F.floor(F.col("lo") / (width * FANOUT)).alias("pb"), F.col("lo").alias("plo"),
                           F.col("hi").alias("phi"), F.col("kids").alias("pkids"), *[F.col(c).alias(f"p_{c}") for c in carried])
        nodes = levels[i - 1] if i else leaves
        met = nodes.join(p, (F.col("g") == F.col("pg")) & (F.floor(F.col("lo") / (width * FANOUT)) == F.col("pb"))
                         & (F.col("plo") <= F.col("lo")) & (F.col("hi") <= F.col("phi")))
        left = joined(F.filter("pkids", lambda x: x["hi"] <= F.col("lo")))
        right = joined(F.filter("pkids", lambda x: x["lo"] >= F.col("hi")))
        own = F.when(F.col("pkids").isNull(), F.array().cast(_STEP)).otherwise(F.array(F.struct(left.alias("left"), right.alias("right"))))
        above = met.select(*[nodes[c] for c in nodes.columns], F.concat(own, F.col("p_path")).alias("path"),
                           *[F.col(f"p_{c}").alias(c) for c in carried if c != "path"])
        width //= FANOUT
    return above


def folded(start: Column, path: Column) -> Column:
    """What hashing up from `start` through the siblings of the path gives."""
    return F.aggregate(path, start, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, leaf, subroot, root, path, seen): `path` lists the siblings from the leaf to the root as
    (left, right) digests, `seen` is the leaf of the row as it was found, tampered or not."""
    leaves = leaves_of(docs, [key, source, lang, n_chars, text], key, source, text)
    leaves = numbered(leaves, "lo", ["k", "leaf", "seen"], ["s"], "n", "g")
    leaves = materialized(leaves.select("k", "leaf", "seen", "g", "lo", (F.col("lo") + 1).alias("hi"), "n", F.col("leaf").alias("d")))
    levels, tops = ascend(leaves)
    subroots = materialized(numbered(tops.select("g", "n", "d"), "place", "g", None, "sources"))
    upper = subroots.select(F.lit(0).cast("bigint").alias("g"), F.col("place").alias("lo"), (F.col("place") + 1).alias("hi"),
                            F.col("sources").alias("n"), "d", F.col("g").alias("sub_g"), F.col("n").alias("sub_n"))
    upper_levels, root = ascend(upper)
    ends = root.select("g", "n", F.array().cast(_STEP).alias("path"), F.col("d").alias("root"))
    # The root of one tree goes on as the leaf of the next: its path and the digests above flow down with the joins.
    known = attach(upper, upper_levels, ends).select(F.col("sub_g").alias("g"), F.col("sub_n").alias("n"), "path", F.col("d").alias("subroot"), "root")
    return attach(leaves, levels, materialized(known)).select(F.col("k").alias(key), "leaf", "subroot", "root", "path", "seen")


def verify(proofs: DataFrame) -> DataFrame:
    """The manifest with proof_sha256 (digest of all siblings in order), folded_root (from `seen` and the siblings) and
    verified (whether that is the root)."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = proofs.withColumns({"proof_sha256": proof, "folded_root": folded(F.col("seen"), F.col("path"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "seen")


SQL = """
WITH RECURSIVE steps AS (SELECT r AS b, list_reduce([CAST(r AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
        lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(r)),
lookup AS (SELECT list(v ORDER BY b) AS t FROM steps),
sums AS (SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), lookup),
fields AS (SELECT d.doc_id, d.source, d.text, crc, concat(coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-'),
        coalesce(strlen(d.source) || ':' || d.source, '-'), coalesce(strlen(d.lang) || ':' || d.lang, '-'),
        coalesce(strlen(CAST(d.n_chars AS VARCHAR)) || ':' || d.n_chars, '-')) AS head
    FROM documents d LEFT JOIN sums USING (doc_id)),
leaf AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(CASE WHEN crc % 2 = 0 THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
                                     ELSE strlen(text) || ':' || text END, '-')) AS seen FROM fields),
ranked AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaf),
node AS (SELECT g, 0 AS lvl, i, n, leaf AS d FROM ranked
    UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY g, lvl, i // 3, n),
top AS MATERIALIZED (SELECT g AS place, d, count(*) OVER () AS s FROM node WHERE n = 1),
unode AS (SELECT 0 AS lvl, place AS i, s AS n, d FROM top
    UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM unode WHERE n > 1 GROUP BY lvl, i // 3, n),
side AS MATERIALIZED (SELECT a.g, a.lvl, a.i, a.n, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM node a JOIN node b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.i, a.n),
uside AS MATERIALIZED (SELECT a.lvl, a.i, a.n, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM unode a JOIN unode b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.lvl, a.i, a.n),
walk AS (SELECT g, i AS lf, i, 0 AS lvl, n, seen AS acc, '' AS proof FROM ranked
    UNION ALL SELECT w.g, w.lf, w.i // 3, w.lvl + 1, (w.n + 2) // 3, sha256(s.l || w.acc || s.r), w.proof || s.l || s.r
    FROM walk w JOIN side s ON w.g = s.g AND w.lvl = s.lvl AND w.i = s.i),
uwalk AS (SELECT g, lf, g AS i, 0 AS lvl, (SELECT max(s) FROM top) AS n, acc, proof FROM walk WHERE n = 1
    UNION ALL SELECT w.g, w.lf, w.i // 3, w.lvl + 1, (w.n + 2) // 3, sha256(s.l || w.acc || s.r), w.proof || s.l || s.r
    FROM uwalk w JOIN uside s ON w.lvl = s.lvl AND w.i = s.i)
SELECT r.doc_id, r.leaf, t.d AS subroot, u.d AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = u.d AS verified
FROM ranked r JOIN uwalk w ON w.g = r.g AND w.lf = r.i AND w.n = 1 JOIN top t ON t.place = r.g CROSS JOIN (SELECT d FROM unode WHERE n = 1) u
"""
