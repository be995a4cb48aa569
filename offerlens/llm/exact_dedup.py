"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so: after 1024 code points at the earliest, behind a vowel and white space that
a letter from a to h follows, and after 8192 at the latest.  Each chunk is replaced where it stands by a 64-bit number and
its SHA-256; the texts themselves are never shuffled.  Chunks of all documents are deduplicated to verified identifiers:
a number that stands for one digest only is the identifier with version 1, and if two digests ever share a number, they
get versions 1, 2, ...  A document's recipe is the ordered list of its identifiers; equal recipes are equal texts.

Hot chunks and hot texts: both groupings combine before the shuffle, and the joins back are left to the adaptive skew
join, which splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.keep import keep_rows, text_number
from offerlens.llm.words import LOWER, UPPER
from offerlens.session import materialized

BOUNDARY = r"(?s).{1024,8192}?(?:[aeiou][\x20\x09-\x0D](?=[a-h])|\z)|.{1,8192}"


def normal_text(text: Column) -> Column:
    """The text with A to Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # lower() changes other letters too, where there are any
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they give the text again; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0))


def recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per row of docs: `uid` (of this call), text_sha256, and `parts`, the digests of its chunks in order; with
    all other columns but the text."""
    normal = docs.withColumn("__t", normal_text(F.col(f"`{text}`")))
    digest = lambda c: F.struct(F.xxhash64(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("sha"))
    return materialized(normal.select(
        F.monotonically_increasing_id().alias("__uid"),
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        F.sha2("__t", 256).alias("__text_sha256"),
        F.transform(chunks(F.col("__t")), digest).alias("__parts")))


def verified(parts: DataFrame) -> DataFrame:
    """From rows (__uid, __parts): the recipe of each row as the ordered list of verified identifiers."""
    each = parts.select("__uid", F.posexplode("__parts").alias("pos", "part")).select("__uid", "pos", "part.n", "part.sha")
    known = each.groupBy("n", "sha").agg(F.count(F.lit(1)).alias("uses"))
    version = F.row_number().over(Window.partitionBy("n").orderBy("sha"))  # one row nearly always: rows are distinct chunks
    known = known.select("n", "sha", version.alias("version"))
    marked = each.join(known, ["n", "sha"]).select("__uid", F.struct("pos", "n", "version").alias("part"))
    ordered = F.transform(F.sort_array(F.collect_list("part")), lambda p: F.struct(p.n.alias("n"), p.version.alias("version")))
    return marked.groupBy("__uid").agg(ordered.alias("__recipe"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A to Z; null counts as empty.  Of equal texts the row with the
    largest key stays; a null key stays only where all are null, and of rows that repeat key and text one stays.
    Empty and null texts have the empty recipe and form one group; an empty table gives an empty result; other columns
    are ignored.
    """
    return _decided(docs, key, text).select(F.col("__key").alias(key), "keep_id", "group_size", "kept", F.col("__text_sha256").alias("text_sha256"))


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = _decided(docs, key, text).filter("kept").select(F.col("__key").cast("bigint").alias("k"), F.col("__tk").alias("tk"))
    return keep_rows(docs, rows, key, text)


def _decided(docs: DataFrame, key: str, text: str) -> DataFrame:
    plain = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), text_number(text).alias("__tk"))
    rows = recipes(plain, "__text")
    lists = verified(rows.select("__uid", "__parts"))
    empty = F.array().cast("array<struct<n:bigint,version:int>>")
    rows = materialized(rows.select("__uid", "__key", "__tk", "__text_sha256").join(lists, "__uid", "left").withColumn(
        "__recipe", F.coalesce("__recipe", empty)))
    groups = rows.groupBy("__recipe").agg(F.max(F.struct("__key", "__uid")).alias("__keep"),
                                          F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "__recipe").withColumn("keep_id", F.col("__keep.__key")).withColumn("kept", F.col("__uid") == F.col("__keep.__uid"))


SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
           as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""
