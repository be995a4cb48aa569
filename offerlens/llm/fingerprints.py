"""I-Match fingerprints over a lexicon of middling document frequency.

The lexicon holds the terms that a share of `LOW` to `HIGH` of all distinct texts has: such terms tell topics apart and survive small
edits, and copies of a text count once, so that many of them neither push its terms out nor bring them in.  As a document has so many distinct terms on average, at most that number over `LOW` terms can be in it, whatever the corpus.
Several randomised subsets of the lexicon are drawn, 16 at each of five rates; a document's fingerprint has for each subset a hash of
its sorted distinct terms in it, and 0 where it has none.  A text without any lexicon term is fingerprinted by subsets
of all its terms, drawn in the same way, and a hash of them all; where one of two texts is such a one, both are compared by all their terms.  Two fingerprints are alike to the share of subsets, of those where either has terms, on which they agree; rates at which about
half of the subsets are hit weigh most, so that short and long texts are compared at rates that suit them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import words as W
from offerlens.llm.near_dup import BITS, _bitmap
from offerlens.session import materialized

LOW, HIGH, RATES, SUBSETS = 0.001, 0.1, (1, 3, 5, 7, 9), 16
WIDTH = len(RATES) * SUBSETS + 1
BUCKET_BYTES = 1_500_000


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct terms of each document, one after the other, and the document of each."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], doc[first]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text: str = "text") -> np.ndarray:
    """The sorted hashes of the terms whose document frequency lies in the band, counted over all distinct texts.

    Texts whose hash no other row has are counted where they are.  Those that a bitmap of the repeated hashes holds are shuffled, once
    a class and task; what the bitmap holds by chance is only shuffled without need.  Null counts as empty.
    """
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).select(F.xxhash64("t").alias("tk"), "t")
    classes = materialized(rows.groupBy("tk").agg(F.count(F.lit(1)).alias("n")))
    n = classes.count()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for b, piece in _bitmap(classes.filter("n > 1")).items():
        bits[(b - 1) * 4096: b * 4096] = np.frombuffer(piece, np.uint8)
    box = docs.sparkSession.sparkContext.broadcast(bits)

    def held(batch):
        tk = batch.column("tk").to_numpy()
        bit = tk % (1 << BITS)
        return tk, (box.value[bit >> 3] >> (bit & 7) & 1) == 1

    def repeated(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            tk, picked = held(batch)
            first = np.zeros(len(tk), bool)  # of a text's copies in a batch one is enough
            first[np.unique(tk, return_index=True)[1]] = True
            picked &= first & ~np.isin(tk, seen)
            seen = np.concatenate([seen, tk[picked]])[-10_000:]
            for part, _, _ in W.slices(batch.filter(pa.array(picked)), "t"):
                yield part

    def counted(batch):
        for _, buf, offs in W.slices(batch, "t", 4_000_000):
            parts = []
            for at in range(0, len(offs) - 1, 256):
                to = min(at + 256, len(offs) - 1)
                parts.append(_distinct(*W.word_hashes(buf[offs[at]: offs[to]], offs[at: to + 1] - offs[at]))[0])
            terms, df = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df.astype(np.int64))], ["term", "df"])

    def single(batches):
        for batch in batches:
            yield from counted(batch.filter(pa.array(~held(batch)[1])))

    def one_each(batches):
        for batch in batches:
            yield from counted(batch)

    classed = rows.mapInArrow(repeated, "tk bigint, t string").groupBy("tk").agg(F.first("t").alias("t"))
    counts = rows.mapInArrow(single, "term bigint, df bigint").unionByName(classed.mapInArrow(one_each, "term bigint, df bigint"))
    df = counts.groupBy("term").agg(F.sum("df").alias("df"))
    kept = df.filter((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))).select("term").toArrow()
    return np.sort(kept.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _subsets(terms: np.ndarray) -> np.ndarray:
    """For each term the places of the subsets it is drawn for."""
    out = np.zeros((len(terms), WIDTH - 1), bool)
    for j in range(WIDTH - 1):
        out[:, j] = _drawn(terms, j)
    return out


def _drawn(terms: np.ndarray, j: int) -> np.ndarray:
    return W.mix(terms ^ W.mix(np.array([j + 1], np.uint64))) >> np.uint64(64 - RATES[j // SUBSETS]) == 0


def signatures(terms: np.ndarray, drawn: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprints of the documents as numbers of 16 bits, 0 for none; `drawn` has the subsets of the lexicon's terms."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH), np.uint16)
    all_terms, doc = _distinct(*W.word_hashes(buf, offs))
    place = np.searchsorted(terms, all_terms)
    known = place < len(terms)
    known[known] = terms[place[known]] == all_terms[known]

    def put(column, t, d):
        if len(t):
            heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            rank = np.arange(len(d)) - np.repeat(heads, np.diff(np.append(heads, len(d))))
            found = W.mix(np.add.reduceat(t * (2 * rank.astype(np.uint64) + 1), heads)) >> np.uint64(48)
            out[d[heads], column] = np.maximum(found, 1)

    t, d, sets = all_terms[known], doc[known], drawn[place[known]]
    for j in range(WIDTH - 1):
        some = np.flatnonzero(sets[:, j])
        put(j, t[some], d[some])
    bare = np.ones(n, bool)
    bare[d] = False
    rest = bare[doc]
    t, d = all_terms[rest], doc[rest]
    for j in range(WIDTH - 1 if len(t) else 0):
        some = np.flatnonzero(_drawn(t, j))
        put(j, t[some], d[some])
    put(WIDTH - 1, t, d)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike fingerprints are, row by row, from 0 to 1; equal ones are alike to 1."""
    shape = (len(a), len(RATES), SUBSETS)
    x, y = a[:, :-1].reshape(shape), b[:, :-1].reshape(shape)
    either = ((x > 0) | (y > 0)).sum(2)
    agree = ((x == y) & (x > 0)).sum(2)
    hit = ((x > 0).mean(2) + (y > 0).mean(2)) / 2
    weight = hit * (1 - hit) + 1e-6
    share = (weight * agree).sum(1) / np.maximum((weight * either).sum(1), 1e-12)
    return np.where((a == b).all(1), 1.0, share)


def pair_likeness(a: np.ndarray, b: np.ndarray, first: list[str], second: list[str]) -> np.ndarray:
    """The likeness of texts, row by row, from their fingerprints; by all terms where just one of the two has lexicon terms."""
    out = likeness(a, b)
    mixed = np.flatnonzero((a[:, -1] > 0) != (b[:, -1] > 0))
    if len(mixed):
        none, drawn = np.zeros(0, np.uint64), np.zeros((0, WIDTH - 1), bool)
        out[mixed] = likeness(*[_signed([texts[i] for i in mixed], none, drawn) for texts in (first, second)])
    return out


def _signed(texts: list[str], terms: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"])
    return np.concatenate([signatures(terms, drawn, buf, offs) for _, buf, offs in W.slices(batch, "t", 1_000_000)])


def text_of(a: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text."""
    return [r.tobytes().hex() for r in a.astype(">u2")]


def fingerprint_rows(docs: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row, without edited texts and without a shuffle; for use on its own."""
    box = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        drawn = _subsets(box.value)
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t", 1_000_000):
                yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array(text_of(signatures(box.value, drawn, buf, offs)))], ["k", "f"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "k bigint, f string").select(F.col("k").alias(key), F.col("f").alias("fingerprint"))


OUT = "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame, low: float = LOW, high: float = HIGH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is that with the next smaller key, rows that repeat a key by a number of their text, null keys last,
    and the first after the last.  The edited text has its last half replaced by as much of the next document's
    beginning.  Null counts as empty; texts without words share one fingerprint; a single row is its own next; an empty
    table gives an empty result; other columns are ignored.

    Texts go, compressed, to buckets of neighbouring keys, each with the first row of the bucket that follows.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), t.alias("t")).select("k", F.xxhash64("t").alias("tk"), "t")
    terms = lexicon(rows, low, high, "t")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // BUCKET_BYTES))
    splits = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    edges = np.unique(np.array(splits or [], np.int64))
    bucket = len(edges) - _bucket_of(edges)
    firsts = rows.select("k", "tk").withColumn("b", bucket).groupBy("b").agg(
        F.min_by(F.struct("k", "tk"), F.struct(F.coalesce(-F.col("k"), F.lit(2**63 - 1)), "tk")).alias("f")).orderBy("b").collect()  # a row for each bucket
    follows = {r.b: firsts[(i + 1) % len(firsts)].b for i, r in enumerate(firsts)}
    head = {(r.f.k, r.f.tk): before for r in firsts for before in [b for b, f in follows.items() if f == r.b]}
    box = spark.sparkContext.broadcast((terms, edges, head))

    def deal(batches):
        edges, head = box.value[1:]
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for k, tk, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    raw = pack.compress(text.encode())
                    own = len(edges) + 1 if k is None else len(edges) - int(np.searchsorted(edges, k, "right"))
                    out.append((own, k, tk, False, raw))
                    if (k, tk) in head:
                        out.append((head[k, tk], k, tk, True, raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (
                    pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["b", "k", "tk", "tail", "t"])

    def edit(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = box.value[0]
        drawn = _subsets(terms)
        unpack = zstandard.ZstdDecompressor()
        pdf = pdf.sort_values(["tail", "k", "tk"], ascending=[True, False, True], kind="stable", na_position="last")
        n = int((~pdf["tail"]).sum())
        pdf = pdf.iloc[: n + 1]  # of copies of the next bucket's first row one is enough
        out, fingers, last = [], [], None
        texts = (unpack.decompress(x).decode() for x in pdf["t"])
        this = next(texts)
        for i in range(n + 1):
            after = next(texts, "")
            half = len(this) // 2
            out.append((len(this), this, this[: len(this) - half] + after[:half]) if i < n else (0, this, ""))
            this = after
            if len(out) == 64 or i == n:
                found = [_signed([o[column] for o in out], terms, drawn) for column in (1, 2)]
                if last is not None:  # the next text of the last one is the first of these
                    fingers[-1][4].append(pair_likeness(last[0], found[0][:1], [last[1]], [out[0][1]])[0])
                own, whole = found[0], [o[1] for o in out]
                fingers.append((*found, [(o[0], hashlib.sha256(o[2].encode()).hexdigest()) for o in out],
                                pair_likeness(*found, whole, [o[2] for o in out]), list(pair_likeness(own[:-1], own[1:], whole, whole[1:]))))
                last, out = (own[-1:], whole[-1]), []
        own, edited, near = (np.concatenate([f[j] for f in fingers])[:n] for j in (0, 1, 3))
        facts = [x for f in fingers for x in f[2]][:n]
        return pd.DataFrame({"k": pdf["k"].iloc[:n].astype("Int64").to_numpy(), "n_chars": [x[0] for x in facts], "edited_sha256": [x[1] for x in facts],
                             "fingerprint": text_of(own), "edited_fingerprint": text_of(edited),
                             "near_edited": near, "near_next": [x for f in fingers for x in f[4]][:n]})

    dealt = rows.mapInArrow(deal, "b int, k bigint, tk bigint, tail boolean, t binary")
    return dealt.groupBy("b").applyInPandas(edit, OUT).withColumnRenamed("k", key)


def _bucket_of(edges: np.ndarray):
    """How many edges a key is not below, as a column; a null key counts as below all by one more."""
    if not len(edges):
        return F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.lit(0))
    held = F.array(*[F.lit(int(e)) for e in edges])
    return F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.size(F.filter(held, lambda e: e <= F.col("k"))))
