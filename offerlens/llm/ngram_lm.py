"""Texts scored by a bigram model whose n-grams lie in Elias-Fano tries, split over shards.

No task ever holds the vocabulary or the model.  Texts become blocks of some megabytes: token numbers within the block and the
block's own words, written once.  Blocks ask for the distinct things they hold and never for the same thing twice, so
a word or a pair that a third of all texts has costs a shard one entry for each block:

1. Words: each block sends its distinct words with their counts in training texts to the shard of the word's hash; shards sum and
   answer with count and rank.  A word's number is its rank by count class over all shards, so the number alone tells the class, and with it
   the unigram probability, quantised to a thousand classes and rounded down.
2. Pairs: each block sends its distinct pairs of known words, with counts in training texts and the documents that hold them, to
   the shard of the first word; a word with many uses is split over shards by the second.  A shard lays the pairs seen in training
   out as a trie (contexts, monotone pointers, successors relative to their context, one byte of quantised log probability each),
   maps it into memory, looks up all pairs asked for, and returns a sum for each document of each block.

Smoothing: p(w|v) = (c(v,w) + MU p(w)) / (c(v) + MU), with p(w) = (c(w) - d) / N for known words and the mass d V / N for
the unknown word; each text starts in a context of its own and ends with an end token.  Quantising rounds down, so the model never gives more
than a total of one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import words as W
from offerlens.llm.elias_fano import Trie
from offerlens.session import materialized

FOLDS, LEFT_OUT = 7, 2
BLOCK_BYTES, CELLS, MU = 4_000_000, 4096, 1000.0
WORDS_A_SHARD, PAIRS_A_SHARD, SPLIT = 1_500_000, 2_500_000, 100_000
STEP, CLASSES = 1.03, 1024
END = np.uint64(0x5DEECE66D1234567)

_LOWEST = np.unique(np.ceil(STEP ** np.arange(CLASSES)).astype(np.float64)).astype(np.int64)  # the least count of each class


def _class(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LOWEST, count, "right") - 1


def _pack(a: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed: high bytes that are mostly 0 cost little."""
    a = np.ascontiguousarray(a)
    return bytes([a.dtype.itemsize]) + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    size = raw[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(f"<u{size}").ravel().astype(kind)


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows with missing values as null in the columns of a schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of whole documents: their keys, which are held out, token numbers in the block, and the block's words."""
    schema = "block bigint, k array<bigint>, no_key array<boolean>, held array<boolean>, n array<int>, codes binary, vocab binary, train binary, cells binary, n_words bigint, n_tokens bigint"

    def run(batches):
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t", BLOCK_BYTES):
                block += 1
                h, at = W.word_hashes(buf, offs)
                n = np.diff(at) + 1
                ends = np.cumsum(n) - 1
                tokens = np.empty(len(h) + len(n), np.uint64)
                inner = np.ones(len(tokens), bool)
                inner[ends] = False
                tokens[inner], tokens[ends] = h, END
                vocab, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")  # frequent words have small numbers
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                vocab, code = vocab[order], rank[code]
                held = rows.column("held").to_numpy(zero_copy_only=False)
                train = np.bincount(code[np.repeat(~held, n)], minlength=len(vocab))
                yield pa.RecordBatch.from_pylist([{
                    "block": block, "k": rows.column("k").fill_null(0).to_pylist(), "no_key": rows.column("k").is_null().to_pylist(), "held": held.tolist(), "n": n.tolist(), "codes": _pack(_narrow(code)),
                    "vocab": vocab.tobytes(), "train": _pack(_narrow(train)), "cells": _pack((vocab >> np.uint64(52)).astype(np.uint16)),
                    "n_words": len(vocab), "n_tokens": len(tokens)}], schema=arrow)

    arrow = pa.schema([("block", pa.int64()), ("k", pa.list_(pa.int64())), ("no_key", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())),
                       *[(c, pa.binary()) for c in ("codes", "vocab", "train", "cells")], ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    left_out = F.coalesce(F.crc32(F.col("k").cast("string")) % FOLDS == LEFT_OUT, F.lit(False))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).withColumn("held", left_out)
    return materialized(rows.mapInArrow(run, schema))


def _ask_words(shards: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vocab, train = np.frombuffer(r["vocab"], np.uint64), _unpack(r["train"], "i8")
                shard = (vocab >> np.uint64(52)).astype(np.int64) % shards
                out = [(s, r["block"], vocab[shard == s].tobytes(), _pack(_narrow(train[shard == s]))) for s in np.unique(shard).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (
                    pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "words", "train"])
    return run


def _answer_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts and ranks for each block's words; and a row (block -1) with the number of the shard's words in each class."""
    shard = int(pdf["shard"].iloc[0])
    asked = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
    known, inv = np.unique(np.concatenate(asked), return_inverse=True)
    count = np.bincount(inv, np.concatenate([_unpack(t, "i8") for t in pdf["train"]]), len(known)).astype(np.int64)
    kind = np.where(count > 0, _class(np.maximum(count, 1)), -1)
    order = np.lexsort((known, kind))
    sizes = np.bincount(kind[kind >= 0], minlength=len(_LOWEST))
    rank = np.empty(len(known), np.int64)
    start = np.searchsorted(kind[order], np.arange(-1, len(_LOWEST)))
    rank[order] = np.arange(len(known)) - start[kind[order] + 1]
    edges = np.cumsum([0, *map(len, asked)])
    out = [(shard, int(b), _pack(_narrow(count[inv[i:j]])), _pack(_narrow(rank[inv[i:j]])), 0)
           for b, i, j in zip(pdf["block"], edges[:-1], edges[1:], strict=True)]
    out.append((shard, -1, _pack(sizes.astype(np.int64)), b"", int(count.sum())))
    return pd.DataFrame(out, columns=["shard", "block", "count", "rank", "total"])


class Unigrams:
    """What every task needs of the words: totals, and where the numbers of each class start in each shard."""

    def __init__(self, sizes: dict[int, np.ndarray], total: int, texts: int, shards: int):
        table = np.zeros((len(_LOWEST), shards), np.int64)
        for s, n in sizes.items():
            table[:, s] = n
        flat = table[::-1].ravel()  # frequent classes first, then by shard
        self.first = (np.cumsum(flat) - flat).reshape(table.shape)[::-1]
        self.n, self.v, self.texts, self.shards = total, int(table.sum()), texts, shards
        one, two = int(table[0].sum()), int(table[1].sum())
        self.discount = one / (one + 2 * two) if one else 0.5
        starts = self.first[:, 0][::-1]
        self.starts, self.kinds = starts, np.arange(len(_LOWEST))[::-1]

    def kind(self, number: np.ndarray) -> np.ndarray:
        """The count class of a word from its number alone."""
        return self.kinds[np.searchsorted(self.starts, number, "right") - 1]

    def log_p(self, kind: np.ndarray) -> np.ndarray:
        """log10 p(w) by class, rounded down; -1 is the unknown word."""
        unknown = math.log10(self.discount * self.v / self.n) if self.n else 0.0
        if not self.n:
            return np.full(len(kind), unknown)
        return np.where(kind >= 0, np.log10((_LOWEST[np.maximum(kind, 0)] - self.discount) / self.n), unknown)

    def uses(self, number: np.ndarray) -> np.ndarray:
        """c(v) of a context, rounded up to its class; the number V is the start of a text."""
        inner = np.minimum(number, max(self.v - 1, 0))
        above = np.append(_LOWEST[1:] - 1, _LOWEST[-1])[self.kind(inner)] if self.v else np.zeros(len(number), np.int64)
        return np.where(number >= self.v, self.texts, above)


ASK = ("shard int, block bigint, k array<bigint>, no_key array<boolean>, held array<boolean>, n array<int>, known array<int>, base array<double>, score array<double>, "
       "pairs binary, train binary, uses binary, docs binary")


def _ask_pairs(box, pair_shards: int, mu: float):
    def run(key, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        uni: Unigrams = box.value
        r = mine.iloc[0]
        codes, cells = _unpack(r["codes"], "i8"), _unpack(r["cells"], "i8") % uni.shards
        count, number, kind = (np.zeros(len(cells), np.int64) for _ in range(3))
        kind -= 1
        for s, c, k in zip(answers["shard"], answers["count"], answers["rank"], strict=True):
            at = np.flatnonzero(cells == s)
            count[at] = _unpack(c, "i8")
            rank = _unpack(k, "i8")
            known = count[at] > 0
            kind[at[known]] = _class(count[at[known]])
            number[at[known]] = uni.first[kind[at[known]], s] + rank[known]
        n = np.asarray(r["n"], np.int64)
        heads = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x[codes], heads)
        base = add(np.log10((count + 1) / (uni.n + uni.v + 1)))
        token = np.where(count > 0, number, -1)[codes]
        context = np.append(-1, token[:-1])  # the start of a text is the context number V
        context[heads] = uni.v
        score = add(uni.log_p(kind))
        if uni.texts:  # an unknown word in a known context is in no shard; the weight of the fallback is known here
            lost = np.flatnonzero((token < 0) & (context >= 0))
            weight = np.zeros(len(token))
            weight[lost] = np.log10(mu / (uni.uses(context[lost]) + mu))
            score += np.add.reduceat(weight, heads)
        rows = [{"shard": int(r["block"]) % pair_shards, "block": r["block"], "k": r["k"], "no_key": r["no_key"], "held": r["held"], "n": r["n"],
                 "known": add((count > 0).astype(np.int64)).astype(np.int32), "base": base, "score": score}]

        # Pairs of known tokens.
        doc = np.repeat(np.arange(len(n)), n)
        some = (token >= 0) & (context >= 0) if uni.texts else np.zeros(len(token), bool)
        width = uni.v + 1
        pair = context[some] * width + token[some]
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], doc[some][order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        uses = np.diff(np.append(first, len(pair)))
        pair = pair[first]
        learnt = ~np.asarray(r["held"], bool)[doc] if len(doc) else np.zeros(0, bool)
        train = np.add.reduceat(learnt.astype(np.int64), first) if len(first) else first
        v, w = np.divmod(pair, width)
        part = w % (1 + uni.uses(v) // SPLIT)
        shard = (W.mix((v * 1_000_003 + part).astype(np.uint64)) % np.uint64(pair_shards)).astype(np.int64)
        spread = np.repeat(shard, uses)
        for s in np.unique(shard).tolist():
            at = shard == s
            rows.append({"shard": s, "block": r["block"], "pairs": _pack(_narrow(np.diff(pair[at], prepend=0))), "train": _pack(_narrow(train[at])),
                         "uses": _pack(_narrow(uses[at])), "docs": _pack(_narrow(doc[spread == s]))})
        return _frame(rows, ASK)
    return run


SUMS = "block bigint, k array<bigint>, no_key array<boolean>, held array<boolean>, n array<int>, known array<int>, base array<double>, score array<double>, gain binary"


def pair_trie(uni: Unigrams, v: np.ndarray, w: np.ndarray, count: np.ndarray, mu: float) -> tuple[bytes, np.ndarray]:
    """The trie of a shard's training pairs (sorted) and the log10 probabilities that its codes stand for."""
    logs = np.log10((count + mu * 10 ** uni.log_p(uni.kind(w))) / (uni.uses(v) + mu)) if len(v) else np.zeros(0)
    book = np.linspace(logs.min(), logs.max(), 256) if len(logs) else np.zeros(256)
    code = np.clip(np.searchsorted(book, logs, "right") - 1, 0, 255)  # the next value below
    return Trie.layout(v, w, code), book


def _answer_pairs(box, mu: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uni: Unigrams = box.value
        out = pdf[pdf["k"].notna()][["block", "k", "no_key", "held", "n", "known", "base", "score"]].to_dict("records")
        asked = pdf[pdf["pairs"].notna()]
        pairs = [np.cumsum(_unpack(p, "i8")) for p in asked["pairs"]]
        if pairs:
            known, inv = np.unique(np.concatenate(pairs), return_inverse=True)
            count = np.bincount(inv, np.concatenate([_unpack(t, "i8") for t in asked["train"]]), len(known)).astype(np.int64)
            v, w = np.divmod(known, uni.v + 1)
            seen = count > 0
            raw, book = pair_trie(uni, v[seen], w[seen], count[seen], mu)
            code = Trie.mapped(raw).find(v, w)
            # What the pair adds to the unigram score: its own probability instead, or the weight of the fallback.
            gain = np.where(code >= 0, book[code] - uni.log_p(uni.kind(w)), np.log10(mu / (uni.uses(v) + mu)))
            at = 0
            for block, p, uses, docs in zip(asked["block"], pairs, asked["uses"], asked["docs"], strict=True):
                each = np.repeat(gain[inv[at: at + len(p)]], _unpack(uses, "i8"))
                out.append({"block": block, "gain": np.bincount(_unpack(docs, "i8"), each).tobytes()})
                at += len(p)
        return _frame(out, SUMS)
    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    r = pdf[pdf["k"].notna()].iloc[0]
    score = np.array(r["score"], float)
    for g in pdf["gain"].dropna():
        g = np.frombuffer(g)
        score[: len(g)] += g
    keys = pd.array(r["k"], "Int64")
    keys[np.asarray(r["no_key"], bool)] = pd.NA
    return pd.DataFrame({"k": keys, "held_out": r["held"], "n_tokens": r["n"], "n_known": r["known"],
                         "base_score": r["base"], "score": score})


def score_documents(docs: DataFrame, mu: float = MU, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the texts whose crc32 of the key as text leaves another remainder by 7 than 2 (a null key is learnt
    from); scores all.  Null and empty texts are one end token.  `base_score` is the add-one unigram score, `score` the model's log10 probability.
    Repeated rows count each; without training texts all words are unknown; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    table = blocks(docs, key, text)
    counts = table.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)),
                       F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(CELLS, max(tasks, -(-int(counts[0]) // WORDS_A_SHARD)))
    pair_shards = max(tasks, -(-int(counts[1]) // PAIRS_A_SHARD))
    asked = table.select("block", "vocab", "train").mapInArrow(_ask_words(shards), "shard int, block bigint, words binary, train binary")
    answers = materialized(asked.groupBy("shard").applyInPandas(_answer_words, "shard int, block bigint, count binary, rank binary, total bigint"))
    # A row for each shard with the sizes of its classes.
    own = answers.filter("block = -1").collect()
    uni = Unigrams({r.shard: _unpack(bytes(r["count"]), "i8") for r in own}, sum(r.total for r in own), int(counts[2]), shards)
    box = spark.sparkContext.broadcast(uni)
    texts = table.select("block", "k", "no_key", "held", "n", "codes", "cells").groupBy("block")
    pairs = texts.cogroup(answers.filter("block >= 0").groupBy("block")).applyInPandas(_ask_pairs(box, pair_shards, mu), ASK)
    sums = pairs.groupBy("shard").applyInPandas(_answer_pairs(box, mu), SUMS)
    rows = sums.groupBy("block").applyInPandas(_total, "k bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return rows.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(uni.n).cast("bigint").alias("train_tokens"), "base_score", "score")
