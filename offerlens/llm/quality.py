"""Document quality from random-indexing word vectors and a two-layer network.

Every run of letters, digits or other signs is a word, hashed to one of `BUCKETS` vectors; so the vectors have a fixed size
whatever the vocabulary.  Each bucket has a random index vector (few +1 and -1); a word's vector is the sum of the index vectors of
its neighbours, two on either side, over the whole corpus, scaled to length 1.  A document pools the vectors of its words: their mean
and spread, and three figures of the document itself (length, share of distinct words, share of words that
repeat the one before).  A network of two layers in NumPy, fitted on a bounded sample of labelled rows, gives a logit;
a temperature fitted on rows it has not seen makes it a probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import labelled
from offerlens.llm import words as W
from offerlens.session import materialized

BUCKETS, DIM, NONZERO, REACH, PIECES = 8192, 32, 2, 2, 16
ONES, ZEROS, HIDDEN, EPOCHS = 10_000, 10_000, 32, 60


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def _buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, at = W.kind_hashes(buf, offs)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int32), at


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors of all buckets, from all texts: a matrix of fixed size, summed by tasks and then by pieces of rows."""
    places, signs = index_vectors()

    def run(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for _, buf, offs in W.slices(batch, "t", 1_000_000):
                b, at = _buckets(buf, offs)
                doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
                for step in range(1, REACH + 1):
                    same = doc[step:] == doc[:-step]
                    left, right = b[:-step][same], b[step:][same]
                    for z in range(NONZERO):
                        for mine, other in ((left, right), (right, left)):
                            total += np.bincount(mine * DIM + places[other, z], signs[other, z], BUCKETS * DIM)
        rows = total.astype(np.int64).reshape(PIECES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["piece", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in pdf["v"])
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "v": [total.tobytes()]})

    parts = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "piece int, v binary")
    # Sums in two steps, so that no task adds up the parts of all others.
    fold = parts.withColumn("fold", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("piece", "fold").applyInPandas(add, "piece int, v binary")
    out = np.zeros((PIECES, BUCKETS * DIM // PIECES))
    for r in fold.groupBy("piece").applyInPandas(add, "piece int, v binary").collect():  # PIECES rows, two megabytes together
        out[r.piece] = np.frombuffer(r.v, np.int64)
    out = out.reshape(BUCKETS, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 3


def pool(vectors: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The features of each document; a document without words has zeros."""
    b, at = _buckets(buf, offs)
    n = np.diff(at)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = n > 0
    if not some.any():
        return out
    heads, count = at[:-1][some], n[some].astype(np.float32)[:, None]
    v = vectors[b]
    mean = np.add.reduceat(v, heads, axis=0) / count
    np.square(v, out=v)
    spread = np.sqrt(np.maximum(np.add.reduceat(v, heads, axis=0) / count - mean**2, 0))
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    pairs = np.sort(doc * BUCKETS + b)
    fresh = np.append(True, pairs[1:] != pairs[:-1])
    distinct = np.bincount(pairs[fresh] // BUCKETS, minlength=len(n))[some]
    again = np.append(False, (b[1:] == b[:-1]) & (doc[1:] == doc[:-1])).astype(np.float32)
    out[some] = np.hstack([mean, spread, np.log1p(count), distinct[:, None] / count, np.add.reduceat(again, heads)[:, None] / count])
    return out


class Network:
    """Standardised inputs, one hidden layer, one logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.shift, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        apart = order[: len(x) // 5]  # for the temperature only
        learn = order[len(x) // 5:] if len(x) >= 50 else order
        x = (x - self.shift) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for _ in range(EPOCHS if len(x) else 0):
            for at in range(0, len(learn), 256):
                i = learn[at: at + 256]
                t += 1
                for k, g in enumerate(self._gradient(x[i], y[i])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if len(apart) >= 10:
            z = self._forward(x[apart])[1]
            losses = {q: np.logaddexp(0, np.where(y[apart] >= 0.5, -z / q, z / q)).mean() for q in np.geomspace(0.3, 10, 60)}
            self.temperature = float(min(losses, key=losses.get))

    def _forward(self, x):
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        return h, h @ self.p[2] + self.p[3]

    def _gradient(self, x, y):
        h, z = self._forward(x)
        e = (1 / (1 + np.exp(-z)) - y) / len(x)
        back = np.outer(e, self.p[2]) * (h > 0)
        return [x.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ e + 1e-4 * self.p[2], e.sum(keepdims=True)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self._forward((x - self.shift) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, ones: int = ONES, zeros: int = ZEROS,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, held_out, score, predicted).

    The network learns from `ones` and `zeros` labelled rows at most, none of them held out; the word vectors
    from all texts.  Null and empty texts pool to zeros and get the network's score for that; without labels the score is that
    of an untrained network; null keys, repeated rows and other columns change nothing; an empty table gives an empty result.
    """
    vectors = word_vectors(docs, text)
    box = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM numbers

    def pooled(batches):
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t", 1_000_000):
                x = pool(box.value, buf, offs)
                yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "x"])

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))
    rows = materialized(source.mapInArrow(pooled, "k bigint, x binary"))
    known = labelled.sample(labelled.label_table(labels, label).join(rows.select("k").distinct(), "k", "left_semi"), ones, zeros)
    got = known.join(rows, "k").groupBy("k").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("k").collect()  # ones + zeros rows at most
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], float).reshape(-1, FEATURES)
    y = np.array([r.y for r in got])
    network = Network(x, y)

    def scored(batches):
        for batch in batches:
            x = np.array([np.frombuffer(v, np.float32) for v in batch.column("x").to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(network.probability(x))], ["k", "score"])

    return rows.mapInArrow(scored, "k bigint, score double").select(
        F.col("k").alias(key), labelled.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
