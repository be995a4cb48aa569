"""Toxicity from subword bags averaged into a linear softmax.

A word is a run of letters, digits and bytes above ASCII in lower case, with a mark at either end; its subwords are the runs
of 3 to 5 bytes of it, each hashed to one of `BUCKETS` vectors.  The vectors of a window of 4 words are averaged and go to a
softmax of two classes; vectors and softmax are trained jointly in NumPy on all windows of a bounded sample of labelled
documents.  A misspelt or inflected word that the training never saw shares most of its subwords with the word it comes from.
A document's probability comes from its most toxic window and the mean of its windows, weighed by a logistic regression on
the whole texts of sampled documents that the vectors were not trained on.  So toxic words count for as much in a long text as in a short one.

The softmax is linear in the averaged vectors, so scoring needs one number for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import labelled
from offerlens.llm import words as W
from offerlens.session import materialized

BUCKETS, DIM, SIZES, WINDOW = 1 << 17, 8, (3, 4, 5), 4
ONES, ZEROS, EPOCHS, BATCH = 1500, 2500, 6, 1024
CHUNK, HELD = 2048, 1 << 16  # windows in a row of the sample, and held at once while learning

_PART = np.zeros(256, np.uint8)  # bytes of words; all others are the mark between words
for _b in (*range(97, 123), *range(48, 58), *range(128, 256)):
    _PART[_b] = _b
for _b in range(65, 91):
    _PART[_b] = _b + 32


def subwords(buf: np.ndarray, offs: np.ndarray):
    """(buckets, valid) of the subwords that start at each place, for each length, and the places where windows start, with
    the first window of each document.  Texts are laid out with a mark around each."""
    n = len(offs) - 1
    ends = offs[1:] + np.arange(1, n + 1)  # a mark behind each text
    text = np.zeros(len(buf) + n + 1, np.uint8)
    keep = np.ones(len(text), bool)
    keep[0] = False
    keep[ends] = False
    text[keep] = _PART[buf]
    inside = text > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    first_word = np.searchsorted(starts, np.append(0, ends))
    number = np.arange(len(starts)) - np.repeat(first_word[:-1], np.diff(first_word))
    heads = np.flatnonzero(number % WINDOW == 0)
    windows = starts[heads] - 1  # with the mark before the word
    first_window = np.searchsorted(heads, first_word)
    grams = []
    h = text.astype(np.uint32)
    middle = np.ones(len(text), bool)  # all bytes strictly inside the run belong to a word
    for size in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + text[size - 1:]
        if size > 2:
            middle = middle[: len(h)] & inside[size - 2: size - 2 + len(h)]
        else:
            middle = middle[: len(h)]
        if size in SIZES:
            spread = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * size)
            grams.append(((spread >> np.uint32(32 - 17)).astype(np.int32), middle))
    return grams, windows, first_window, len(text)


def window_logits(value: np.ndarray, bias: float, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the largest and the mean logit of its windows; a document without words has the bias for both."""
    grams, windows, first, n = subwords(buf, offs)
    out = np.full((2, len(offs) - 1), bias)
    if not len(windows):
        return out[0], out[1]
    total, count = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for bucket, valid in grams:
        total[: len(bucket)] += np.where(valid, value[bucket], np.float32(0))
        count[: len(bucket)] += valid
    logit = np.add.reduceat(total, windows) / np.maximum(np.add.reduceat(count, windows), 1) + bias
    some = np.diff(first) > 0
    heads = first[:-1][some]
    out[0, some] = np.maximum.reduceat(logit, heads)
    out[1, some] = np.add.reduceat(logit, heads) / np.diff(first)[some]
    return out[0], out[1]


def bags(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all windows one behind the other, how many each window has, and the first window of each document."""
    grams, windows, first, _ = subwords(buf, offs)
    places = [np.flatnonzero(valid) for _, valid in grams]
    window = np.concatenate([np.searchsorted(windows, at, "right") - 1 for at in places])
    ids = np.concatenate([bucket[at] for (bucket, _), at in zip(grams, places, strict=True)])
    order = np.argsort(window, kind="stable")
    return ids[order], np.bincount(window, minlength=len(windows)), first


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of several runs, one behind the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Softmax:
    """Subword vectors and a two-class softmax over their average; `value` and `bias` are the difference of the logits."""

    def __init__(self, seed: int = 9):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.weights, self.offset = self.rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.seen = [np.full(p.shape, 1e-8, np.float32) for p in (self.vectors, self.weights, self.offset)]

    def learn(self, ids: np.ndarray, counts: np.ndarray, y: np.ndarray) -> None:
        """A pass over windows in random order: their buckets one behind the other, how many each has, their labels."""
        starts = np.cumsum(counts) - counts
        order = self.rng.permutation(np.flatnonzero(counts))
        for at in range(0, len(order), BATCH):
            some = order[at: at + BATCH]
            n = counts[some]
            own, inside = np.unique(ids[ranges(starts[some], n)], return_inverse=True)  # only vectors of the batch are touched
            v = self.vectors[own]
            heads = np.cumsum(n) - n
            mean = np.add.reduceat(v[inside], heads, axis=0) / n[:, None].astype(np.float32)
            z = mean @ self.weights + self.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = ((p - np.stack([1 - y[some], y[some]], 1)) / len(some)).astype(np.float32)
            back = np.repeat((e @ self.weights.T) / n[:, None].astype(np.float32), n, axis=0)
            dv = np.stack([np.bincount(inside, back[:, k], len(own)) for k in range(DIM)], 1).astype(np.float32)
            dw, db = mean.T @ e, e.sum(0)
            seen = self.seen[0][own] + dv * dv
            self.seen[0][own] = seen
            self.vectors[own] = v - 0.3 * dv / np.sqrt(seen)
            for p_, g, s, rate in ((self.weights, dw, self.seen[1], 0.1), (self.offset, db, self.seen[2], 0.1)):
                s += g * g
                p_ -= rate * g / np.sqrt(s)

    @property
    def value(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    @property
    def bias(self) -> float:
        return float(self.offset[1] - self.offset[0])


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's steps with a small penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, ones: int = ONES, zeros: int = ZEROS,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, held_out, score, predicted).

    The model learns from the whole texts of `ones` and `zeros` labelled documents at most, none of them held out; every text is
    scored whole.  Texts without words (null, empty) get the score of the bias;
    without labels the score is that of an untrained model; null keys, repeated rows and other columns change nothing; an empty
    table gives an empty result.
    """
    value, bias, weights = learnt(docs, labels, label, ones, zeros, key, text)
    box = docs.sparkSession.sparkContext.broadcast(value)  # BUCKETS numbers

    def scored(batches):
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t", 1_000_000):
                yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array(probability(box.value, bias, weights, buf, offs))], ["k", "score"])

    return _source(docs, key, text).mapInArrow(scored, "k bigint, score double").select(
        F.col("k").alias(key), labelled.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, ones: int = ONES, zeros: int = ZEROS,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs below the threshold, with all their columns and without a shuffle."""
    value, bias, weights = learnt(docs, labels, label, ones, zeros, key, text)
    box = docs.sparkSession.sparkContext.broadcast(value)

    def kept(batches):
        for batch in batches:
            for rows, buf, offs in W.slices(batch, text, 1_000_000):
                yield rows.filter(pa.array(probability(box.value, bias, weights, buf, offs) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def probability(value: np.ndarray, bias: float, weights: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    top, mean = window_logits(value, bias, buf, offs)
    return 1 / (1 + np.exp(-np.clip(weights[0] * top + weights[1] * mean + weights[2], -50, 50)))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))


def learnt(docs: DataFrame, labels: DataFrame, label: str, ones: int, zeros: int, key: str, text: str) -> tuple[np.ndarray, float, np.ndarray]:
    """From a bounded sample of labelled documents: a value for each bucket, the bias, and the document weights (max, mean, intercept).

    The driver sees the windows of the sample as a stream of rows of `CHUNK` windows at most and holds about `HELD` windows at a time,
    however long the texts are.
    """
    source = _source(docs, key, text)
    # The sample is chosen among keys; their texts are then read by a filter that holds the sampled keys only.
    table = labelled.label_table(labels, label).join(source.select("k").distinct(), "k", "left_semi")
    chosen = labelled.sample(table, ones, zeros).withColumn("o", F.xxhash64("k", F.lit(13))).collect()  # ones + zeros rows at most
    chosen.sort(key=lambda r: (r.o, r.k))
    apart = {r.k: r.y for i, r in enumerate(chosen) if i % 4 == 0}
    learn = {r.k: r.y for i, r in enumerate(chosen) if i % 4 or len(chosen) < 40}

    def texts(keys: dict[int, float]) -> DataFrame:
        """One text for each key: of several the one with the least hash."""
        picked = source.filter(F.col("k").isin(list(keys))) if keys else source.limit(0)
        return picked.groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x")).select("k", "x.t")

    def bagged(batches):
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t", 1_000_000):
                ids, counts, first = bags(buf, offs)
                ends = np.append(0, np.cumsum(counts))
                for k, a, b in zip(rows.column("k").to_pylist(), first[:-1], first[1:], strict=True):
                    for at in range(a, b, CHUNK):
                        to = min(b, at + CHUNK)
                        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "c": pa.array([at - a], pa.int64()),
                                                          "w": [ids[ends[at]: ends[to]].tobytes()], "n": [counts[at:to].astype(np.int32).tobytes()]})

    windows = materialized(texts(learn).mapInArrow(bagged, "k bigint, c bigint, w binary, n binary")).orderBy(F.xxhash64("k", "c"), "k", "c")
    model = Softmax()
    for _ in range(EPOCHS if learn else 0):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for r in windows.toLocalIterator():
            n = np.frombuffer(r.n, np.int32).astype(np.int64)
            held.append((np.frombuffer(r.w, np.int32), n, np.full(len(n), learn[r.k], np.float32)))
            size += len(n)
            if size >= HELD:
                model.learn(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            model.learn(*map(np.concatenate, zip(*held, strict=True)))
        del held
    value, bias = model.value, model.bias
    del model
    box = docs.sparkSession.sparkContext.broadcast(value)

    def rated(batches):
        for batch in batches:
            for rows, buf, offs in W.slices(batch, "t", 1_000_000):
                yield pa.RecordBatch.from_arrays([rows.column("k"), *map(pa.array, window_logits(box.value, bias, buf, offs))], ["k", "top", "mean"])

    # The same numbers as in scoring: the largest and the mean logit of all windows, two for each document.
    z = texts(apart).mapInArrow(rated, "k bigint, top double, mean double").orderBy("k").toArrow()
    x = np.stack([z["top"].to_numpy(), z["mean"].to_numpy()], 1)
    return value, bias, regression(x, np.array([apart[k] for k in z["k"].to_pylist()]))
