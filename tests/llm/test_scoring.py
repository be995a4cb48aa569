"""Classifiers by held-out accuracy, the n-gram model against brute force, Elias-Fano sequences against search."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from offerlens.llm import ngram_lm, quality, toxicity
from offerlens.llm.elias_fano import EliasFano, Trie
from tests.llm import corpora


def spoilt(word, rnd):
    i = rnd.randrange(1, len(word))
    return word[:i] + word[i - 1] + word[i:]


def labelled(spark, n=600):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = corpora.words(rnd, rnd.randrange(30, 200)).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for j in range(0, len(w), 20):
                w[j] = rnd.choice(corpora.BAD) if i % 5 else spoilt(rnd.choice(corpora.BAD), rnd)
        if not good:
            w = [f"{x} ###" for x in w]
        rows.append(corpora.row(i, " ".join(w)))
        labels.append((i, int(good), int(toxic), "clash"))
    rows += [r for r in corpora.odd_rows() if r[0] is None or r[0] >= 100 and r[0] < 104]
    labels += [(None, 1, 0, ""), (3, None, None, ""), (5, 1, 0, ""), (10**6, 0, 1, "")]
    return corpora.frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    for scores, wrong in ((quality.quality_scores(docs, labels), lambda i: i % 3 == 0), (toxicity.toxicity_scores(docs, labels), lambda i: i % 4 != 0)):
        got = scores.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
        held = [r for r in got if r.held_out]
        assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
        right = [r.predicted == (0 if wrong(r.doc_id) else 1) for r in held if r.doc_id < 600 and (r.doc_id % 4 or r.doc_id >= 0)]
        assert np.mean(right) > 0.9


def test_misspelt_words_share_subwords(spark):
    docs, labels, _ = labelled(spark)
    rnd = random.Random(8)
    rows = [corpora.row(7000 + i, " ".join([*corpora.words(rnd, 20).split(), spoilt(corpora.BAD[i % 4], rnd), *corpora.words(rnd, 20).split()])) for i in range(20)]
    rows += [corpora.row(8000 + i, corpora.words(rnd, 41)) for i in range(20)]
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.union(corpora.frame(spark, rows)), labels).collect() if (r.doc_id or 0) >= 7000}
    assert np.mean([scores[7000 + i] for i in range(20)]) > 5 * np.mean([scores[8000 + i] for i in range(20)])


def test_one_toxic_window_in_a_long_text(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(160):
        w = corpora.words(rnd, 1600 if i % 8 else 40).split()
        if i % 2:
            # One window of 400, between those that an even spread of 48 would show.
            at = next(j for j in rnd.sample(range(400), 400) if j not in set(np.linspace(0, 399, 48).astype(int)))
            w[4 * at: 4 * at + 4] = [rnd.choice(corpora.BAD) for _ in range(4)]
        rows.append(corpora.row(i, " ".join(w)))
        labels.append((i, i % 2))
    scores = toxicity.toxicity_scores(corpora.frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [r for r in scores if r.held_out and r.doc_id % 8]
    assert {r.doc_id % 2 for r in held} == {0, 1}
    assert all(r.predicted == r.doc_id % 2 for r in held)


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality",
                                "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    for fn in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(map(str, fn(docs, labels).collect())) == sorted(map(str, fn(docs, flipped).collect()))


def test_clean_documents_keep_their_columns(spark):
    docs, labels, _ = labelled(spark, 200)
    kept = toxicity.clean_documents(docs, labels)
    assert kept.schema == docs.schema
    score = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s < 0.5}


def test_empty_tables_and_no_labels(spark):
    docs, labels, rows = labelled(spark, 20)
    none = corpora.frame(spark, [])
    for fn in (quality.quality_scores, toxicity.toxicity_scores):
        assert fn(none, labels).count() == 0 and fn(docs, labels.limit(0)).count() == len(rows)
    assert ngram_lm.score_documents(none).count() == 0


def brute_scores(rows, mu=ngram_lm.MU):
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode()), b"\0end"] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    pairs = Counter(p for x, h in zip(tokens, held, strict=True) if not h for p in zip([b"\0start", *x], x, strict=False))
    n, v, texts = sum(c.values()), len(c), held.count(False)
    one, two = (sum(k == m for k in c.values()) for m in (1, 2))
    d = one / (one + 2 * two) if one else 0.5
    out = []
    for r, x, h in zip(rows, tokens, held, strict=True):
        score = 0.0
        for a, b in zip([b"\0start", *x], x, strict=False):
            p = (c[b] - d) / n if c[b] else d * v / n
            uses = texts if a == b"\0start" else c[a]
            score += math.log10((pairs[a, b] + mu * p) / (uses + mu)) if uses else math.log10(p)
        out.append((r[0], h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), score))
    return out


@pytest.mark.parametrize("split", [100_000, 3])
def test_ngram_scores(spark, monkeypatch, split):
    monkeypatch.setattr(ngram_lm, "SPLIT", split)
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 20_000)
    rows = corpora.odd_rows()
    got = sorted((tuple(r) for r in ngram_lm.score_documents(corpora.frame(spark, rows)).collect()), key=str)
    want = sorted(brute_scores(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5])
        assert -0.05 * w[2] <= g[6] - w[6] <= 1e-6, "rounded down by less than a code"


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 10**12), (5, 3), (1000, 50), (1000, 10**9), (20_000, 2**50)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, top, n))
    sequence = EliasFano.of(values)
    assert (sequence.access(np.arange(n)) == values).all()
    wanted = np.concatenate([rng.integers(0, top + 3, 500), values[:200], values[:200] + 1])
    assert (sequence.successor(wanted) == np.searchsorted(values, wanted)).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.unique(np.minimum(rng.zipf(1.3, 20_000), 10**4) * 10**6 + np.minimum(rng.zipf(1.2, 20_000), 10**6 - 1))
    context, word = np.divmod(keys, 10**6)
    code = rng.integers(0, 256, len(keys))
    trie = Trie.mapped(Trie.layout(context, word, code))
    assert (trie.find(context, word) == code).all()
    other = np.setdiff1d(rng.integers(0, 10**10, 20_000), keys)
    assert (trie.find(*np.divmod(other, 10**6)) == -1).all()
    empty = Trie.mapped(Trie.layout(keys[:0], keys[:0], code[:0]))
    assert (empty.find(context, word) == -1).all()


def test_toxicity_learns_from_a_very_long_text_and_from_keys_with_two_texts(spark):
    docs, labels, rows = labelled(spark)
    long = " ".join(corpora.words(random.Random(5), 40, 300) for _ in range(22_000))  # about 4 MB
    extra = [corpora.row(9001, long), corpora.row(9002, "other idiot moron text of a few words"), corpora.row(9002, corpora.words(random.Random(6), 30))]
    both = spark.createDataFrame([(9001, 1, 0, "x"), (9002, 1, 0, "x")], labels.schema)
    more, marks = docs.union(corpora.frame(spark, extra)), labels.union(both)
    one = {(r.doc_id, r.score) for r in toxicity.toxicity_scores(more, marks).collect()}
    two = {(r.doc_id, r.score) for r in toxicity.toxicity_scores(more.repartition(7), marks).collect()}
    assert one == two  # neither the layout nor which of two texts is met first counts
    score = {k: s for k, s in one if k is not None and k < 1000}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] in score]
    assert sum((score[r[0]] >= 0.5) == (r[0] % 4 == 0) for r in held) >= 0.9 * len(held)


def test_bags_equal_the_subwords_of_each_window():
    texts = ["one two three four five six", "", "Idiot!!", "a b c d e", "ünï 12ab"]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ids, counts, first = toxicity.bags(buf, offs)
    grams, windows, first_again, n = toxicity.subwords(buf, offs)
    edges = [*windows, n]
    want = [np.concatenate([b[a:z][v[a:z]] for b, v in grams]) for a, z in zip(edges[:-1], edges[1:])]
    assert list(first) == list(first_again) and list(counts) == [len(w) for w in want]
    assert list(ids) == list(np.concatenate(want))
