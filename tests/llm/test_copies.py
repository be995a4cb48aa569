"""Exact and near copies and fingerprints against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from offerlens.llm import exact_dedup, fingerprints, near_dup
from tests.llm import corpora


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_chunks_cover_the_text(spark):
    rows = corpora.odd_rows()
    df = corpora.frame(spark, rows).withColumn("c", exact_dedup.chunks(exact_dedup.normal_text(F.col("text"))))
    many = 0
    for r in df.collect():
        assert "".join(r.c) == lower(r.text)
        many += len(r.c) > 5
    assert many


def test_exact_copies(spark):
    rows = corpora.odd_rows()
    got = exact_dedup.exact_duplicates(corpora.frame(spark, rows)).collect()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = by_sha[r.text_sha256]
        real = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(real) if real else None)
    for sha in by_sha:
        kept = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    assert len(by_sha) == len({r.text_sha256 for r in got})


def test_chunk_numbers_that_collide_get_versions(spark):
    rows = [(1, [(7, b"a"), (8, b"b")]), (2, [(7, b"c"), (8, b"b")]), (3, [(7, b"a"), (8, b"b")])]
    df = spark.createDataFrame(rows, "__uid bigint, __parts array<struct<n:bigint,sha:binary>>")
    got = {r[0]: [tuple(x) for x in r[1]] for r in exact_dedup.verified(df).collect()}
    assert got[1] == got[3] != got[2]


def brute_components(rows, size, percent):
    ids, sets = [r[0] for r in rows], [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        mine = [ids[j] for j in range(len(rows)) if find(j) == find(i) and ids[j] is not None]
        out.append((ids[i], len(sets[i]), min(mine, default=None) if sets[i] else ids[i]))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, size, percent):
    rows = corpora.odd_rows()
    got = near_dup.near_duplicates(corpora.frame(spark, rows), size=size, percent=percent).collect()
    want = brute_components(rows, size, percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_that_only_a_chain_makes(spark):
    # Each text shares 85 % with the next only: one component, whatever the hubs are.
    words = [f"c{i}" for i in range(200)]
    rows = [corpora.row(i, " ".join(words[5 * i: 5 * i + 90])) for i in range(20)]
    got = near_dup.near_duplicates(corpora.frame(spark, rows), size=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 3, 85))
    assert {r.component_id for r in got} == {0}


def test_needed_is_the_binomial_bound():
    assert near_dup.needed(64, 85, 1e-6) == 39 and near_dup.needed(64, 100) == 64


def test_one_of_each_group_stays(spark):
    rows = corpora.odd_rows()
    docs = corpora.frame(spark, rows)
    kept = near_dup.representatives(docs)
    assert kept.columns == docs.columns
    left = near_dup.near_duplicates(kept).filter("n_shingles > 0")
    assert left.count() == left.select("component").distinct().count() == near_dup.near_duplicates(docs).filter("n_shingles > 0").select("component").distinct().count()
    exact = exact_dedup.kept_documents(docs)
    assert exact.columns == docs.columns and exact.count() == len({lower(r[1]) for r in rows})


def test_fingerprints(spark):
    rows = [r for r in corpora.odd_rows() if r[0] is not None]
    got = fingerprints.compare_edits(corpora.frame(spark, rows), low=0.03, high=0.5).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0], r[1] or "") for r in rows}, reverse=True)
    by_id = {r.doc_id: r for r in got}
    finger = {}
    for i, (doc_id, text) in enumerate(order):
        r, after = by_id[doc_id], order[(i + 1) % len(order)]
        half = len(text) // 2
        if [x[0] for x in rows].count(doc_id) == 1 and [x[0] for x in rows].count(after[0]) == 1:
            assert r.n_chars == len(text)
            assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[1][:half]).encode()).hexdigest(), doc_id
            assert r.near_next == pytest.approx(1.0) if r.fingerprint == by_id[after[0]].fingerprint else r.near_next < 1
        finger.setdefault(text, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in finger.values())


def test_many_copies_of_one_text(spark):
    rnd = random.Random(3)
    rows = [corpora.row(3 * i + j, corpora.words(rnd, 100, 3000)) for i in range(100) for j in (0, 1)]
    copy = " ".join([rows[0][1], *[f"own{i}" for i in range(100)]])
    alone = corpora.frame(spark, [*rows, corpora.row(2, copy)])
    rows += [corpora.row(3 * i + 2, copy) for i in range(100)]
    docs = corpora.frame(spark, rows)
    assert (fingerprints.lexicon(docs) == fingerprints.lexicon(alone)).all(), "copies count once"
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    assert min(got[3 * i + 2].near_edited for i in range(100)) > 0.05
    assert len({got[3 * i + 2].fingerprint for i in range(100)}) == 1


def test_texts_without_lexicon_terms_are_compared_by_all_terms(spark):
    rnd = random.Random(5)
    rows = [corpora.row(2 * i, corpora.words(rnd, 100, 60)) for i in range(20)]
    rows += [corpora.row(2 * i + 1, " ".join(f"only{i}x{j}" for j in range(100))) for i in range(20)]
    rows += [corpora.row(100, " ".join(f"lone{j}" for j in range(100))), corpora.row(99, " ".join(f"lone{j + 10}" for j in range(100)))]
    got = {r.doc_id: r for r in fingerprints.compare_edits(corpora.frame(spark, rows), low=0.05, high=0.9).collect()}
    assert min(got[2 * i + 1].near_edited for i in range(20)) > 0
    assert got[100].near_next > 0.3, "90 of 110 terms are shared"


def test_buckets_do_not_change_fingerprints(spark, monkeypatch):
    docs = corpora.frame(spark, corpora.odd_rows())
    one = sorted(map(str, fingerprints.compare_edits(docs, low=0.03, high=0.5).collect()))
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 20_000)
    assert sorted(map(str, fingerprints.compare_edits(docs, low=0.03, high=0.5).collect())) == one


def test_empty_table(spark):
    docs = corpora.frame(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0 and near_dup.near_duplicates(docs).count() == 0
    assert fingerprints.compare_edits(docs).count() == 0
