"""The manifest against trees built by hand in Python."""

import hashlib
import zlib

import pytest
from tests.llm.corpora import frame, odd_rows, row

from offerlens.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*map(field, (r[0], r[3], r[2], r[4], text)))


def steps(nodes):
    """The paths of all leaves of a tree: for each the siblings before and behind at each level; and the top."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, i in enumerate(at):
            run = i // 3 * 3
            paths[leaf_no].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        nodes, at = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return paths, nodes[0]


def brute(rows):
    by_source = {}
    for r in rows:
        changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        by_source.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, r[1].replace("\n", "")) if changed else leaf(r, r[1])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append((own, *steps([x[1] for x in own])))
    upper, root = steps([t[2] for t in trees])
    out = []
    for (own, paths, sub), up in zip(trees, upper):
        for (k, lf, seen), path in zip(own, paths):
            acc = seen
            for left, right in path + up:
                acc = h(left, acc, right)
            out.append((k, lf, sub, root, h(*[x for p in path + up for x in p]), acc, acc == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def key(r):
    return [str(x) for x in r]


@pytest.mark.parametrize("case", ["odd", "one", "sources", "long"])
def test_manifest_equals_trees_built_by_hand(spark, case):
    if case == "odd":
        rows = odd_rows() + [row(300, "a\nb\n", None), row(301, "a\nb\n", None), row(302, "\n", "b"), row(303, "x\ny", "z")]
    elif case == "one":
        rows = [row(5, "alone\n")]
    elif case == "sources":  # many lone leaves, one source with most rows
        rows = [row(i, f"t{i}\nx", f"s{i % 40}" if i % 3 == 0 else "hot") for i in range(300)]
    else:
        rows = [row(i, "line\n" * 50_000 if i == 3 else "s", "a") for i in range(10)]
    got = merkle.verify(merkle.manifest(frame(spark, rows))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    changed = {r.doc_id for r in got if not r.verified}
    assert changed == {r[0] for r in rows if r[0] is not None and r[1] and "\n" in r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0}


def test_empty_table_has_an_empty_manifest(spark):
    assert merkle.verify(merkle.manifest(frame(spark, []))).columns == COLUMNS
    assert merkle.verify(merkle.manifest(frame(spark, []))).count() == 0
