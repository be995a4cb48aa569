"""Vector codes against the rounds written out in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from offerlens.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, part int, code string, v int"


def brute(rows, entries=V.ENTRIES):
    kept = [(k, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for k, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(1, *(len(v) for _, v, _ in kept)) // 4) * 4
    kept = [(k, v + [0] * (width - len(v)), lab) for k, v, lab in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size = width // 4

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    books = [[v[p * size: p * size + size] for _, v, _ in seeds] for p in range(4)]
    for _ in range(4):
        for p in range(4):
            held = {}
            for _, v, _ in kept:
                x = v[p * size: p * size + size]
                held.setdefault(nearest(x, books[p])[0], []).append(x)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for k, v, lab in kept:
        found = [nearest(v[p * size: p * size + size], books[p]) for p in range(4)]
        error = sum(d for _, d in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append([k, "".join(f"{e:02x}" for e, _ in found), error, lab])
    return [(k, c, e, by_label[lab], digest) for k, c, e, lab in out]


def rows(n, width, rnd):
    centres = [[rnd.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    return [(i * 3, [c + rnd.gauss(0, 0.05) for c in rnd.choice(centres)], rnd.choice([None, 1, 2, 2, 2])) for i in range(n)]


def cases():
    rnd = random.Random(8)
    many = rows(700, 8, rnd)
    hot = [(10_000 + i, many[5][1], 7) for i in range(400)]  # more than a third are one vector
    odd = [(None, many[1][1], None), (3, many[2][1], 1), (3, many[2][1], 1), (9, None, 1), (10, [0.1, None] + [0.0] * 6, 1), (11, [math.nan] * 8, 1),
           (12, [math.inf] + [0.0] * 7, 1), (13, [], 2), (14, [0.5] * 3, 2), (15, [0.25] * 9, 2)]
    return {"many": many + hot, "odd": many[:80] + odd, "few": rows(5, 6, rnd), "none": [(1, None, 1)], "ties": [(i, [float(i % 2)] * 4, 0) for i in range(40)],
            "huge": [(i, [rnd.choice([-1, 1]) * rnd.uniform(1e3, 3e4) for _ in range(8)], 0) for i in range(60)]}


@pytest.mark.parametrize("case", list(cases()))
def test_codes_equal_plain_rounds(spark, case):
    data = cases()[case]
    df = spark.createDataFrame([(*r, 5, 6, "c", 7) for r in data], SCHEMA).repartition(5)
    got = V.compress(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(data), key=str)


def test_lists_hold_the_nearest_and_leave_entries_out():
    rnd = np.random.default_rng(3)
    points = rnd.integers(-50, 50, (40, 6)) + rnd.integers(0, 2, (40, 1)) * 1000
    book = rnd.integers(-60, 60, (30, 6)) + rnd.integers(0, 2, (30, 1)) * 1000
    for own in (points[points[:, 0] < 500], points[points[:, 0] > 500]):
        listed = V.shortlists(own.min(0)[None], own.max(0)[None], book)[0]
        d = ((own[:, None] - book) ** 2).sum(2)
        assert listed[d.argmin(1)].all() and not listed.all()
        for largest in (2000, 1 << 40):  # doubles and 64-bit integers
            best, least = V.kernel(own, book, largest)
            assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = V.hilbert_keys(cells, 4)
    assert sorted(keys.tolist()) == list(range(16 ** 3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
