"""Small corpora with every odd case: nulls, empty and very long texts, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, t string, n int, tk int, value string, size string, held string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
BAD = ["idiot", "moron", "stupid", "worthless"]


def words(rnd, n, pool=400):
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "k", None, 3, 7, "v", "s", None)


def odd_rows():
    rnd = random.Random(4)
    texts = [words(rnd, rnd.randrange(3, 120)) for _ in range(40)]
    rows = [row(i, t, rnd.choice(["a", "b", "ü", None])) for i, t in enumerate(texts)]
    rows += [row(100, None), row(101, ""), row(102, " \n\t "), row(103, "one"), row(104, "Two Words"), row(105, "tWO wORDS")]
    rows += [row(106, texts[3]), row(107, texts[3].upper()), row(107, texts[3].upper()), row(108, texts[3] + " ")]
    rows += [row(None, texts[5]), row(None, "no key, own text of some words"), row(None, None)]
    rows += [row(109, words(rnd, 30_000, 10_000)), row(110, "Ünïcödé ÄÖÜ straße 　 \U0001f600 " * 3), row(111, "x" * 30_000), row(112, "É"), row(113, "é")]
    base = words(rnd, 120).split()
    for i in range(12):  # a chain and a star of near copies
        changed = list(base)
        for j in rnd.sample(range(120), i // 2):
            changed[j] = f"new{i}x{j}"
        rows.append(row(200 + i, " ".join(changed), "b"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
