"""BPE against the public library and its own round trip; token counts against brute force."""

import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from offerlens.llm import bpe, token_counts
from tests.llm import corpora


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.read_model())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_file())


def test_encoder_equals_the_library(ours, library):
    rnd = random.Random(1)
    cases = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext|>y", "it's we'll  \n\n x", "a   b", "a \n \n b", "\n \n", "a\t \tb",
             "a 　 b", "\x00\x1c\x85", "é中文 \U0001f600" * 9, "=" * 300, " " * 60 + "x", "ab" * 2000]
    cases += ["".join(rnd.choice("abcdehinorst  'é$%\n01") for _ in range(rnd.randrange(1, 80))) for _ in range(3000)]
    cases += ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 90))) for _ in range(1000)]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == want, text
        assert ours.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_white_space_at_the_end_is_one_piece():
    letters = {b: c for c, b in bpe._byte_letters().items()}
    space, line = letters[32], letters[10]
    vocab = {letters[b]: b for b in range(256)} | {space * 2: 256, line + space: 257}
    spec = json.loads(bpe.read_model())
    spec["model"] |= {"vocab": vocab, "merges": [f"{space} {space}", f"{line} {space}"]}
    spec["added_tokens"] = [t | {"id": 258} for t in spec["added_tokens"][:1]]
    end = spec["added_tokens"][0]["content"]
    small, library = bpe.Bpe(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    assert small.encode("a  ") == [97, 256]
    for text in ["a  ", "a\n ", "  ", "\n ", "a b  ", "a ", " ", f"a  {end}b\n ", "a   "]:
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_pieces_stay_right_when_the_store_is_renewed(ours, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = " ".join(f"word{i} again" for i in range(200))
    assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(spark, library):
    rows = corpora.odd_rows()
    got = sorted(map(tuple, bpe.round_trip(corpora.frame(spark, rows)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_tables(spark):
    docs = corpora.frame(spark, corpora.odd_rows())
    back = bpe.decode(bpe.encode(docs)).filter("doc_id is not null").distinct()
    want = docs.selectExpr("doc_id", "coalesce(text, '') as text").filter("doc_id is not null").distinct()
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_length_report(spark, library):
    rows = corpora.odd_rows()
    lengths = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    sums = token_counts.suffix_sums(token_counts.length_histogram(corpora.frame(spark, rows)))
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.docs == lengths.count(n) and r.docs_from == sum(x >= n for x in lengths) and r.docs_to == sum(x <= n for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n) and r.tokens_to == sum(x for x in lengths if x <= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.quantile == pytest.approx(r.docs_to / len(lengths))
    limits = {r.limit: (r.whole_docs, r.truncated_tokens) for r in token_counts.at_limits(sums, [1, 50, 4096, 10**6]).collect()}
    assert limits == {m: (sum(x <= m for x in lengths), sum(min(x, m) for x in lengths)) for m in (1, 50, 4096, 10**6)}
    middle = {r.share: r.n_tokens for r in token_counts.length_quantiles(sums, [0.5, 1.0]).collect()}
    assert middle == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}


def test_empty_table(spark):
    docs = corpora.frame(spark, [])
    assert bpe.round_trip(docs).count() == 0 and bpe.encode(docs).count() == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(docs)).count() == 0
