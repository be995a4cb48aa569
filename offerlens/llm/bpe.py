"""Byte-level BPE with merges by rank: exact encoding by backtracking over longest tokens, decoding by an offset table.

The tokenizer file gives a vocabulary and ranked merges.  A text is cut at the added tokens and then by the pre-tokenizer's
pattern; each piece is encoded alone.  A sequence of tokens is what the merges give exactly when each two neighbours are
compatible: merging the bytes of the two alone must leave that border standing.  So an Aho-Corasick automaton finds the longest
token at each place of a piece, and the encoder goes from left to right with the longest token that is compatible with the
one before, falls back to that token's longest shorter prefix, and backs out of ends from which no token fits; each end is
tried once, so the work is linear in the piece.

Pieces repeat, and so do the runs between single spaces (a space inside a text always begins a piece unless it stands in a
longer run of white space).  So each Python worker keeps the encodings of runs and pieces it has met, up to a bound on their
number and length; beyond it those not met lately are forgotten, which costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value of the file's format
INNER_SPACE = re.compile(r"\s \s|\s \Z")  # where a cut at single spaces would part white space that is one piece
KEPT, KEPT_LENGTH = 150_000, 48


class Recent(dict):
    """What was made for the keys met lately: at most KEPT entries and as many of the generation before."""

    def __init__(self, make, before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before if before is not None else {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > KEPT_LENGTH:
                return found
        self[key] = found
        return found

    def next(self) -> Recent:
        """This store while there is room, else a new one before which this one stands."""
        if len(self) < KEPT:
            return self
        self.before = {}
        return Recent(self.make, self)


def default_file() -> str:
    """The place of the public 50k byte-level vocabulary on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def read_model(path: str | None = None) -> str:
    """The text of a tokenizer file; read on the driver and sent to the tasks, as workers may not have the file."""
    with open(path or default_file(), encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others by the
    letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    def __init__(self, model: str):
        spec = json.loads(model)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only plain byte-level files are read")
        letters = _byte_letters()
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words are not read")
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        size = 1 + max([*self.tokens, *self.added.values()])
        # Merges in order of rank: the pair, the token it makes, and for each token its two halves and its rank.
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.made.setdefault(pair, (r, whole))
            if self.halves[whole] is None:
                self.halves[whole], self.rank[whole] = pair, r
        self.automaton = ahocorasick.Automaton()
        by_bytes = {}
        for i, t in self.tokens.items():
            by_bytes[t] = i
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.lengths = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for i, t in self.tokens.items():
            self.lengths[i] = len(t)
            self.shorter[i] = next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
        # Decoding: token i is bytes[offsets[i]:offsets[i + 1]].
        content = [self.tokens.get(i, b"") for i in range(size)]
        for t, i in self.added.items():
            content[i] = t.encode()
        self.bytes = b"".join(content)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in content])]).tolist()
        self._fits: dict[int, bool] = {}
        self._piece, self._run = Recent(self._encode_piece), Recent(self._encode_run)
        # Whole pieces of letters that are tokens need no search; each token's place in a list of ids, as text.
        self._text = [str(i) for i in range(size)]
        self._whole: dict[str, tuple[int, str, bytes]] = {}
        for i, t in self.tokens.items():
            if t[:1] == b" " and t[1:].isalpha():
                self._whole[t[1:].decode()] = (1, self._text[i], t)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens leaves the border between them standing.

        Both sides are taken apart in the reverse order of their merges.  At each step the two tokens that meet at the
        border must not have a merge that comes before the merges which made them.
        """
        key = left << 32 | right
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) > KEPT:
                self._fits.clear()
            fits = self._fits[key] = self._stands(left, right)
        return fits

    def _stands(self, a: int, b: int) -> bool:
        never = len(self.rank)
        # Until when each side's piece at the border exists: the rank of the merge that swallows it; a tie of ranks goes
        # to the pair further left.
        a_until, b_until = never, never
        while True:
            merge = self.made.get((a, b))
            # The pair (a, b) lies right of the merge that swallows a, and left of the one that swallows b.
            if merge is not None and merge[0] < a_until and merge[0] <= b_until:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:  # a was made last (of equal ranks the left one is made first, so b exists before)
                a, a_until = self.halves[a][1], ra
                if ra == rb:
                    b, b_until = self.halves[b][0], rb
            else:
                b, b_until = self.halves[b][0], rb

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        full, lengths, shorter, known = len(raw), self.lengths, self.shorter, self._fits
        # The longest token at each place that is looked at: first those of the greedy walk, others where it has to be left.
        longest = [-1] * full
        for end, (n, token) in self.automaton.iter_long(raw):
            longest[end + 1 - n] = token
        token, pos = longest[0], 0
        if lengths[token] == full:
            return [token]
        out: list[int] = []
        dead = bytearray(full + 1)
        last = -1
        while True:
            end = pos + lengths[token]
            fits = not dead[end]
            if fits and last >= 0:
                fits = known.get(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
            if fits:
                out.append(token)
                if end == full:
                    return out
                pos, last, token = end, token, longest[end]
                if token < 0:
                    for end, (n, found) in self.automaton.iter_long(raw, pos):
                        if longest[end + 1 - n] >= 0:  # back on known places
                            break
                        longest[end + 1 - n] = found
                    token = longest[pos]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits from here
                dead[pos] = 1
                gone = out.pop()
                pos -= lengths[gone]
                last = out[-1] if out else -1
                token = shorter[gone]

    def decode(self, ids: Iterable[int]) -> bytes:
        whole, at = self.bytes, self.offsets
        return b"".join([whole[at[i]: at[i + 1]] for i in ids])

    def _encode_piece(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.encode_piece(piece)
        text, whole, at = self._text, self.bytes, self.offsets
        return len(ids), ",".join([text[i] for i in ids]), b"".join([whole[at[i]: at[i + 1]] for i in ids])

    def _encode_run(self, run: str) -> tuple[int, str, bytes]:
        """The encoding of a run behind a space."""
        if run.isascii() and run.isalpha():  # one piece, as the pattern has it
            return self._whole.get(run) or self._encode_piece(" " + run)
        pieces = self.pieces(" " + run)
        if len(pieces) == 1:
            return self._encode_piece(pieces[0])
        # A piece that begins with a space is a run of its own.
        n, ids, raw = zip(*[self._run[p[1:]] if len(p) > 1 and p[0] == " " else self._piece[p] for p in pieces], strict=True)
        return sum(n), ",".join(ids), b"".join(raw)

    def parts(self, text: str) -> list[tuple[int, str, bytes]]:
        """(tokens, ids as text, decoded bytes) of the runs of a text in order."""
        self._run, self._piece = self._run.next(), self._piece.next()
        out = []
        for i, stretch in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
            if i % 2:
                n = self.added[stretch]
                out.append((1, str(n), self.decode([n])))
            elif INNER_SPACE.search(stretch):
                out += [self._piece[p] for p in self.pieces(stretch)]
            elif stretch:
                first, *runs = stretch.split(" ")
                out += [self._piece[p] for p in self.pieces(first)]
                run = self._run
                out += [run[r] for r in runs]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(",")]

    def count(self, text: str) -> int:
        return sum(p[0] for p in self.parts(text))


_built: dict[str, Bpe] = {}


def worker_bpe(model: str) -> Bpe:
    """One encoder for each worker process and model; it lives as long as the worker."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(model)
    return _built[key]


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, ids): the whole text as token ids; null and empty texts have no ids."""
    model = model or read_model()
    box = docs.sparkSession.sparkContext.broadcast(model)  # a fixed file of some megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(box.value)
        for b in batches:
            for at in range(0, len(b), 64):
                rows = b.slice(at, 64)
                ids = [bpe.encode(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    return _two(docs, key, text).mapInArrow(run, "k bigint, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of encoded: (key, text); bytes that are no UTF-8 become U+FFFD; null ids give the empty text."""
    model = model or read_model()
    box = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(box.value)
        for b in batches:
            for at in range(0, len(b), 64):
                rows = b.slice(at, 64)
                texts = [bpe.decode(x or ()).decode("utf-8", "replace") for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["k", "text"])

    return _two(encoded, key, ids).mapInArrow(run, "k bigint, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, n_tokens, ids_sha256, decoded_sha256): digests of the ids, joined by commas, and of the
    text decoded from them.  Null and empty texts have no ids and decode to the empty text; null keys and repeated rows are kept
    as they are; an empty table gives an empty result; other columns are ignored."""
    model = model or read_model()
    box = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(box.value)
        for b in batches:
            out = []
            for t in b.column(1):
                parts = bpe.parts(t.as_py() or "")
                raw = b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()
                out.append((sum([p[0] for p in parts]), hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest(),
                            hashlib.sha256(raw).hexdigest()))
            n, ids, back = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(back, pa.string())], schema=schema)

    return _two(docs, key, text).mapInArrow(run, "k bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)


def token_lengths(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """(n_tokens, docs): how many texts have each encoded length, counted in each Arrow batch; to be summed by length."""
    model = model or read_model()
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(box.value)
        for b in batches:
            n, docs_ = np.unique(np.array([bpe.count(t.as_py() or "") for t in b.column(0)], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs_.astype(np.int64))], ["n_tokens", "docs"])

    return docs.select(docs[f"`{text}`"].alias("t")).mapInArrow(run, "n_tokens bigint, docs bigint")


def _two(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(df[f"`{key}`"].cast("bigint").alias("k"), df[f"`{value}`"].alias("v"))
