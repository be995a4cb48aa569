"""Product codes of vectors with exact integer codebooks, learnt over Hilbert-sorted blocks.

A vector's components become integers, and the vector is cut into `PARTS` parts.  The parts of one position are sorted along a
Hilbert curve and laid down in flat blocks of `ROWS` parts, each with the box of its components (least and largest) and their sum.
A round compares the codebook with the boxes first: an entry whose least possible distance to a box exceeds the least of the
entries' largest possible distances can't be nearest to any part in it.  The entries left, the block's shortlist, are compared
with the parts by an integer kernel; a block with one entry left gives its stored sum without a look at its parts.

Blocks are written once and read by every round.  Tasks send one row of sums for each codebook entry they met, so what a round
shuffles and what the driver gets is bounded by the codebook; sorted ranges end with a row number, so a vector that a third
of the rows repeat is spread over many blocks.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are left out; vectors shorter than the longest
(or than the next multiple of `PARTS`) count as filled up with zeros; integers are held within +-2^25, far beyond embeddings;
of rows with one id the lesser vector seeds first, a null id seeds last; with fewer rows than entries the codebook has as many entries as rows;
repeated rows are rows; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.session import materialized

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 4, 256, 4, 1024, 1 << 25
ROWS, CHUNK, TOGETHER = 128, 16, 32


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(id, key, label, v): the rows whose vector is whole, its components as integers, numbered once and for all."""
    own = F.col(f"`{vector}`")
    bad = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(own, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    rows = vectors.filter(own.isNotNull()).filter(~bad)
    return materialized(rows.select(F.monotonically_increasing_id().alias("id"), F.col(f"`{key}`").alias("key"),
                                    (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"), scaled.alias("v")))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` integers; shorter lists end with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = values
    return out


def spreads(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, and mean and deviation of each component up to the longest vector's: one number each to the driver."""
    def summed(batches):
        count, total, square = 0, np.zeros(0), np.zeros(0)
        for b in batches:
            width = int(np.max(np.asarray(b.column(0).value_lengths()), initial=0))
            m = matrix_of(b.column(0), width).astype(np.float64)
            width = max(width, len(total))
            total, square = (np.pad(x, (0, width - len(x))) for x in (total, square))
            total[: m.shape[1]] += m.sum(0)
            square[: m.shape[1]] += (m * m).sum(0)
            count += len(m)
        i = np.arange(-1, len(total), dtype=np.int32)  # -1 carries the number of rows
        yield pa.RecordBatch.from_pydict({"i": i, "s": np.append(float(count), total), "q": np.append(0.0, square)})

    found = {r.i: (r.s, r.q) for r in rows.select("v").mapInArrow(summed, "i int, s double, q double").groupBy("i").agg(
        F.sum("s").alias("s"), F.sum("q").alias("q")).collect()}
    n = int(found.get(-1, (0, 0))[0])
    width = -(-max(max(found, default=0) + 1, 1) // PARTS) * PARTS
    mean = np.array([found.get(i, (0, 0))[0] for i in range(width)]) / max(n, 1)
    square = np.array([found.get(i, (0, 0))[1] for i in range(width)]) / max(n, 1)
    return n, mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cell numbers along the Hilbert curve, as big-endian bytes (8 for up to 64 bits).

    The axes are turned into the curve's own by exchanging and inverting low bits from the top bit down, then Gray-coded."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | ((x[i] >> bit) & 1).astype(np.uint64)
    return key


def blocks_of(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """(part, ids, n, low, high, total, data): blocks of neighbouring parts along the curve; arrays as bytes of 64-bit (the data: 32-bit) integers."""
    width, size = len(mean), len(mean) // PARTS
    axes = min(size, 64)  # the curve looks at so many components; results don't depend on it
    bits = max(1, min(4, 64 // axes))

    def keyed(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                b = batch.slice(at, 2048)
                m = matrix_of(b.column(1), width)
                cell = np.clip(((m - mean) / deviation + 2) / 4 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                for p in range(PARTS):
                    keys = hilbert_keys(cell[:, p * size: p * size + axes], bits)
                    data = np.ascontiguousarray(m[:, p * size: (p + 1) * size], np.int32)
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(m), p, np.int32), "h": (keys ^ np.uint64(1 << 63)).view(np.int64),
                                                      "id": b.column(0), "data": pa.array([r.tobytes() for r in data], pa.binary())})

    def laid(batches):
        for b in batches:
            part = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(part)), strict=True):
                out = []
                for at in range(lo, hi, ROWS):
                    own = b.slice(at, min(ROWS, hi - at))
                    m = np.frombuffer(b"".join(own.column(3).to_pylist()), np.int32).reshape(len(own), size)
                    wide = m.astype(np.int64)
                    out.append((int(part[at]), own.column(2).to_numpy().tobytes(), len(own), wide.min(0).tobytes(), wide.max(0).tobytes(), wide.sum(0).tobytes(), m.tobytes()))
                if out:
                    names = ["part", "ids", "n", "low", "high", "total", "data"]
                    kinds = [pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    curve = rows.select("id", "v").mapInArrow(keyed, "part int, h bigint, id bigint, data binary")
    curve = curve.repartitionByRange("part", "h", "id").sortWithinPartitions("part", "h", "id")
    return materialized(curve.mapInArrow(laid, "part int, ids binary, n int, low binary, high binary, total binary, data binary"))


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each box the entries that can be nearest to something in it; all figures are integers."""
    below, above = low[:, None, :] - book, book - high[:, None, :]
    nearest = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(-below, -above)  # the larger of the distances to the two ends of each side
    nearest, farthest = (nearest * nearest).sum(2), (farthest * farthest).sum(2)
    return nearest <= farthest.min(1, keepdims=True)


def kernel(points: np.ndarray, entries: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties to the first) and its squared distance, exactly.

    Products of doubles are exact while no sum passes 2^53; larger numbers go through 64-bit integers."""
    if 4 * largest * largest * max(1, points.shape[1]) < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        d = (e * e).sum(1) - 2 * (p @ e.T)
        best = d.argmin(1)
        return best, (d[np.arange(len(p)), best] + (p * p).sum(1)).astype(np.int64)
    best, least = np.zeros(len(points), np.int64), None
    for i, e in enumerate(entries):
        d = ((points - e) ** 2).sum(1)
        closer = np.ones(len(points), bool) if least is None else d < least
        best[closer] = i
        least = d if least is None else np.where(closer, d, least)
    return best, least


def each_block(batches, books: np.ndarray, look: bool):
    """(part, ids, block, entries, distances) of each block: one entry for a block whose shortlist has one, unless `look`."""
    size = books.shape[2]
    edge = int(np.abs(books).max(initial=0))
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            b = batch.slice(at, TOGETHER)
            part = b.column("part").to_numpy()
            low, high = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int64).reshape(len(b), size) for c in ("low", "high"))
            largest = np.maximum(np.abs(low), np.abs(high)).max(1, initial=edge)
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                short = shortlists(low[own], high[own], books[p])
                for i, listed in zip(own, short, strict=True):
                    entries = np.flatnonzero(listed)
                    if len(entries) == 1 and not look:
                        yield int(p), b, i, entries, None, None
                        continue
                    points = np.frombuffer(b.column("data")[i].as_buffer(), np.int32).reshape(-1, size).astype(np.int64)
                    best, d = kernel(points, books[p][entries], int(largest[i]))
                    yield int(p), b, i, entries[best], d, points


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) after so many rounds: entries become the floor of the mean of their parts."""
    spark, size = blocks.sparkSession, books.shape[2]
    for _ in range(rounds):
        box = spark.sparkContext.broadcast(books)  # parts x entries x components numbers

        def summed(batches, box=box):
            count = np.zeros(box.value.shape[:2], np.int64)
            total = np.zeros(box.value.shape, np.int64)
            for p, b, i, entries, _, points in each_block(batches, box.value, look=False):
                if points is None:
                    count[p, entries[0]] += b.column("n")[i].as_py()
                    total[p, entries[0]] += np.frombuffer(b.column("total")[i].as_buffer(), np.int64)
                else:
                    order = np.argsort(entries, kind="stable")
                    heads = np.flatnonzero(np.diff(entries[order], prepend=-1))
                    used = entries[order][heads]
                    count[p, used] += np.diff(np.append(heads, len(order)))
                    total[p, used] += np.add.reduceat(points[order], heads, axis=0)
            p, e = np.nonzero(count)
            full = np.pad(total[p, e], ((0, 0), (0, -size % CHUNK)))
            for c in range(0, max(size, 1), CHUNK):
                sums = full[:, c: c + CHUNK] if size else np.zeros((len(p), CHUNK), np.int64)
                yield pa.RecordBatch.from_pydict({"p": p.astype(np.int32), "e": e.astype(np.int32), "c": np.full(len(p), c, np.int32),
                                                  "n": count[p, e], "s": pa.FixedSizeListArray.from_arrays(sums.ravel(), CHUNK).cast(pa.list_(pa.int64()))})

        sums = blocks.mapInArrow(summed, "p int, e int, c int, n bigint, s array<bigint>").groupBy("p", "e", "c").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(CHUNK)]).alias("s"))
        books = books.copy()
        for r in sums.collect():  # entries that were used
            books[r.p, r.e, r.c: r.c + CHUNK] = np.array(r.s[: max(0, min(CHUNK, size - r.c))], np.int64) // r.n
    return books


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, code, error): the entries nearest to the parts of each vector as hex digits, and its squared distance to them."""
    box = blocks.sparkSession.sparkContext.broadcast(books)

    def found(batches):
        for p, b, i, entries, d, _ in each_block(batches, box.value, look=True):
            ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_pydict({"id": ids, "e": (entries.astype(np.int64) << 8 * (PARTS - 1 - p)), "d": d})

    # The parts of a code are digits of one number, so that a vector's four parts are summed up.
    return blocks.mapInArrow(found, "id bigint, e bigint, d bigint").groupBy("id").agg(
        F.lower(F.lpad(F.hex(F.sum("e")), 2 * PARTS, "0")).alias("code"), F.sum("d").alias("error"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per whole vector: (key, code, error, label_error, codebooks_sha256)."""
    rows = whole_vectors(vectors, key, vector, label)
    _, mean, deviation = spreads(rows)
    width = len(mean)
    seeds = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()  # ENTRIES rows
    first = np.zeros((len(seeds), width), np.int64)
    for i, r in enumerate(seeds):
        first[i, : len(r.v)] = r.v
    books = first.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    blocks = blocks_of(rows, mean, deviation)
    books = learn(blocks, books, rounds)
    coded = materialized(rows.select("id", "key", "label").join(assign(blocks, books), "id"))
    sums = materialized(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    """SQL: parts with their nearest entry of codebook n, and the codebook after it."""
    return f"""
near{n} AS MATERIALIZED (SELECT k.vec_id, k.p, min(CAST(k.sq - 2 * list_inner_product(k.part, b.c) + b.sq AS BIGINT) * 256 + b.e) AS best
    FROM parts k JOIN book{n} b ON k.p = b.p GROUP BY k.vec_id, k.p)"""


def _moved(n: int) -> str:
    return f"""
sums{n} AS (SELECT k.p, m.best % 256 AS e, i, floor(sum(k.part[i]) / count(*)) AS x
    FROM parts k JOIN near{n} m ON k.vec_id = m.vec_id AND k.p = m.p, range(1, 1 + len(k.part)) t(i) GROUP BY k.p, m.best % 256, i),
book{n + 1} AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS sq FROM (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{n} b
    LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS c FROM sums{n} GROUP BY p, e) s ON b.p = s.p AND b.e = s.e))"""


SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, part, list_inner_product(part, part) AS sq
    FROM (SELECT vec_id, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS part FROM kept, range({PARTS}) t(p))),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS c, sq FROM parts
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{",".join(_assigned(n) + "," + _moved(n) for n in range(ROUNDS))},
{_assigned(ROUNDS)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, i, c[i] AS x FROM book{ROUNDS}, range(1, 1 + len(c)) t(i))) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
