"""Product codes of integer vectors, learnt and assigned over Hilbert-sorted flat blocks.

A component x becomes floor(256 * x).  Vectors are cut into equal consecutive parts; each part position has
its own codebook.  The points of a position are sorted along a Hilbert curve and cut into flat blocks that
store the smallest box around their points (min and max) and the points' sum.

In a round, every block measures the squared distance of its box to each entry: at least `near`, at most `far`.  An
entry that is farther at best than another is at worst can't be nearest to any point of the block.  The
others are the block's shortlist.  With one entry left the stored sum goes to it as it is; else a small
integer kernel compares the points with the shortlist.  All arithmetic is on whole numbers, so results are exact,
and ties go to the lower index (an entry is left out only if it is strictly farther).

Blocks have a fixed number of points, wherever they lie, so many equal points fill many blocks.  The
driver sees one sum and one count per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.llm.stored import sent_if_few
from cliplab.session import cut_lineage

BLOCK = 64
POINTS_PER_TASK = 1 << 20
CURVE_BITS = 60
LARGEST = float(1 << 18)  # squared distances of whole vectors stay below 2**63


def _whole(x):
    return F.floor(F.lit(256.0) * x.cast("double")).cast("long")


def integer_vectors(vectors: DataFrame, parts: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(key, vec_id, label, v): kept rows with whole components, v filled up with zeros to a multiple of `parts`.

    Rows whose vector is null, empty or holds null or non-finite components go; so do rows of another
    length than the kept row with the least vec_id.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x"), F.col(label_col).alias("label"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.filter((F.size("x") > 0) & ~bad)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("x")).select(F.size("x").alias("n")).first()
    n = first["n"] if first else parts
    wide = F.exists("x", lambda c: F.abs(c) >= LARGEST)
    checked = F.when(wide, F.raise_error(F.lit(f"a component is {LARGEST:.0f} or more: its squared distances don't fit a long"))).otherwise(
        F.concat(F.transform("x", _whole), F.array_repeat(F.lit(0).cast("long"), -n % parts))
    )
    same = kept.filter(F.size("x") == n)
    return cut_lineage(same.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", checked.alias("v")))


def first_codebooks(whole: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the least vec_ids; of repeated ids, the lesser vector comes first."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    flat = np.array([r["v"] for r in rows], dtype=np.int64)
    return flat.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of every point (n, width) on the Hilbert curve through the box from `low` to `high`.

    As many bits per axis as a long holds; wider parts are ordered by their first axes.
    """
    points = points[:, :CURVE_BITS]
    width = points.shape[1]
    bits = min(20, CURVE_BITS // width)
    extent = np.maximum(high - low, 1)[:width]
    x = [((points[:, i] - low[i]) * ((1 << bits) - 1) // extent[i]).astype(np.int64) for i in range(width)]
    # to the transposed index: undo rotations from the highest bit down, then Gray-decode
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(width):
            swap = np.where(x[i] & bit, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(x[i] & bit, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, width):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(width):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else n).astype(np.int64)


def _points(parts: int, low: np.ndarray, high: np.ndarray):
    """Vectors to one row per part: (part, place on the curve, key, point)."""
    width = len(low) // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, keys = _matrix(batch.column(1), len(low)), batch.column(0)
            for p in range(parts):
                axes = slice(p * width, (p + 1) * width)
                curve = hilbert_keys(v[:, axes], low[axes], high[axes])
                rows = [row.tobytes() for row in v[:, axes].astype("<i4")]
                columns = [pa.array(np.full(len(v), p, np.int32)), pa.array(curve), keys, pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "curve", "key", "point"])

    return run


def _flat_blocks(width: int):
    """Sorted points to flat blocks of at most BLOCK points of one part."""

    def block(part: int, keys: np.ndarray, points: np.ndarray) -> tuple:
        return part, len(keys), points.min(axis=0), points.max(axis=0), points.sum(axis=0), keys.tobytes(), points.astype("<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            keys = batch.column(1).to_numpy().astype(np.int64)
            points = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            rows = [
                block(int(part[s]), keys[s : min(s + BLOCK, j)], points[s : min(s + BLOCK, j)])
                for i, j in zip(cuts, cuts[1:])
                for s in range(i, j, BLOCK)
            ]
            types = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], BLOCK_COLUMNS)

    return run


BLOCK_COLUMNS = ["part", "n", "low", "high", "total", "keys", "points"]
BLOCK_SCHEMA = "part int, n long, low array<long>, high array<long>, total array<long>, keys binary, points binary"


def hilbert_blocks(whole: DataFrame, parts: int) -> DataFrame:
    """Flat blocks of the points of every part position."""
    axes = whole.select(F.posexplode("v").alias("axis", "x")).groupBy("axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    box = sorted(axes.collect())
    low, high = (np.array([r[i] for r in box], dtype=np.int64) for i in (1, 2))
    points = whole.select("key", "v").mapInArrow(_points(parts, low, high), "part int, curve long, key long, point binary")
    tasks = 1 + whole.count() * parts // POINTS_PER_TASK
    # the key parts equal points, so that a point of many vectors fills as many tasks as it needs
    spread = points.repartitionByRange(max(tasks, whole.sparkSession.sparkContext.defaultParallelism), "part", "curve", "key")
    ordered = spread.sortWithinPartitions("part", "curve", "key").select("part", "key", "point")
    return cut_lineage(ordered.mapInArrow(_flat_blocks(len(low) // parts), BLOCK_SCHEMA))


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that may be nearest to a point of the box."""
    outside = np.maximum(np.maximum(low - book, book - high), 0)
    across = np.maximum(np.abs(book - low), np.abs(book - high))
    near, far = (outside * outside).sum(axis=1), (across * across).sum(axis=1)
    return np.flatnonzero(near <= far.min())


def nearest_entries(points: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of a shortlist for every point, and the squared distance; ties to the lower index."""
    apart = points[:, None, :] - book[among][None, :, :]
    squared = np.einsum("ijk,ijk->ij", apart, apart)
    best = squared.argmin(axis=1)
    return among[best], squared[np.arange(len(points)), best]


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    columns = dict(zip(BLOCK_COLUMNS, batch.to_pydict().values()))
    yield from zip(*columns.values())


def _entry_sums(books: np.ndarray):
    """Blocks to (part, entry, n, total): what every entry gets, summed over a batch."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for part, n, low, high, total, _, points in _block_rows(batch):
                among = shortlist(np.array(low), np.array(high), books[part])
                if len(among) == 1:
                    counts[part, among[0]] += n
                    sums[part, among[0]] += np.array(total)
                    continue
                block = np.frombuffer(points, "<i4").reshape(-1, width).astype(np.int64)
                code, _ = nearest_entries(block, books[part], among)
                counts[part] += np.bincount(code, minlength=entries)
                np.add.at(sums[part], code, block)
            p, e = np.nonzero(counts)
            columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def next_codebooks(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every used entry becomes the floored mean of its points."""
    sums = blocks.mapInArrow(_entry_sums(books), "part int, entry int, n long, total array<long>")
    axes = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(books.shape[2])]
    rows = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *axes).collect()
    out = books.copy()
    for part, entry, n, *total in rows:
        out[part, entry] = [s // n for s in total]
    return out


def _codes(books: np.ndarray):
    """Blocks to (key, part, code, error), one row per point."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, low, high, _, keys, points in _block_rows(batch):
                block = np.frombuffer(points, "<i4").reshape(-1, width).astype(np.int64)
                code, error = nearest_entries(block, books[part], shortlist(np.array(low), np.array(high), books[part]))
                columns = [np.frombuffer(keys, np.int64), np.full(n, part, np.int32), code.astype(np.int32), error]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part", "code", "error"])

    return run


def compress(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes, error), codebooks): codes are entry indexes in part order, error the squared distance to them.

    The codebooks start from the `entries` least vec_ids (all rows if fewer; null last; repeated ids by
    their vectors) and go through `rounds` rounds.  Which rows take part: see `integer_vectors`.  Repeated rows are
    coded each.  Components of 2**18 or more raise an error.  An empty table gives an empty table and
    codebooks without entries.  `entries` up to 256.
    """
    whole = integer_vectors(vectors, parts, id_col, vec_col, label_col)
    books = first_codebooks(whole, parts, entries) if not whole.isEmpty() else np.zeros((parts, 0, 1), np.int64)
    if not books.shape[1]:
        return whole.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    blocks = hilbert_blocks(whole, parts)
    for _ in range(rounds):
        books = next_codebooks(blocks, books)
    coded = blocks.mapInArrow(_codes(books), "key long, part int, code int, error long").groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda c: c["code"]).alias("codes"), F.sum("error").alias("error")
    )
    return whole.select("key", "vec_id", "label").join(coded, "key").drop("key"), books


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all whole components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error is the error of all rows of equal label, null labels together."""
    coded, books = compress(vectors, parts, entries, rounds)
    coded = cut_lineage(coded)
    labels = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    joined = coded.join(sent_if_few(labels), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
