"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its five-word shingles, weighted by how often they occur (a
shorter text is one term).  For every sample and term, two gamma(2, 1) draws r and c and a uniform
draw b give

    t = floor(ln(weight) / r + b),   ln a = ln c - r * (t - b) - r,

and the sample is the pair (term, t) of the least a.  Two documents agree on a sample with a
probability equal to the generalised Jaccard similarity of their weights, sum(min) / sum(max).

Draws belong to terms: they come from a table addressed by the term's hash, made anew from the seed
in every worker.  Terms at one address share draws; the lesser hash wins between equal ones, which
keeps the estimate unbiased.  A fingerprint is `SAMPLES` numbers of 16 bits in hexadecimal.

`edited_pairs` also compares every document with an edited text that borrows from the document that
follows in descending order of id.  Documents are dealt out by ranges of ids, so their texts are
shuffled once; each range also gets the first document of the next one, found from ids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplab.llm.stored import sent_if_few
from cliplab.llm.words import mix, word_chunks
from cliplab.session import cut_lineage

SAMPLES = 128
ADDRESSES = 1 << 15
SHINGLE = 5
RANGE_ROWS = 512  # documents of a range of ids, on average
PIECE_RANGES = 100_000  # ranges that one task puts in order
BROADCAST_RANGES = 200_000
ROWS = 1024


class Draws:
    """The table of draws, and samples of weighted terms."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        shape = (ADDRESSES, SAMPLES)
        self.r = rng.standard_gamma(2.0, shape, dtype=np.float32)
        self.log_c = np.log(rng.standard_gamma(2.0, shape, dtype=np.float32))
        self.b = rng.random(shape, dtype=np.float32)
        #: ln a for weight 1, where t is 0: most terms occur once
        self.once = self.log_c + self.r * self.b - self.r

    def sample(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """16 bits per sample of distinct terms, in ascending order of hash, and their weights; zeros without terms."""
        out = np.zeros(SAMPLES, dtype=np.uint16)
        if not len(terms):
            return out
        least = np.full(SAMPLES, np.inf, dtype=np.float32)
        term, level = np.zeros(SAMPLES, dtype=np.uint64), np.zeros(SAMPLES, dtype=np.int64)
        at = (terms >> np.uint64(49)).astype(np.int64)
        for i in range(0, len(terms), 4096):
            own, rows = slice(i, i + 4096), at[i : i + 4096]
            log_a = self.once[rows]
            often = np.flatnonzero(weights[own] > 1)
            t = np.zeros((len(often), SAMPLES), dtype=np.int64)
            if len(often):
                r, b = self.r[rows[often]], self.b[rows[often]]
                whole = np.floor(np.log(weights[own][often].astype(np.float32))[:, None] / r + b)
                log_a[often] = self.log_c[rows[often]] - r * (whole - b) - r
                t = whole.astype(np.int64)
            best = log_a.argmin(axis=0)
            value = log_a[best, np.arange(SAMPLES)]
            better = value < least
            least[better], term[better] = value[better], terms[own][best[better]]
            place = np.full(len(rows), -1)
            place[often] = np.arange(len(often))
            slot = place[best]
            level[better] = np.where(slot >= 0, t[slot, np.arange(SAMPLES)] if len(often) else 0, 0)[better]
        return (mix(term + level.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def batch_samples(draws: Draws, texts: pa.Array) -> Iterator[np.ndarray]:
    for i, j, words in word_chunks(texts):
        values, at = words.shingles(SHINGLE)
        for d in range(j - i):
            yield draws.sample(*np.unique(values[at[d] : at[d + 1]], return_counts=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third (floor) replaced by as many first code points of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_kept: dict[int, Draws] = {}


def _draws(seed: int) -> Draws:
    if seed not in _kept:
        _kept.clear()
        _kept[seed] = Draws(seed)
    return _kept[seed]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(seed: int):
    """Rows come ordered by range and descending id; the last row of a range is only looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _draws(seed)
        before: tuple | None = None  # the last row seen: range, id, text, samples
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                batch = whole.slice(i, ROWS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                samples = batch_samples(draws, pa.array(texts, pa.large_string()))
                done: list[tuple] = []
                for place, ahead, doc_id, text, own in zip(
                    batch.column("place").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist(), texts, samples, strict=True
                ):
                    if before is not None and before[0] == place:
                        done.append((*before[1:], text, own))
                        before = None if ahead else (place, doc_id, text, own)
                    elif not ahead:
                        before = (place, doc_id, text, own)
                changed = [edited(text, following) for _, text, _, following, _ in done]
                other = batch_samples(draws, pa.array(changed, pa.large_string()))
                rows = [
                    (
                        doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.astype(">u2").tobytes().hex(),
                        alike.astype(">u2").tobytes().hex(), likeness(own, alike), likeness(own, following),
                    )
                    for (doc_id, text, own, _, following), new, alike in zip(done, changed, other, strict=True)
                ]
                columns = zip(*rows, strict=True) if rows else [()] * len(_COLUMNS)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _COLUMNS)

    return run


def _cut(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """`rows` with `place` longer by the part of its cell that `at` falls into, where the cell is wide."""
    far = (F.col("at").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")).cast("double")
    span = (F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")).cast("double")
    part = F.least(F.floor(far * F.col("parts") / (span + 1)), F.col("parts") - 1).cast("long")
    joined = rows.join(sent_if_few(wide), F.col("place") == F.col("wide_place"), "left")
    place = F.when(F.col("parts").isNull(), F.col("place")).otherwise(F.concat("place", F.array(part)))
    return joined.withColumn("place", place).drop("wide_place", "low", "high", "parts")


def _ranges(docs: DataFrame) -> DataFrame:
    """`docs` with `at` and `place`: ranges of RANGE_ROWS rows on average and at most twice as many, unless `at` is all the same.

    `at` is the id, for rows without one a hash of the text; places grow with it, those without id
    come first.  A cell that holds too many rows is cut into even parts, these again, for any spread.
    """
    lost = not docs.filter("doc_id IS NULL").isEmpty()
    at = F.coalesce("doc_id", F.xxhash64("text")) if lost else F.col("doc_id")
    line = F.array(F.col("doc_id").isNotNull().cast("long"))
    placed = docs.withColumn("at", at).withColumn("place", line)
    cells = placed.select("at", "place")
    while True:
        sizes = cells.groupBy("place").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"))
        wide = sizes.filter((F.col("n") > 2 * RANGE_ROWS) & (F.col("high") > F.col("low")))
        wide = wide.select(F.col("place").alias("wide_place"), "low", "high", F.ceil(F.col("n") / RANGE_ROWS).cast("long").alias("parts"))
        wide = cut_lineage(wide)
        if wide.isEmpty():
            return placed
        cells, placed = _cut(cells, wide), _cut(placed, wide)


def _heads(placed: DataFrame) -> DataFrame:
    """head_place, head (its greatest `at`) and above, the next place; after the last comes the first."""
    heads = placed.groupBy(F.col("place").alias("head_place")).agg(F.max("at").alias("head"))
    heads = cut_lineage(heads)
    pieces = max(1, heads.count() // PIECE_RANGES)
    heads = cut_lineage(heads.repartitionByRange(pieces, "head_place").withColumn("piece", F.spark_partition_id()))
    firsts = heads.groupBy("piece").agg(F.min("head_place").alias("first"))  # one row per PIECE_RANGES ranges
    order = Window.orderBy("piece")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("piece", F.coalesce(F.lead("first").over(order), F.min("first").over(everything)).alias("after"))
    within = F.lead("head_place").over(Window.partitionBy("piece").orderBy("head_place"))
    return heads.join(firsts, "piece").select("head_place", "head", F.coalesce(within, F.col("after")).alias("above"))


def edited_pairs(docs: DataFrame, seed: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of `docs`.

    Equal texts have equal fingerprints; a null text counts as empty, and empty texts are alike to
    each other alone.  The next document is the next row by descending doc_id (null last, those by a hash
    of their text; rows that repeat an id by text), after the last the first; a single row is its own
    next.  Ids may be of any spread; rows that repeat one id pass one by one.
    """
    placed = _ranges(docs.select("doc_id", "text"))
    # the range above needs the head of this one, the lowest that of the highest; one row per range
    heads = cut_lineage(_heads(placed))
    few = heads.count() <= BROADCAST_RANGES  # beyond, Spark joins by shuffle
    is_head = (F.col("place") == F.col("head_place")) & (F.col("at") == F.col("head"))
    joined = placed.join(F.broadcast(heads) if few else heads, is_head, "left")
    here = F.struct(F.col("place"), F.lit(False).alias("ahead"))
    there = F.struct(F.col("above").alias("place"), F.lit(True).alias("ahead"))
    sent = joined.withColumn("to", F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))))
    sent = sent.select("to.place", "to.ahead", "at", "doc_id", "text")
    dealt = sent.repartition("place").sortWithinPartitions("place", "ahead", F.desc("at"), "text")
    return dealt.mapInArrow(
        _compare(seed),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
