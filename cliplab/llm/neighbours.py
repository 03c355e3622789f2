"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact distance.

Every table projects vectors on orthonormal Gaussian directions and cuts the lines into slots of one
width; the slot numbers form a bucket.  A query visits its own bucket and perturbed ones, in order
of the estimated chance of success: a step across the nearer slot border costs the square of the
distance to it, and perturbation sets come out of a heap by total cost.

All rows are indexed; only the centre and the spread of projections are fitted on a sample of
`FIT_ROWS` vectors (chosen by hash of the id).  Index rows and probes meet in cells: buckets dealt
out by hash.  Cells are counted first, and a cell of many rows (one bucket may hold a third of
them) is split, with its probes copied to every split.  A query comes to a cell once, with all its
buckets there.  Each cell returns the k best of a query by exact distance; these are merged.
Queries that found fewer than k although more vectors exist are compared with every cell.

Null vectors, zero vectors and vectors with null or non-finite components take no part; vectors
of different lengths never meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cliplab.llm.words import mix
from cliplab.session import cut_lineage

FIT_ROWS = 2000
CELL_ROWS = 8192  # rows of a table that should meet in a cell
SPLIT_ROWS = 16384  # and at most, before the cell is split


def takes_part(vector: Column) -> Column:
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


class Hasher:
    """The tables for vectors of one length."""

    def __init__(self, sample: np.ndarray, tables: int, hashes: int, width: float, seed: int):
        dim = sample.shape[1]
        rng = np.random.default_rng([seed, dim])
        self.centre = sample.mean(axis=0)
        self.planes = []
        for _ in range(tables):
            plane = rng.standard_normal((dim, hashes))
            if hashes <= dim:
                plane, _ = np.linalg.qr(plane)
            spread = float(((sample - self.centre) @ plane).std()) or 1.0
            self.planes.append((plane / (width * spread), rng.random(hashes)))

    def positions(self, table: int, vectors: np.ndarray) -> np.ndarray:
        plane, shift = self.planes[table]
        return (vectors - self.centre) @ plane + shift

    @staticmethod
    def bucket(table: int, slots: np.ndarray) -> np.ndarray:
        h = np.full(slots.shape[0], table + 1, dtype=np.uint64)
        for m in range(slots.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + slots[:, m].astype(np.int64).view(np.uint64))
        return h.view(np.int64)


def perturbations(inside: np.ndarray, count: int) -> list[list[tuple[int, int]]]:
    """The `count` cheapest sets of steps (hash, -1 or +1), beginning with no step.

    `inside` holds the place of a query within its slots, from 0 to 1.
    """
    m = len(inside)
    steps = sorted([(float(x * x), i, -1) for i, x in enumerate(inside)] + [(float((1 - x) ** 2), i, 1) for i, x in enumerate(inside)])
    found: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(found) < count:
        cost, chosen = heapq.heappop(heap)
        if len({steps[c][1] for c in chosen}) == len(chosen):
            found.append([steps[c][1:] for c in chosen])
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (cost + steps[last + 1][0], chosen + (last + 1,)))
    return found


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for every vector length in a batch."""
    sizes = np.diff(np.asarray(column.offsets))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.asarray(column.offsets)[:-1] - int(np.asarray(column.offsets)[0])
    values = values[int(np.asarray(column.offsets)[0]) :] if len(column) else values
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[starts[rows][:, None] + np.arange(dim)]


def _send_rows(hashers: dict[int, Hasher], cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrix(batch.column("vector")):
                hasher = hashers.get(vectors.shape[1])
                for t in range(len(hasher.planes)) if hasher else ():
                    bucket = hasher.bucket(t, np.floor(hasher.positions(t, vectors)))
                    cell = (bucket.view(np.uint64) % np.uint64(cells)).astype(np.int64)
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t)), pa.array(cell), pa.array(bucket), part.column("vec_id"), part.column("vector")],
                        ["tab", "cell", "bucket", "vec_id", "vector"],
                    )

    return run


def _send_probes(hashers: dict[int, Hasher], cells: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"tab": [], "cell": [], "buckets": [], "row": []}
            for rows, vectors in _matrix(batch.column("vector")):
                hasher = hashers.get(vectors.shape[1])
                for t in range(len(hasher.planes)) if hasher else ():
                    place = hasher.positions(t, vectors)
                    home = np.floor(place)
                    for r, slots, inside in zip(rows, home, place - home, strict=True):
                        sets = perturbations(inside, probes)
                        moved = np.repeat(slots[None], len(sets), axis=0)
                        for i, steps in enumerate(sets):
                            for m, step in steps:
                                moved[i, m] += step
                        buckets = np.unique(hasher.bucket(t, moved))
                        cell = buckets.view(np.uint64) % np.uint64(cells)
                        for c in np.unique(cell):
                            out["tab"].append(t)
                            out["cell"].append(int(c))
                            out["buckets"].append(buckets[cell == c])
                            out["row"].append(r)
            part = batch.take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["tab"], pa.int64()), pa.array(out["cell"], pa.int64()),
                    pa.array(out["buckets"], pa.list_(pa.int64())), part.column("vec_id"), part.column("vector"),
                ],
                ["tab", "cell", "buckets", "vec_id", "vector"],
            )

    return run


def _best(k: int):
    """The k nearest of each query among the rows of one split that lie in its buckets (all, if it names none)."""

    def run(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        rows = []
        by_dim = index.groupby(index["vector"].map(len)) if len(index) and len(probes) else ()
        for dim, part in by_dim:
            part = part.sort_values("bucket", kind="stable")
            vectors = np.stack(part["vector"]).astype(np.float64)
            buckets, ids = part["bucket"].to_numpy(), part["vec_id"].to_numpy()
            for query, vector, own in zip(probes["vec_id"], probes["vector"], probes["buckets"], strict=True):
                if len(vector) != dim:
                    continue
                at = np.arange(len(ids))
                if len(own):
                    lo, hi = np.searchsorted(buckets, own, "left"), np.searchsorted(buckets, own, "right")
                    at = np.concatenate([at[a:b] for a, b in zip(lo, hi, strict=True)])
                at = at[ids[at] != query]
                gap = vectors[at] - np.asarray(vector, dtype=np.float64)
                score = np.sqrt((gap * gap).sum(axis=1))
                if len(at) > 4 * k:
                    near = np.flatnonzero(score <= np.partition(score, 4 * k)[4 * k])
                    at, score = at[near], score[near]
                seen: set[int] = set()
                for i in np.lexsort((ids[at], score)):
                    if len(seen) == k:
                        break
                    if ids[at[i]] not in seen:
                        seen.add(ids[at[i]])
                        rows.append((query, ids[at[i]], score[i]))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = 6,
    hashes: int = 8,
    width: float = 2.2,
    probes: int = 160,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every row of `vectors` where `is_query`.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id.  A row never
    finds rows of its own id; of rows that repeat an id the nearest counts.  Rows without id take no
    part.  `width` is in standard deviations of a projection.
    """
    rows = vectors.filter(takes_part(F.col(vector_col)) & F.col(id_col).isNotNull())
    kind = vectors.schema[vector_col].dataType
    chosen = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sample = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").toPandas()["vector"]
    lengths = [r[0] for r in chosen.select(F.size("vector")).distinct().orderBy(F.size("vector")).limit(FIT_ROWS).collect()]
    hashers = {}
    for dim in lengths:
        own = [v for v in sample if len(v) == dim]
        # no sampled vector of this length: directions at unit spread around zero
        fit = np.stack(own).astype(np.float64) if own else np.vstack([np.eye(dim), -np.eye(dim)])
        hashers[dim] = Hasher(fit, tables, hashes, width, seed)
    count = chosen.count()
    cells = max(1, count // CELL_ROWS)

    kept = lambda *more: StructType([StructField("tab", LongType()), StructField("cell", LongType()), *more, StructField("vec_id", LongType()), StructField("vector", kind)])
    plain = chosen.select("vec_id", "vector")
    index = plain.mapInArrow(_send_rows(hashers, cells), kept(StructField("bucket", LongType())))
    sizes = index.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n"))
    splits = cut_lineage(sizes.select("tab", "cell", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("splits")))
    index = index.join(splits, ["tab", "cell"])
    index = index.withColumn("split", F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int")).drop("splits")
    buckets = StructField("buckets", ArrayType(LongType()))
    asked = chosen.filter("asks").select("vec_id", "vector").mapInArrow(_send_probes(hashers, cells, probes), kept(buckets))

    def meet(questions: DataFrame) -> DataFrame:
        everywhere = questions.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
        keys = ["tab", "cell", "split"]
        found = index.groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInPandas(
            _best(k), "query_id long, vec_id long, score double"
        )
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    found = cut_lineage(meet(asked.join(splits, ["tab", "cell"])))
    others = chosen.groupBy(F.size("vector").alias("dim")).agg((F.countDistinct("vec_id") - 1).alias("others"))
    queries = chosen.filter("asks").withColumn("dim", F.size("vector")).join(others, "dim")
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    short = queries.join(have, F.col("vec_id") == F.col("query_id"), "left").filter(
        F.coalesce("have", F.lit(0)) < F.least(F.lit(k), "others")
    )
    short = cut_lineage(short.select("vec_id", "vector"))
    if not short.isEmpty():
        one = splits.filter("tab = 0")
        every_cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
        everywhere = short.withColumn("cell", every_cell)
        questions = everywhere.select(
            F.lit(0).cast("long").alias("tab"), "cell", F.array().cast("array<bigint>").alias("buckets"), "vec_id", "vector"
        )
        found = found.unionByName(meet(questions.join(one, ["tab", "cell"])))
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
