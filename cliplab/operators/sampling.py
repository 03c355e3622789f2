"""Intervals, frame grids and item samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplab.functions.hashing import digest_uniform, seeded_digest
from cliplab.operators.ranking import GROUP_LIMIT_PUSHDOWN, first_by_hash, group_rank
from cliplab.session import cut_lineage

BLOCK = 10_000


def explode_range(df: DataFrame, count: Column, name: str) -> DataFrame:
    """One row per 0 <= name < count, generated block by block so that no array is long."""
    blocks = df.withColumn("__n", count.cast("bigint")).filter(F.col("__n") > 0)
    blocks = blocks.withColumn("__blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / BLOCK))))
    first = F.col("__blk") * BLOCK
    last = F.least(first + BLOCK, F.col("__n")) - 1
    return blocks.withColumn(name, F.explode(F.sequence(first, last))).drop("__n", "__blk")


def sample_intervals(
    videos: DataFrame, interval_sec: float, n_intervals: int, seed: int = 42, key: str = "video_id",
    total: str = "total_frames", fps: str = "fps",
) -> DataFrame:
    """Up to n non-overlapping grid intervals per video: (key, start_frame, end_frame).

    Starts run over range(0, total - k, k) with k = int(interval_sec * fps), so
    an interval ending exactly on the last frame is not offered.
    """
    sized = videos.withColumn("__k", F.floor(F.lit(float(interval_sec)) * F.col(fps)).cast("bigint"))
    starts = F.ceil((F.col(total) - F.col("__k")) / F.col("__k"))
    grid = explode_range(sized.filter("__k > 0"), starts, "__i")
    grid = grid.withColumn("start_frame", F.col("__i") * F.col("__k"))
    grid = grid.withColumn("__d", seeded_digest(seed, key, "start_frame"))
    chosen = first_by_hash(grid, [key], "__d", ["start_frame"], n_intervals)
    return chosen.select(key, "start_frame", (F.col("start_frame") + F.col("__k")).alias("end_frame"))


def sample_segment_intervals(
    segments: DataFrame, interval_sec: float, seed: int = 42, key: Sequence[str] = ("record_id", "start_s", "end_s")
) -> DataFrame:
    """One random sub-interval inside each segment longer than interval_sec, as frame numbers."""
    long = segments.filter(F.col("end_s") - F.col("start_s") > F.lit(float(interval_sec)))
    offset = digest_uniform(seeded_digest(seed, *key)) * (F.col("end_s") - F.col("start_s") - F.lit(float(interval_sec)))
    begin = F.col("start_s") + offset
    return long.withColumns(
        {
            "start_frame": F.floor(begin * F.col("fps")).cast("bigint"),
            "end_frame": F.floor((begin + F.lit(float(interval_sec))) * F.col("fps")).cast("bigint"),
        }
    )


def build_frame_queue(intervals: DataFrame, fps: str = "fps", sample_fps: float = 1.0) -> DataFrame:
    """Expand [start_frame, end_frame) to frames at a stride of max(1, int(fps / sample_fps))."""
    stepped = intervals.withColumn("__step", F.greatest(F.lit(1), F.floor(F.col(fps) / F.lit(float(sample_fps)))))
    n = F.ceil((F.col("end_frame") - F.col("start_frame")) / F.col("__step"))
    out = explode_range(stepped, n, "__i")
    out = out.withColumn("frame_idx", F.col("start_frame") + F.col("__i") * F.col("__step"))
    return out.withColumn("timestamp_s", F.col("frame_idx") / F.col(fps)).drop("__i", "__step")


def sample_timestamps(
    windows: DataFrame, fps_target: float, start: str = "start_s", end: str = "end_s", offset: str | None = None,
    fps: str | None = None, duration: str | None = None,
) -> DataFrame:
    """Half-open grid start + i / fps_target, with frame number round(t * fps) when `fps` is given.

    `offset` moves overlay time to video time; timestamps outside [0, duration)
    are dropped (an unknown or zero duration does not limit).
    """
    if fps_target <= 0:
        return windows.filter(F.lit(False)).withColumn("timestamp_s", F.lit(0.0))
    step = 1.0 / fps_target
    n = F.ceil((F.col(end) - F.col(start)) / F.lit(step))
    out = explode_range(windows.filter(F.col(end) > F.col(start)), n, "__i")
    t = F.col(start) + F.col("__i") * F.lit(step)
    if offset is not None:
        t = t + F.col(offset)
    out = out.withColumn("timestamp_s", t).drop("__i").filter(F.col("timestamp_s") >= 0)
    if duration is not None:
        d = F.coalesce(F.col(duration), F.lit(0.0))
        out = out.filter((d <= 0) | (F.col("timestamp_s") < d))
    if fps is not None:
        out = out.withColumn("frame_number", F.bround(F.col("timestamp_s") * F.col(fps), 0).cast("bigint"))
    return out


def sample_rows(
    df: DataFrame, n: int, seed: int = 42, key: Sequence[str] = ("frame_id",), per: Sequence[str] = ()
) -> DataFrame:
    """Seeded simple random sample of n rows, or of n rows per group."""
    keyed = df.withColumn("__d", seeded_digest(seed, *key))
    if per or n > GROUP_LIMIT_PUSHDOWN:
        return first_by_hash(keyed, list(per), "__d", list(key), n).drop("__d")
    return keyed.orderBy("__d", *key).limit(n).drop("__d")  # planned as a distributed top-n


def every_nth(df: DataFrame, n: int, position: str = "frame_number") -> DataFrame:
    """Frames whose running index is a multiple of n."""
    return df.filter(F.col(position) % n == 0)


def every_nth_ranked(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], span: int = 4096
) -> DataFrame:
    """Every n-th row of each group in order, for numbering with gaps."""
    bucketed = df.withColumn("__b", F.floor(F.col(order[0]) / F.lit(span)))
    ranked = group_rank(bucketed, keys, ["__b"], [F.col(c) for c in order], "__r")
    return ranked.filter((F.col("__r") - 1) % n == 0).drop("__b", "__r", "__r_total")


def uniform_stride(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_count: int, span: int = 4096
) -> DataFrame:
    """Rows at round-half-even(linspace(0, n-1, max_count)) of each group; whole group if it is small.

    A row tests whether one of the two grid points next to it rounds to it, so
    no index list is built or joined.
    """
    bucketed = df.withColumn("__b", F.floor(F.col(order[0]) / F.lit(span)))
    ranked = group_rank(bucketed, keys, ["__b"], [F.col(c) for c in order], "__r")
    n, r = F.col("__r_total"), (F.col("__r") - 1).cast("double")
    if max_count == 1:
        hit = F.col("__r") == 1
    else:
        step = (n - 1) / F.lit(float(max_count - 1))
        below = F.floor(r / step)

        def lands(i: Column) -> Column:
            at = F.when(i == max_count - 1, (n - 1).cast("double")).otherwise(i * step)
            return (i >= 0) & (i < max_count) & (F.bround(at, 0) == r)

        hit = lands(below) | lands(below + 1)
    return ranked.filter((n <= max_count) | hit).drop("__b", "__r", "__r_total")


# --------------------------------------------------------- diversity sample


def _greedy_picks(vectors: np.ndarray, k: int) -> list[int]:
    taken = [0]
    nearest = np.linalg.norm(vectors - vectors[0], axis=1)
    nearest[0] = -1.0
    while len(taken) < min(k, len(vectors)):
        nxt = int(np.argmax(nearest))
        taken.append(nxt)
        nearest = np.minimum(nearest, np.linalg.norm(vectors - vectors[nxt], axis=1))
        nearest[taken] = -1.0
    return taken


def diversity_sample(
    df: DataFrame, segment: str, item: str, vector: str, max_count: int, group_limit: int = 5_000
) -> DataFrame:
    """Greedy farthest-point sample per segment: (segment, item, pick_order).

    Starts at the lowest item id; the farthest item is next, lowest id on ties,
    and an item is never taken twice.  Segments up to `group_limit` items run in
    one task each; longer ones run the same greedy rounds over distributed rows,
    one shuffle of maxima per round.
    """
    rows = df.select(F.col(segment).alias("segment"), F.col(item).alias("item"), F.col(vector).alias("vec"))
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter(F.col("__n") > group_limit).select("segment")
    n_large = large.limit(100_001).count()

    def one_segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        picks = _greedy_picks(np.stack(pdf["vec"].to_numpy()).astype(np.float64), max_count)
        return pd.DataFrame(
            {"segment": pdf["segment"].iloc[0], "item": pdf["item"].to_numpy()[picks], "pick_order": range(len(picks))}
        )

    types = dict(rows.dtypes)
    out_schema = f"segment {types['segment']}, item {types['item']}, pick_order int"
    if n_large == 0:
        picked = rows.groupBy("segment").applyInPandas(one_segment, out_schema)
    else:
        side = F.broadcast(large) if n_large <= 100_000 else large
        small_rows = rows.join(side, "segment", "left_anti")
        picked = small_rows.groupBy("segment").applyInPandas(one_segment, out_schema).unionByName(
            _distributed_picks(rows.join(side, "segment", "left_semi"), max_count, n_large <= 100_000)
        )
    return picked.select(F.col("segment").alias(segment), F.col("item").alias(item), "pick_order")


def _distributed_picks(rows: DataFrame, k: int, small_side: bool) -> DataFrame:
    salts = 32

    def with_latest(state: DataFrame, latest: DataFrame) -> DataFrame:
        if small_side:
            return state.join(F.broadcast(latest), "segment")
        salted = state.withColumn("__s", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int"))
        copies = latest.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(copies, ["segment", "__s"]).drop("__s")

    state = cut_lineage(rows.withColumn("nearest", F.lit(float("inf"))))
    latest = state.groupBy("segment").agg(F.min_by(F.struct("item", "vec"), "item").alias("pick"))
    picked = None
    for order in range(k):
        latest = cut_lineage(latest)
        row = latest.select("segment", F.col("pick.item").alias("item"), F.lit(order).alias("pick_order"))
        picked = row if picked is None else picked.unionByName(row)
        if order == k - 1:
            break
        gap = F.sqrt(
            F.aggregate(
                F.zip_with("vec", "pick.vec", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))),
                F.lit(0.0),
                lambda acc, x: acc + x,
            )
        )
        state = with_latest(state, latest).select(
            "segment", "item", "vec",
            F.when((F.col("item") == F.col("pick.item")) | (F.col("nearest") < 0), F.lit(-1.0))
            .otherwise(F.least("nearest", gap)).alias("nearest"),
        )
        state = cut_lineage(state)
        # farthest first; equal distances give the lowest item
        top = state.filter("nearest >= 0").groupBy("segment").agg(F.max("nearest").alias("__top"))
        tied = with_latest(state, top).filter(F.col("nearest") == F.col("__top"))
        latest = tied.groupBy("segment").agg(F.min_by(F.struct("item", "vec"), "item").alias("pick"))
    return picked
