"""Bootstrap confidence intervals whose cost does not grow with rows x replicates.

Drawing n rows out of n with replacement gives every distinct (score, label,
pred) cell a multinomial count.  So rows are first combined to cells, and the
multinomial is drawn in two exact steps: the counts of the score buckets (one
small draw per group and replicate), then the cells inside each bucket.  The
second step runs in many tasks, streams its cells in score order and keeps only
a few vectors, one entry per replicate.  All metrics of a replicate share its
draw.

One seed gives one result: buckets are ranges of the cells' rank, cells come in
score order and are drawn in blocks of a fixed number of cells, so neither
partitions nor Arrow batches nor the order of the input have a say.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplab.operators.curves import score_bucket
from cliplab.operators.metrics import binary_metrics, cell_metrics
from cliplab.operators.ranking import join_on

BUCKETS = 64  # ranges of about equally many cells per group
BLOCK_COUNTS = 500_000  # counts of a block: replicates x cells
HELD_COUNTS = 20_000  # counts at hand at once: few enough for the processor's cache
PAIR_CELLS = 64  # neighbouring cells whose pairs are counted by one matrix product
METRICS = ("accuracy", "auroc", "sensitivity", "specificity", "precision", "f1")
_PARTIAL = ("pos", "neg", "concordant", "tp", "fp", "fn", "tn")


def _rng(*parts: object) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(p).encode()) for p in parts])


def _bucket_draws(seed: int, n_replicates: int):
    """One row per group in, one row per bucket out: how often each bucket is drawn."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, buckets, counts in zip(batch["g"], batch["buckets"], batch["counts"], strict=True):
                order = np.argsort(buckets)
                names, n = np.asarray(buckets)[order], np.asarray(counts, dtype=np.int64)[order]
                drawn = _rng(seed, group, "buckets").multinomial(int(n.sum()), n / n.sum(), size=n_replicates)
                rows = [(group, int(b), drawn[:, i].tolist()) for i, b in enumerate(names)]
                yield pd.DataFrame(rows, columns=["g", "score_bucket", "draws"])

    return draw


def _block_draws(
    rng: np.random.Generator, left: np.ndarray, weight: int, n: np.ndarray
) -> tuple[np.ndarray, Iterator[tuple[slice, np.ndarray]]]:
    """Draws inside the block per replicate, and (replicates, replicate x cell counts) slice by slice, for cells of n rows each."""
    size = int(n.sum())
    inside = left.copy() if size >= weight else rng.binomial(left, size / weight)
    step = max(1, HELD_COUNTS // len(n))
    return inside, ((at, _counts(rng, inside[at], n, size)) for at in (slice(a, a + step) for a in range(0, len(left), step)))


def _counts(rng: np.random.Generator, inside: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    cells, replicates = len(n), len(inside)
    if size > 4 * cells:
        return rng.multinomial(inside, n / size).astype(np.float64)
    # few rows per cell: drawing row numbers is cheaper than one binomial per cell
    cell_of_row = np.repeat(np.arange(cells), n)
    picked = cell_of_row[rng.integers(0, size, size=int(inside.sum()))]
    picked += np.repeat(np.arange(replicates) * cells, inside)
    return np.bincount(picked, minlength=replicates * cells).reshape(replicates, cells).astype(np.float64)


def _sums(score: np.ndarray, label: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """What a cell's count adds to, a column each: the pairs with every cell (a positive beats every lower negative and
    half of the equal ones), tp, fp, fn, tn, and positives and negatives of the first and of the last score."""
    wins = (score[:, None] < score) + (score[:, None] == score) / 2
    kinds = [label & pred, ~label & pred, label & ~pred, ~label & ~pred]
    ends = [(score == score[i]) & y for i in (0, -1) for y in (label, ~label)]
    return np.column_stack([wins * (~label[:, None] & label), *kinds, *ends]).astype(np.float64)


def _cell_draws(seed: int):
    """Sorted cells of many (group, bucket) runs in, per-replicate partial sums out.

    Each run starts with a header row (score null) that holds its bucket draws.
    Draws go block by block of cells: first how many fall in the block, then which cells.  Cells wait
    until their block is full or the run ends, so blocks don't depend on how rows arrive.
    """

    def finish(run: dict) -> pd.DataFrame:
        out = pd.DataFrame({name: run[name] for name in _PARTIAL})
        out.insert(0, "g", run["g"])
        out.insert(1, "score_bucket", run["bucket"])
        out.insert(2, "replicate", np.arange(len(out)))
        return out

    def absorb(run: dict, rows: pd.DataFrame | None) -> None:
        """Take more cells of a run; None ends it."""
        waiting = run["waiting"] if rows is None else pd.concat([run["waiting"], rows])
        width = max(1, BLOCK_COUNTS // len(run["left"]))
        whole = len(waiting) if rows is None else len(waiting) // width * width
        run["waiting"] = waiting.iloc[whole:]
        for start in range(0, whole, width):
            block = waiting.iloc[start : min(start + width, whole)]
            n = block["n"].to_numpy(dtype=np.int64)
            inside, slices = _block_draws(run["rng"], run["left"], run["weight"], n)
            run["left"] = run["left"] - inside
            run["weight"] -= int(n.sum())
            label = block["label"].to_numpy() == 1
            pred = block["pred"].to_numpy() == 1
            score = block["score"].to_numpy()
            pairs = [slice(a, a + PAIR_CELLS) for a in range(0, len(n), PAIR_CELLS)]
            sums = [_sums(score[c], label[c], pred[c]) for c in pairs]
            for at, drawn in slices:
                last = run["last"]
                for c, of in zip(pairs, sums, strict=True):
                    count(run, at, np.ascontiguousarray(drawn[:, c]), of, score[c], last)
                    last = score[c][-1]
            run["last"] = score[-1]

    def count(run: dict, at: slice, drawn: np.ndarray, of: np.ndarray, score: np.ndarray, last: float | None) -> None:
        """Add the draws of neighbouring cells to the sums of some replicates."""
        found, cells = drawn @ of, drawn.shape[1]
        tp, fp, fn, tn, first_pos, first_neg, last_pos, last_neg = found[:, cells:].T
        run["concordant"][at] += np.einsum("ij,ij->i", found[:, :cells], drawn) + (tp + fn) * run["neg"][at]
        if carry := last == score[0]:  # a score cut by the border: its cross pairs count one half
            run["concordant"][at] += (run["tied_pos"][at] * first_neg - first_pos * run["tied_neg"][at]) / 2
            carry = score[0] == score[-1]
        run["tied_pos"][at] = last_pos + (run["tied_pos"][at] if carry else 0.0)
        run["tied_neg"][at] = last_neg + (run["tied_neg"][at] if carry else 0.0)
        for name, more in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn), ("pos", tp + fn), ("neg", fp + tn)):
            run[name][at] += more

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: dict | None = None
        for batch in batches:
            heads = np.flatnonzero(batch["draws"].notna().to_numpy())
            cuts = [0, *heads.tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                piece = batch.iloc[lo:hi]
                if lo in heads:
                    if run is not None:
                        absorb(run, None)
                        yield finish(run)
                    head = piece.iloc[0]
                    left = np.asarray(head["draws"], dtype=np.int64)
                    run = {
                        "g": head["g"], "bucket": head["score_bucket"], "waiting": piece.iloc[:0],
                        "left": left, "weight": int(head["n"]), "last": None,
                        "rng": _rng(seed, head["g"], head["score_bucket"]),
                    }
                    run |= {name: np.zeros(len(left)) for name in _PARTIAL}
                    run |= {"tied_neg": np.zeros(len(left)), "tied_pos": np.zeros(len(left))}
                    piece = piece.iloc[1:]
                if len(piece):
                    absorb(run, piece)
        if run is not None:
            absorb(run, None)
            yield finish(run)

    return draw


def replicate_metrics(
    df: DataFrame,
    groups: Sequence[str] = (),
    n_replicates: int = 1000,
    seed: int = 42,
    label: str = "label",
    pred: str = "pred",
    score: str = "prob",
) -> DataFrame:
    """(groups, replicate, six metrics); replicates with one class only are left out.

    Exact on distinct scores: the work is (distinct cells) x replicates, never
    rows x replicates.  Round very fine scores beforehand to bound the cells.
    """
    groups = list(groups)
    g = F.to_json(F.struct(*groups)) if groups else F.lit("all")
    cells = (
        df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull() & F.col(score).isNotNull())
        .groupBy(
            *groups,
            F.col(score).cast("double").alias("score"),
            F.col(label).cast("int").alias("label"),
            F.col(pred).cast("int").alias("pred"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(g.alias("g"), score_bucket(F.col("score")).alias("fine"), "score", "label", "pred", "n")
    )
    # fine buckets are joined to ranges of about equally many cells
    fine = cells.groupBy("g", "fine").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy("g").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(along), F.lit(0))
    total = F.sum("c").over(Window.partitionBy("g"))
    ranges = fine.select("g", "fine", F.floor(before * BUCKETS / total).cast("int").alias("score_bucket"))
    cells = cells.join(ranges, ["g", "fine"]).drop("fine")
    buckets = cells.groupBy("g", "score_bucket").agg(F.sum("n").alias("n"))
    packed = buckets.groupBy("g").agg(  # at most BUCKETS entries
        F.collect_list(F.struct("score_bucket", "n")).alias("b")
    ).select("g", F.col("b.score_bucket").alias("buckets"), F.col("b.n").alias("counts"))
    draws = packed.mapInPandas(
        _bucket_draws(seed, n_replicates), "g string, score_bucket int, draws array<bigint>"
    ).join(buckets, ["g", "score_bucket"])
    body = cells.withColumn("draws", F.lit(None).cast(T.ArrayType(T.LongType())))
    header = draws.select(
        "g", "score_bucket", F.lit(None).cast("double").alias("score"), F.lit(0).alias("label"),
        F.lit(0).alias("pred"), "n", "draws",
    )
    runs = ["g", "score_bucket"]
    sorted_runs = (
        header.unionByName(body)
        .repartition(*runs)
        .sortWithinPartitions(*runs, F.col("score").asc_nulls_first(), "label", "pred")
    )
    partial = sorted_runs.mapInPandas(
        _cell_draws(seed),
        "g string, score_bucket int, replicate int, " + ", ".join(f"{c} double" for c in _PARTIAL),
    )
    earlier = (
        Window.partitionBy("g", "replicate").orderBy("score_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    merged = (
        partial.withColumn("__before", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
        .groupBy("g", "replicate")
        .agg(
            F.sum(F.col("concordant") + F.col("pos") * F.col("__before")).alias("__num"),
            *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "fn", "tn")],
        )
        .filter((F.col("pos") > 0) & (F.col("neg") > 0))
        .withColumns(cell_metrics())
        .withColumn("auroc", F.col("__num") / (F.col("pos") * F.col("neg")))
    )
    if groups:
        types = df.select(*groups).schema
        merged = merged.withColumn("__k", F.from_json("g", types)).select("__k.*", "replicate", *METRICS)
    else:
        merged = merged.select("replicate", *METRICS)
    return merged


def intervals(replicates: DataFrame, groups: Sequence[str] = (), ci: float = 95.0, digits: int | None = 3) -> DataFrame:
    """(groups, metric, mean, lower, upper, n_replicates) with interpolated percentiles.

    The mean is that of the bootstrap scores.  Percentiles hold at most one
    value per replicate.
    """
    groups = list(groups)
    tail = (100.0 - ci) / 200.0
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = replicates.select(*groups, F.explode(pairs).alias("__p")).select(
        *groups, "__p.metric", "__p.value"
    ).filter(F.col("value").isNotNull())

    def tidy(c):
        return F.round(c, digits) if digits is not None else c

    return long.groupBy(*groups, "metric").agg(
        tidy(F.avg("value")).alias("mean"),
        tidy(F.percentile("value", F.lit(tail))).alias("lower"),
        tidy(F.percentile("value", F.lit(1.0 - tail))).alias("upper"),
        F.count(F.lit(1)).alias("n_replicates"),
    )


def metrics_with_ci(
    df: DataFrame,
    groups: Sequence[str] = (),
    n_replicates: int = 1000,
    seed: int = 42,
    ci: float = 95.0,
    label: str = "label",
    pred: str = "pred",
    score: str = "prob",
) -> DataFrame:
    """All metrics with intervals.

    Groups without any two-class replicate have their point value as mean, null bounds and
    n_replicates 0; metrics that are undefined there have no row.
    """
    groups = list(groups)
    drawn = intervals(replicate_metrics(df, groups, n_replicates, seed, label, pred, score), groups, ci)
    known = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull() & F.col(score).isNotNull())
    point = binary_metrics(known, groups, label, pred, score)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in METRICS])
    points = point.select(*groups, F.explode(pairs).alias("__p")).select(*groups, "__p.*")
    both = join_on(points.filter("point IS NOT NULL"), drawn, [*groups, "metric"], "left")
    return both.select(
        *groups, "metric", F.coalesce("mean", F.round("point", 3)).alias("mean"), "lower", "upper",
        F.coalesce("n_replicates", F.lit(0).cast("bigint")).alias("n_replicates"),
    )
