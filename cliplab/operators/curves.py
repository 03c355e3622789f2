"""Score histograms and everything that is a running sum over them.

AUROC, ROC points, threshold sweeps and DeLong placement values all follow
from how many positives and negatives lie at, below and above each distinct
score.  Rows are first combined to (group, score) counts; running sums are then
taken inside score buckets, so neither a popular score nor a popular model
ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.operators.ranking import attach_by_group, join_on, running_totals

STEPS_PER_OCTAVE = 256


def score_bucket(score: Column) -> Column:
    """Order-preserving bucket of any number, finer where scores crowd.

    Classifiers saturate: buckets are equal steps of log2 of the distance to 0 below one half, to 1
    above it, and of the size itself outside [0, 1].  So scores near 0 or 1, tiny or huge ones and
    logits spread over many buckets.  It only deals out work; results don't depend on it.
    """
    x = score.cast("double")
    far = 5000 * STEPS_PER_OCTAVE  # beyond all logarithms of doubles

    def steps(size: Column) -> Column:
        return F.floor(F.log2(F.least(F.greatest(size, F.lit(5e-324)), F.lit(1.7e308))) * STEPS_PER_OCTAVE)

    bucket = (
        F.when(F.isnan(x), 2 * far)
        .when(x >= 1, far + steps(x))
        .when(x > 0.5, -steps(1 - x))
        .when(x > 0, steps(x))
        .when(x == 0, -far // 2)
        .otherwise(-far - steps(-x))
    )
    return F.when(x.isNotNull(), bucket).cast("int")


def score_histogram(df: DataFrame, groups: Sequence[str], label: str = "label", score: str = "prob") -> DataFrame:
    """(groups, score, pos, neg); rows without label or score are left out."""
    known = F.col(label).isNotNull() & F.col(score).isNotNull()
    return (
        df.filter(known)
        .groupBy(*groups, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
        )
        .withColumn("score_bucket", score_bucket(F.col("score")))
    )


def auroc_from_histogram(hist: DataFrame, groups: Sequence[str], unique_scores: bool = True) -> DataFrame:
    """Tie-aware AUROC per group; null where only one class is present.

    `hist` has (groups, score_bucket, score, pos, neg); with `unique_scores` off
    a score may be split over several rows.
    """
    groups = list(groups)
    part = [*groups, "score_bucket"]
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    if unique_scores:
        inside = Window.partitionBy(*part).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        beaten = F.coalesce(F.sum(neg).over(inside), F.lit(0.0)) + neg / 2
    else:
        up_to = Window.partitionBy(*part).orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        beaten = F.sum(neg).over(up_to) - F.sum(neg).over(Window.partitionBy(*part, "score")) / 2
    per_bucket = (
        hist.withColumn("__beaten", beaten)
        .groupBy(*part)
        .agg(
            F.sum(pos * F.col("__beaten")).alias("__within"),
            F.sum(pos).alias("__pos"),
            F.sum(neg).alias("__neg"),
        )
    )
    earlier = Window.partitionBy(*groups).orderBy("score_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_bucket.withColumn("__before", F.coalesce(F.sum("__neg").over(earlier), F.lit(0.0)))
        .groupBy(*groups)
        .agg(
            F.sum(F.col("__within") + F.col("__pos") * F.col("__before")).alias("__num"),
            F.sum("__pos").alias("__p"),
            F.sum("__neg").alias("__n"),
        )
        .select(
            *groups,
            F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__num") / (F.col("__p") * F.col("__n"))).alias(
                "auroc"
            ),
        )
    )


def auroc(df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "prob") -> DataFrame:
    return auroc_from_histogram(score_histogram(df, groups, label, score), groups)


def auroc_multiclass(
    df: DataFrame, groups: Sequence[str] = (), label: str = "label", probs: str = "probs"
) -> DataFrame:
    """Macro one-vs-rest AUROC from a probability array; absent classes are dropped.

    Probabilities are renormalised over the classes present in the group (row
    sums of zero divide by one).  With exactly two classes present the AUROC of
    the higher class is returned; with fewer than two it is null.
    """
    groups = list(groups)
    present = df.groupBy(*groups).agg(F.array_sort(F.collect_set(F.col(label).cast("int"))).alias("__present"))
    rows = attach_by_group(df.select(*groups, label, probs), present, groups)
    kept = F.transform("__present", lambda c: F.get(F.col(probs), c).cast("double"))
    rows = rows.withColumn("__kept", kept)
    total = F.aggregate("__kept", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("__sum", F.when(total <= 0, F.lit(1.0)).otherwise(total))
    long = rows.select(
        *groups, label, "__present", "__sum", F.posexplode("__kept").alias("__i", "__p")
    ).select(
        *groups,
        F.size("__present").alias("n_present"),
        F.get("__present", F.col("__i")).alias("class_id"),
        (F.col(label) == F.get("__present", F.col("__i"))).cast("int").alias("label"),
        (F.col("__p") / F.col("__sum")).alias("prob"),
        F.col("__i").alias("__i"),
    )
    long = long.filter((F.col("n_present") > 2) | ((F.col("n_present") == 2) & (F.col("__i") == 1)))
    per_class = auroc(long, [*groups, "class_id"])
    scored = per_class.groupBy(*groups).agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("n_curves"))
    base = present.select(*groups, F.size("__present").alias("n_classes"))
    return join_on(base, scored, groups, "left").select(*groups, "n_classes", "auroc")


def roc_points(df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "prob") -> DataFrame:
    """One ROC point per distinct score (predict positive at score >= threshold)."""
    hist = score_histogram(df, groups, label, score)
    cum = running_totals(
        hist, groups, ["score_bucket"], [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, bucket_desc=True
    )
    return cum.select(
        *groups,
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        (F.col("tp") / F.nullif(F.col("tp_total"), F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif(F.col("fp_total"), F.lit(0))).alias("fpr"),
    )


def nearest_roc_point(points: DataFrame, groups: Sequence[str], threshold: float) -> DataFrame:
    """The point whose threshold is closest (the higher threshold on equal distance)."""
    key = F.struct(F.abs(F.col("threshold") - F.lit(float(threshold))), -F.col("threshold"))
    return points.groupBy(*groups).agg(
        F.min_by(F.struct("threshold", "tpr", "fpr"), key).alias("p")
    ).select(*groups, "p.threshold", "p.tpr", "p.fpr")


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """Evenly spaced doubles: lo + i*step, with the last one exactly hi."""
    if n == 1:
        return [float(lo)]
    step = (hi - lo) / (n - 1)
    return [*(lo + i * step for i in range(n - 1)), float(hi)]


def sweep_grid(n_thresholds: int = 80) -> list[float]:
    """n+1 thresholds on [0.1, 0.9]."""
    return linspace(0.1, 0.9, n_thresholds + 1)


def _grid_index(score: Column, grid: Sequence[float]) -> Column:
    """How many grid values are <= score, in O(1): a guess, then a compare with the grid's own doubles."""
    lo, hi, last = grid[0], grid[-1], len(grid)
    values = F.array(*[F.lit(float(g)) for g in grid])
    step = (hi - lo) / max(last - 1, 1)
    guess = F.least(F.lit(last), F.greatest(F.lit(0), F.round((score - F.lit(lo)) / F.lit(step)).cast("int")))
    # the guess is within one of the answer, so two neighbours decide it
    up = F.when((guess < last) & (F.get(values, guess) <= score), 1).otherwise(0)
    down = F.when((guess > 0) & (F.get(values, guess - 1) > score), -1).otherwise(0)
    return (guess + up + down).cast("int")


def threshold_cells(
    df: DataFrame, groups: Sequence[str], grid: Sequence[float], label: str = "label", score: str = "prob"
) -> DataFrame:
    """tp, fp, fn, tn of every threshold in one pass over the rows.

    Each row is counted once at its grid index; the cells are reverse running
    sums over at most len(grid)+1 rows per group.
    """
    groups = list(groups)
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counted = (
        known.withColumn("__idx", _grid_index(F.col(score), grid))
        .groupBy(*groups, "__idx")
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
        )
    )
    # one row per group holding its (at most len(grid)+1) counters, then one row per threshold
    per_group = counted.groupBy(*groups).agg(
        F.collect_list(F.struct("__idx", "pos", "neg")).alias("__cells"),
        F.sum("pos").alias("__p"),
        F.sum("neg").alias("__n"),
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(g)).alias("t")) for i, g in enumerate(grid)])
    long = per_group.select(*groups, "__cells", "__p", "__n", F.explode(steps).alias("__s"))

    def reached(field: str) -> Column:
        return F.aggregate(
            "__cells",
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + F.when(c["__idx"] >= F.col("__s.i"), c[field]).otherwise(F.lit(0)),
        )

    long = long.withColumns({"tp": reached("pos"), "fp": reached("neg")})
    return long.select(
        *groups,
        F.col("__s.t").alias("threshold"),
        "tp",
        "fp",
        (F.col("__p") - F.col("tp")).alias("fn"),
        (F.col("__n") - F.col("fp")).alias("tn"),
    )
