"""DeLong tests between models and rank tests over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplab.functions.pvalues import EXACT_UP_TO, chi2_p, normal_p, signed_rank_pvalue, studentized_range_p
from cliplab.operators.curves import score_histogram
from cliplab.operators.ranking import join_on, running_totals
from cliplab.session import cut_lineage

SENT_SCORES = 2_000_000  # distinct scores that go to every task: some 80 bytes each


def placement_values(
    df: DataFrame, groups: Sequence[str], label: str = "label", score: str = "prob"
) -> DataFrame:
    """(groups, score, pos, neg, v10, v01) per distinct score.

    v10: share of negatives below the score (ties one half), for positives;
    v01: share of positives above it, for negatives.
    """
    hist = score_histogram(df, groups, label, score)
    cum = running_totals(
        hist, groups, ["score_bucket"], [F.col("score")], {"__p": F.col("pos"), "__n": F.col("neg")}
    )
    half = F.lit(0.5)
    return cum.select(
        *groups,
        "score",
        "pos",
        "neg",
        ((F.col("__n") - half * F.col("neg")) / F.nullif(F.col("__n_total"), F.lit(0))).alias("v10"),
        ((F.col("__p_total") - F.col("__p") + half * F.col("pos")) / F.nullif(F.col("__p_total"), F.lit(0))).alias(
            "v01"
        ),
    )


def delong_pairs(
    df: DataFrame,
    model: str = "model",
    item: str = "frame_id",
    label: str = "label",
    score: str = "prob",
    alpha: float = 0.05,
    within: Sequence[str] = (),
) -> DataFrame:
    """One row per unordered model pair: AUCs, z, two-sided p, significance flag.

    Items carry one row per model.  Placement values are looked up per distinct
    score, an item's values meet in one array, and pair moments (models x models
    per item, which is what all pairs need) are combined before their shuffle.
    Up to SENT_SCORES distinct scores go to every task, so items stay where they
    are; more are an ordinary join.
    `within` holds extra group keys, tested apart.
    """
    within = list(within)
    rows = df.select(
        *within, F.col(model).alias("model"), F.col(item).alias("item"),
        F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score"),
    ).filter("label is not null and score is not null")
    group = [*within, "model"]
    placed = cut_lineage(placement_values(rows, group, "label", "score").select(*group, "score", "v10", "v01"))
    joined = rows.join(F.broadcast(placed) if placed.count() <= SENT_SCORES else placed, [*group, "score"])
    value = F.when(F.col("label") == 1, F.col("v10")).otherwise(F.col("v01"))
    # an item has one row per model, so its array is as long as there are models
    by_item = joined.groupBy(*within, "item", "label").agg(
        F.array_sort(F.collect_list(F.struct("model", value.alias("v")))).alias("m")
    )
    # a repeated item may hold a model twice, which is no pair
    later = lambda x, i: F.filter(F.slice("m", i + 2, F.size("m")), lambda y: x["model"] < y["model"])
    pair = lambda x, y: F.struct(
        x["model"].alias("model_a"), y["model"].alias("model_b"), x["v"].alias("va"), y["v"].alias("vb")
    )
    every = F.flatten(F.transform("m", lambda x, i: F.transform(later(x, i), lambda y: pair(x, y))))
    pairs = by_item.select(*within, "label", F.explode(every).alias("p")).select(*within, "label", "p.*")
    keys = [*within, "model_a", "model_b"]
    moments = (
        pairs.groupBy(*keys, "label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("va").alias("mean_a"),
            F.avg("vb").alias("mean_b"),
            (F.var_samp("va") + F.var_samp("vb") - 2 * F.covar_samp("va", "vb")).alias("spread"),
        )
    )

    def of(y: int, c: str):
        return F.max(F.when(F.col("label") == y, F.col(c)))

    stats = moments.groupBy(*keys).agg(
        of(1, "mean_a").alias("auc_a"),
        of(1, "mean_b").alias("auc_b"),
        of(1, "n").alias("n_pos"),
        of(0, "n").alias("n_neg"),
        (of(1, "spread") / of(1, "n") + of(0, "spread") / of(0, "n")).alias("__var"),
    )
    # identical scores leave only rounding noise in the variance
    z = F.when(F.col("__var") <= 1e-18, F.lit(0.0)).otherwise(
        (F.col("auc_a") - F.col("auc_b")) / F.sqrt("__var")
    )
    out = stats.withColumn("z", z).drop("__var").withColumn("p_value", normal_p(F.col("z")))
    return out.withColumn("significant", F.col("p_value") < F.lit(float(alpha)))


# ---------------------------------------------------------------- rank tests


def complete_models(
    history: DataFrame,
    n_folds: int,
    experiment: Sequence[str] = ("experiment",),
    model: str = "model",
    fold: str = "fold",
    value: str = "value",
) -> DataFrame:
    """Keep the first n_folds values of models that have that many, in experiments with >= 2 such models."""
    experiment = list(experiment)
    order = Window.partitionBy(*experiment, model).orderBy(fold)
    numbered = history.withColumn("__f", F.row_number().over(order)).filter(F.col("__f") <= n_folds)
    full = Window.partitionBy(*experiment, model)
    kept = numbered.withColumn("__n", F.count(F.lit(1)).over(full)).filter(F.col("__n") == n_folds)
    models = kept.groupBy(*experiment).agg(F.count_distinct(model).alias("__m")).filter("__m >= 2")
    out = join_on(kept, models, experiment) if experiment else kept.filter(models.select("__m").scalar().isNotNull())
    return out.select(*experiment, model, (F.col("__f") - 1).alias("fold"), F.col(value).alias("value"))


def fold_ranks(
    scores: DataFrame, experiment: Sequence[str] = ("experiment",), model: str = "model", fold: str = "fold",
    value: str = "value",
) -> DataFrame:
    """Rank of each model within a fold, best = 1, ties share the average rank."""
    block = [*experiment, fold]
    by_value = Window.partitionBy(*block).orderBy(F.col(value).desc())
    tied = Window.partitionBy(*block, value)
    return scores.withColumns(
        {
            "tie_size": F.count(F.lit(1)).over(tied),
            "fold_rank": F.rank().over(by_value) + (F.count(F.lit(1)).over(tied) - 1) / 2.0,
        }
    )


def mean_ranks(ranks: DataFrame, experiment: Sequence[str] = ("experiment",), model: str = "model") -> DataFrame:
    return ranks.groupBy(*experiment, model).agg(F.avg("fold_rank").alias("mean_rank"))


def friedman(
    scores: DataFrame, experiment: Sequence[str] = ("experiment",), model: str = "model", fold: str = "fold",
    value: str = "value",
) -> DataFrame:
    """Tie-corrected Friedman chi-square with models as treatments and folds as blocks.

    Exchange the `model` and `fold` arguments to test folds instead.
    """
    experiment = list(experiment)
    ranks = fold_ranks(scores, experiment, model, fold, value)
    sums = ranks.groupBy(*experiment, model).agg(F.sum("fold_rank").alias("__r"))
    totals = sums.groupBy(*experiment).agg(
        F.sum(F.col("__r") * F.col("__r")).alias("__ss"), F.count(F.lit(1)).alias("n_treatments")
    )
    # a tie of t rows contributes t^3 - t; each of its rows carries t^2 - 1
    ties = ranks.groupBy(*experiment).agg(
        F.sum((F.col("tie_size") * F.col("tie_size") - 1).cast("double")).alias("__ties"),
        F.count_distinct(fold).alias("n_blocks"),
    )
    k, n = F.col("n_treatments").cast("double"), F.col("n_blocks").cast("double")
    raw = 12.0 / (n * k * (k + 1)) * F.col("__ss") - 3 * n * (k + 1)
    correction = 1 - F.col("__ties") / (n * k * (k * k - 1))
    out = join_on(totals, ties, experiment).withColumn(
        "statistic", raw / F.nullif(correction, F.lit(0.0))
    )
    return out.select(
        *experiment, "n_treatments", "n_blocks", "statistic",
        chi2_p(F.col("statistic"), F.col("n_treatments") - 1).alias("p_value"),
    )


def _pairs(left: DataFrame, keys: Sequence[str], model: str, columns: Sequence[str]) -> DataFrame:
    """All unordered model pairs of a fold-level table, equi-joined on `keys`."""
    a = left.select(*keys, F.col(model).alias("model_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = left.select(*keys, F.col(model).alias("model_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, list(keys)).filter("model_a < model_b")


def nemenyi(
    scores: DataFrame, experiment: Sequence[str] = ("experiment",), model: str = "model", fold: str = "fold",
    value: str = "value",
) -> DataFrame:
    """Post-hoc pairwise p from mean-rank differences."""
    experiment = list(experiment)
    ranks = fold_ranks(scores, experiment, model, fold, value)
    means = mean_ranks(ranks, experiment, model)
    size = ranks.groupBy(*experiment).agg(
        F.count_distinct(model).alias("__k"), F.count_distinct(fold).alias("__n")
    )
    pairs = join_on(_pairs(means, experiment, model, ["mean_rank"]), size, experiment)
    k, n = F.col("__k").cast("double"), F.col("__n").cast("double")
    diff = F.abs(F.col("mean_rank_a") - F.col("mean_rank_b"))
    q = diff / F.sqrt(k * (k + 1) / (6.0 * n))
    return pairs.select(
        *experiment, "model_a", "model_b", "mean_rank_a", "mean_rank_b", q.alias("z"),
        studentized_range_p(q * F.sqrt(F.lit(2.0)), F.col("__k")).alias("p_value"),
    )


def wilcoxon_pairs(
    scores: DataFrame, experiment: Sequence[str] = ("experiment",), model: str = "model", fold: str = "fold",
    value: str = "value", exact_up_to: int = EXACT_UP_TO,
) -> DataFrame:
    """Signed-rank test of every model pair, with Holm and Benjamini-Hochberg adjusted p.

    Zero differences are dropped; p = 1 when all differences are close to zero.  Without zeros and ties
    p is exact for up to `exact_up_to` differences, else normal.
    """
    experiment = list(experiment)
    pairs = _pairs(scores, [*experiment, fold], model, [value])
    key = [*experiment, "model_a", "model_b"]
    diffs = pairs.withColumn("d", F.col(f"{value}_a") - F.col(f"{value}_b")).withColumn(
        "close", F.abs("d") <= 1e-8 + 1e-5 * F.abs(F.col(f"{value}_b"))
    )
    whole = diffs.groupBy(*key).agg(
        F.bool_and("close").alias("all_close"),
        F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("zeros"),
    )
    mag = Window.partitionBy(*key).orderBy(F.abs("d"))
    tie = Window.partitionBy(*key, F.abs("d"))
    ranked = diffs.filter("d <> 0").withColumns(
        {
            "t": F.count(F.lit(1)).over(tie),
            "r": F.rank().over(mag) + (F.count(F.lit(1)).over(tie) - 1) / 2.0,
        }
    )
    sums = ranked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"),
    )
    out = join_on(whole, sums, key, "left").withColumns(
        {
            "n": F.coalesce("n", F.lit(0)),
            "statistic": F.least(F.coalesce("w_plus", F.lit(0.0)), F.coalesce("w_minus", F.lit(0.0))),
            "ties": F.coalesce("ties", F.lit(0.0)),
        }
    )
    p = F.when(F.col("all_close"), F.lit(1.0)).otherwise(
        signed_rank_pvalue(F.col("statistic"), F.col("n"), F.col("ties"), F.col("zeros"), exact_up_to)
    )
    tested = out.select(*key, "n", "statistic", p.alias("p_value"))
    return adjust_p(tested, experiment, ["model_a", "model_b"])


def adjust_p(tests: DataFrame, group: Sequence[str], tie: Sequence[str], p: str = "p_value") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p inside each group (rows = pairs)."""
    up = Window.partitionBy(*group).orderBy(F.col(p), *tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*group))
    ranked = tests.withColumn("__m", m).withColumn("__i", F.row_number().over(up))
    from_low = up.rowsBetween(Window.unboundedPreceding, 0)
    from_high = up.rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumns(
        {
            "p_holm": F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(from_low)),
            "p_bh": F.least(F.lit(1.0), F.min(F.col("__m") / F.col("__i") * F.col(p)).over(from_high)),
        }
    ).drop("__m", "__i")


def normal_interval(
    df: DataFrame, groups: Sequence[str], value: str = "value", z: float = 1.959963984540054
) -> DataFrame:
    """mean -/+ z * sample std / sqrt(n) of a metric vector."""
    half = F.lit(float(z)) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*groups).agg(
        F.avg(value).alias("mean"), (F.avg(value) - half).alias("lower"), (F.avg(value) + half).alias("upper")
    )
