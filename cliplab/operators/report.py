"""Run tables, cross-validation summaries and held-out reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplab.functions import parse
from cliplab.operators.bootstrap import metrics_with_ci
from cliplab.operators.clips import all_methods, clip_decisions, score_kind, steady
from cliplab.operators.metrics import at_threshold, binary_metrics
from cliplab.operators.ranking import attach_by_group, join_on, modal_value
from cliplab.operators.resample import METRICS, confusion_replicates, decision_metrics, metric_intervals
from cliplab.session import cut_lineage

CLIP_METRICS = ("auroc", "accuracy", "f1", "precision", "sensitivity", "specificity")


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value) without null values."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, "__p.*").filter("value is not null")


def cv_summary(fold_metrics: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample std (0 for one fold), min and max per metric over folds."""
    return unpivot(fold_metrics, keys, metrics).groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def heldout_clip_scores(
    predictions: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("model", "fold"), clip: str = "clip_key"
) -> DataFrame:
    """Mean probability per clip joined to the clip's modal label; clips without label are dropped."""
    scores = predictions.groupBy(*keys, clip).agg(steady(F.avg("prob")).alias("prob"))
    return scores.join(modal_value(manifest, [clip], "label", "label"), clip)


def heldout_clip_metrics(
    predictions: DataFrame, manifest: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("model", "fold"),
    default_threshold: float = 0.5,
) -> DataFrame:
    """Clip metrics per (model, fold) at the fold's own threshold; undefined values are null."""
    keys = list(keys)
    scores = heldout_clip_scores(predictions, manifest, keys)
    clips = attach_by_group(scores, thresholds.select(*keys, "threshold"), keys, "left")
    decided = at_threshold(clips, F.coalesce("threshold", F.lit(float(default_threshold))))
    n_clips = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return binary_metrics(decided, keys).withColumn("n_clips", n_clips).select(*keys, *CLIP_METRICS, "n_clips")


def best_fold(fold_metrics: DataFrame, model: str = "model", fold: str = "fold", metric: str = "auroc") -> DataFrame:
    """Per model the row of the fold with the highest metric; missing counts lowest, the first fold wins ties."""
    rest = [c for c in fold_metrics.columns if c != model]
    key = F.struct(F.coalesce(F.col(metric), F.lit(-1.0)), -F.col(fold))
    return fold_metrics.groupBy(model).agg(F.max_by(F.struct(*rest), key).alias("b")).select(model, "b.*")


def best_fold_clip_ci(
    predictions: DataFrame, manifest: DataFrame, folds: DataFrame, n_replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Bootstrap intervals of clip metrics of each model's best fold.

    `folds` holds (model, fold, auroc, threshold).
    """
    chosen = best_fold(folds).select("model", "fold", "threshold")
    rows = attach_by_group(predictions, chosen, ["model", "fold"])
    clips = heldout_clip_scores(rows, manifest, ["model", "threshold"])
    decided = at_threshold(clips, F.coalesce("threshold", F.lit(0.5)))
    return metrics_with_ci(decided, ["model"], n_replicates, seed)


def compare_methods(
    df: DataFrame,
    keys: Sequence[str],
    methods: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    label: str = "label",
    prob: str = "prob",
    pred: str = "pred",
    n_replicates: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Clip rules ranked by F1: rank, method, f1, f1_lower, f1_upper, auroc, auroc_lower, auroc_upper, sensitivity,
    specificity, precision, recall, tp, fp, fn, tn, n_clips.

    Clips are drawn once for all rules, over their joint decisions; AUROC once for each distinct score.  Equal F1 are
    ranked by name.
    """
    methods = list(methods) if methods is not None else all_methods()
    clips = cut_lineage(clip_decisions(df, keys, methods, order, label, prob, pred))
    rules = {m: F.col("rules")[i]["pred"] for i, m in enumerate(methods)}
    f1 = {"f1": METRICS["f1"]}
    cells = {n: lambda m, i=i, j=j: m.at(i, j) for n, (i, j) in {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}.items()}
    bounds = metric_intervals(confusion_replicates(clips, rules, (), 2, n_replicates, seed, "label"), (), 2, f1)
    points = decision_metrics(clips, rules, metrics=METRICS | cells)
    point = points.groupBy("rule").pivot("metric", [*METRICS, *cells]).agg(F.first("point"))
    scores = clips.select("label", F.explode("scores").alias("s")).select("s.kind", "label", F.col("s.score").alias("prob"), F.lit(0).alias("pred"))
    curve = metrics_with_ci(scores, ["kind"], n_replicates, seed).filter("metric = 'auroc'")
    exact = binary_metrics(scores, ["kind"]).select("kind", "auroc")
    kind = F.create_map(*[F.lit(x) for m in methods for x in (m, score_kind(m))])[F.col("method")]
    table = point.withColumnRenamed("rule", "method").withColumn("kind", kind)
    table = join_on(table, bounds.select(F.col("rule").alias("method"), F.col("lower").alias("f1_lower"), F.col("upper").alias("f1_upper")), ["method"], "left")
    table = join_on(table, exact, ["kind"], "left")
    table = join_on(table, curve.select("kind", F.col("lower").alias("auroc_lower"), F.col("upper").alias("auroc_upper")), ["kind"], "left")
    n_clips = clips.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.row_number().over(Window.orderBy(F.round("f1", 9).desc(), "method"))  # one row per rule
    return table.select(
        place.alias("rank"), "method", "f1", "f1_lower", "f1_upper", "auroc", "auroc_lower", "auroc_upper", "sensitivity", "specificity",
        "precision", F.col("sensitivity").alias("recall"), *[F.col(c).cast("long").alias(c) for c in cells], n_clips.alias("n_clips"),
    )


def top_level(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("parent_id").isNull())


def best_run(run_metrics: DataFrame, metric: str, higher_is_better: bool = True, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Best positive value of a metric per experiment; the lowest run id wins ties."""
    rows = run_metrics.filter((F.col("metric") == metric) & (F.col("value") > 0))
    value = F.col("value") if higher_is_better else -F.col("value")
    # lowest of (-value, id) = best value, then lowest id
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct("run_id", "value"), F.struct(-value, "run_id")).alias("b")
    ).select(*keys, "b.*")


def compare_runs(runs: DataFrame, run_metrics: DataFrame, metrics: Sequence[str], n_runs: int = 10) -> DataFrame:
    """Top n top-level runs by the first metric, one column per metric."""
    wide = run_metrics.groupBy("run_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )
    joined = top_level(runs).join(wide, "run_id", "left")
    return joined.orderBy(F.col(metrics[0]).desc_nulls_last(), "run_id").limit(n_runs)


def performance_report(
    runs: DataFrame, run_metrics: DataFrame, intervals: DataFrame, started_after, metrics: Sequence[str]
) -> DataFrame:
    """Metrics of top-level runs started at or after a time, beside half the width of their intervals."""
    recent = top_level(runs).filter(F.col("start_time") >= F.lit(started_after))
    wide = run_metrics.groupBy("run_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )
    half = (F.col("upper") - F.col("lower")) / 2
    widths = intervals.groupBy("run_id").agg(
        *[F.max(F.when(F.col("metric") == m, half)).alias(f"{m}_half_width") for m in metrics]
    )
    name = F.regexp_replace("run_name", "(_split|_cv)$", "")
    return (
        recent.withColumn("display_name", name)
        .join(wide, "run_id", "left")
        .join(widths, "run_id", "left")
    )


def named_models(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn("display_name", parse.model_display_name(F.col("model"), overrides))
