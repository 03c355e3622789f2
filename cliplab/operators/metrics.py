"""Confusion cells, binary and macro metrics, threshold choice.

Every function is grouped: models, folds, methods and thresholds are group
columns, so one job answers for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.operators.curves import auroc, auroc_from_histogram, linspace, score_bucket, sweep_grid, threshold_cells
from cliplab.operators.ranking import join_on


def ratio(num: Column, den: Column, undefined: float | None = 0.0) -> Column:
    value = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return value if undefined is None else F.coalesce(value, F.lit(float(undefined)))


def confusion_cells(
    df: DataFrame, groups: Sequence[str] = (), label: str = "label", pred: str = "pred", weight: str | None = None
) -> DataFrame:
    """tp, fp, fn, tn per group; `weight` counts rows that were combined before."""
    n = F.lit(1) if weight is None else F.col(weight)

    def cell(y: int, p: int, name: str) -> Column:
        hit = (F.col(label) == y) & (F.col(pred) == p)
        return F.coalesce(F.sum(F.when(hit, n).otherwise(0)), F.lit(0)).alias(name)

    return df.groupBy(*groups).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))


def cell_metrics(zero_division: float | None = 0.0) -> dict[str, Column]:
    """Metric columns over tp, fp, fn, tn; a rate whose denominator is 0 becomes `zero_division`."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, None),
        "precision": ratio(tp, tp + fp, zero_division),
        "sensitivity": ratio(tp, tp + fn, zero_division),
        "specificity": ratio(tn, tn + fp, zero_division),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, zero_division),
        "balanced_accuracy": (ratio(tp, tp + fn, zero_division) + ratio(tn, tn + fp, zero_division)) / 2,
    }


def binary_metrics(
    df: DataFrame,
    groups: Sequence[str] = (),
    label: str = "label",
    pred: str = "pred",
    score: str | None = "prob",
    zero_division: float | None = 0.0,
) -> DataFrame:
    groups = list(groups)
    if score is None:
        return confusion_cells(df, groups, label, pred).withColumns(cell_metrics(zero_division))
    # one shuffle of combined (score, label, pred) counts feeds both the cells and the AUROC;
    # rows without a score weigh nothing there instead of being filtered, so that it is shared
    hist = df.groupBy(
        *groups, F.col(score).alias("score"), F.col(label).alias("label"), F.col(pred).alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = confusion_cells(hist, groups, "label", "pred", "n").withColumns(cell_metrics(zero_division))
    scored = F.col("score").isNotNull()
    weighted = hist.withColumns(
        {
            "score_bucket": score_bucket(F.col("score")),
            "pos": F.when(scored & (F.col("label") == 1), F.col("n")).otherwise(0),
            "neg": F.when(scored & (F.col("label") != 1), F.col("n")).otherwise(0),
        }
    )
    return join_on(cells, auroc_from_histogram(weighted, groups, unique_scores=False), groups, "left")


def confusion_matrix(
    df: DataFrame, classes: Sequence[int], groups: Sequence[str] = (), label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Every (label, pred) cell, zero-filled, with its share of the label's rows."""
    groups = list(groups)
    counted = df.groupBy(*groups, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_group = counted.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("label", "pred"), "n"))).alias("__n")
    )
    grid = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred")) for a in classes for b in classes])
    cells = per_group.select(*groups, "__n", F.explode(grid).alias("__c"))
    typed = dict(counted.dtypes)
    key = F.struct(F.col("__c.label").cast(typed["label"]).alias("label"), F.col("__c.pred").cast(typed["pred"]).alias("pred"))
    out = cells.select(
        *groups, F.col("__c.label").alias("label"), F.col("__c.pred").alias("pred"),
        F.coalesce(F.col("__n")[key], F.lit(0)).alias("n"),
    )
    row = Window.partitionBy(*groups, "label")
    return out.withColumn("row_share", ratio(F.col("n"), F.sum("n").over(row), 0.0))


def class_report(
    df: DataFrame, classes: Sequence[int], groups: Sequence[str] = (), label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Precision, recall, F1, support and predicted count of each class."""
    groups = list(groups)
    matrix = confusion_matrix(df, classes, groups, label, pred)
    as_label = matrix.groupBy(*groups, F.col("label").alias("class_id")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).alias("hits")
    )
    as_pred = matrix.groupBy(*groups, F.col("pred").alias("class_id")).agg(F.sum("n").alias("predicted"))
    both = join_on(as_label, as_pred, [*groups, "class_id"])
    return both.select(
        *groups,
        "class_id",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "predicted",
    )


def macro_metrics(report: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Unweighted averages over classes that occur as label or prediction; balanced accuracy over classes with support."""
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    return report.filter(seen).groupBy(*groups).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum("support").alias("support"),
    )


def sweep_thresholds(
    df: DataFrame,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "prob",
    n_thresholds: int = 80,
    with_auroc: bool = True,
) -> DataFrame:
    """Binary metrics on a uniform grid of n_thresholds + 1 points over [0.1, 0.9]."""
    groups = list(groups)
    cells = threshold_cells(df, groups, sweep_grid(n_thresholds), label, score)
    out = cells.withColumns(cell_metrics()).withColumn("threshold", F.round("threshold", 6))
    return join_on(out, auroc(df, groups, label, score), groups, "left") if with_auroc else out


BEST_BY = ("f1", "accuracy", "precision", "recall")


def best_threshold(sweep: DataFrame, groups: Sequence[str] = (), metric: str = "f1") -> DataFrame:
    """Row with the highest metric; the lowest threshold wins a tie."""
    column = "sensitivity" if metric == "recall" else metric
    if column not in sweep.columns:
        raise KeyError(f"metric {metric!r} not found; choose one of {BEST_BY}")
    keep = [c for c in sweep.columns if c not in groups]
    best = F.max_by(F.struct(*keep), F.struct(F.col(column), -F.col("threshold")))
    return sweep.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def tune_threshold(
    df: DataFrame,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "prob",
    metric: str = "f1",
    n_steps: int = 50,
) -> DataFrame:
    """First maximum of f1 / balanced_accuracy / accuracy on n_steps points of [0.05, 0.95]."""
    groups = list(groups)
    column = metric if metric in ("f1", "balanced_accuracy") else "accuracy"
    cells = threshold_cells(df, groups, linspace(0.05, 0.95, n_steps), label, score).withColumns(cell_metrics())
    best = F.max_by(F.struct("threshold", F.col(column).alias("score")), F.struct(F.col(column), -F.col("threshold")))
    return cells.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.threshold", "b.score")


def at_threshold(df: DataFrame, threshold: Column | float, score: str = "prob", name: str = "pred") -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn(name, (F.col(score) >= limit).cast("int"))


def fold_validation(
    predictions: DataFrame, groups: Sequence[str] = ("model", "fold"), threshold: float = 0.5
) -> DataFrame:
    """Per-fold metrics at a fixed threshold beside those at the fold's own tuned threshold."""
    groups = list(groups)
    fixed = at_threshold(predictions, threshold)
    base = binary_metrics(fixed, groups).select(
        *groups,
        F.col("f1").alias("val_f1"),
        F.col("precision").alias("val_precision"),
        F.col("sensitivity").alias("val_recall"),
        F.col("auroc").alias("val_auroc"),
    )
    tuned = best_threshold(sweep_thresholds(predictions, groups, with_auroc=False), groups, "f1").select(
        *groups,
        F.col("threshold").alias("optimal_threshold"),
        F.col("f1").alias("tuned_f1"),
        F.col("precision").alias("tuned_precision"),
        F.col("sensitivity").alias("tuned_recall"),
    )
    return join_on(base, tuned, groups, "left")
