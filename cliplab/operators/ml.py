"""Tabular training and scoring with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplab.functions.outcomes import label_name, outcome
from cliplab.operators.bootstrap import metrics_with_ci
from cliplab.operators.forest import RandomForestClassifier
from cliplab.operators.metrics import at_threshold, binary_metrics, tune_threshold
from cliplab.operators.splits import class_weights
from cliplab.session import keep_rows

# Forest parameters.
FOREST_TREES = 500
FOREST_MIN_LEAF = 5
MAX_DEPTH = 30  # Spark's maximum
SEED = 42
# For Spark's fit only.
FEW_ROWS = 2_000_000  # rows whose bootstrap weights (2 kB each for 500 trees) stay in memory
PASS_MB = {True: 2, False: 256}  # histograms of one pass over few rows (small enough for the processor's cache), over many

def feature_columns(groups: Mapping[str, Sequence[str]], selected: Sequence[str] | None = None) -> list[str]:
    """Columns of the chosen groups in the order of `groups`; of all groups if none are named."""
    unknown = set(selected or ()) - set(groups)
    if unknown:
        raise ValueError(f"no feature group {sorted(unknown)}; there are {list(groups)}")
    return [c for name, columns in groups.items() if not selected or name in selected for c in columns]


def with_class_weight(train: DataFrame, n_classes: int = 2, label: str = "label", name: str = "class_weight") -> DataFrame:
    weights = class_weights(train, n_classes, label).select(F.col("class_id").alias(label), F.col("weight").alias(name))
    return train.join(F.broadcast(weights), label)  # one row per class


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str = "label", n_trees: int = FOREST_TREES, max_depth: int = MAX_DEPTH
) -> PipelineModel:
    """Assembler + standard scaler + random forest with balanced class weights.

    Trees grow in the tasks, on binned rows (`forest`).  Tables too large for that go to Spark's fit, which
    grows them level by level, in passes over the data.  Spark's models have no more than MAX_DEPTH levels.
    The rows are kept while the stages read them.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="class_weight", numTrees=n_trees, maxDepth=max_depth,
        minInstancesPerNode=FOREST_MIN_LEAF, featureSubsetStrategy="sqrt", seed=SEED,
    )
    rows = train.select(*features, label).persist()
    try:
        forest.setMaxMemoryInMB(PASS_MB[rows.count() <= FEW_ROWS])
        return Pipeline(stages=[assembler, scaler, forest]).fit(with_class_weight(rows, 2, label))
    finally:
        rows.unpersist()


def fit_linear_head(
    train: DataFrame, vector: str = "embedding", label: str = "label", n_classes: int = 2, max_iter: int = 50
) -> PipelineModel:
    """Logistic regression on frozen embeddings, with balanced class weights."""
    typed = train.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    head = LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="class_weight", maxIter=max_iter,
        family="binomial" if n_classes == 2 else "multinomial",
    )
    return Pipeline(stages=[head]).fit(with_class_weight(typed, n_classes, label))


def embedding_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def positive_probability(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`keep` and prob, kept as Parquet: a forest is dear, and plans that read prob often would score each row as often."""
    scored = model.transform(df)
    return keep_rows(scored.select(*keep, vector_to_array("probability")[1].alias("prob")))


def tune(scored: DataFrame, metric: str = "f1", n_steps: int = 50) -> float:
    """Decision threshold from a scored validation table (one row reaches the driver)."""
    row = tune_threshold(scored, [], metric=metric, n_steps=n_steps).first()
    return 0.5 if row is None else float(row["threshold"])


def with_predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """pred_label, pred_prob (4 digits), pred_name and, with a label, correct and outcome."""
    out = at_threshold(scored, threshold, "prob", "pred_label").withColumns(
        {"pred_prob": F.round("prob", 4), "pred_name": label_name(F.col("pred_label"))}
    )
    if "label" in scored.columns:
        out = out.withColumns(
            {
                "correct": (F.col("pred_label") == F.col("label")).cast("int"),
                "outcome": outcome(F.col("label"), F.col("pred_label")),
            }
        )
    return out


def feature_importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance), one row per feature."""
    spark = SparkSession.getActiveSession()
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def evaluate(scored: DataFrame, threshold: float, n_replicates: int = 2000, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(point metrics, bootstrap intervals) of a scored test table."""
    decided = at_threshold(scored, threshold)
    return binary_metrics(decided), metrics_with_ci(decided, [], n_replicates, seed)


def save_model(model: PipelineModel, path: str, threshold: float, features: Sequence[str]) -> None:
    """Pipeline plus a one-row sidecar with threshold and feature names."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    note = json.dumps({"threshold": threshold, "features": list(features)})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load_model(path: str) -> tuple[PipelineModel, float, list[str]]:
    note = json.loads(SparkSession.getActiveSession().read.text(f"{path}/sidecar").first()["value"])
    return PipelineModel.load(f"{path}/pipeline"), float(note["threshold"]), list(note["features"])


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], column: str = "prob") -> DataFrame:
    """Score Arrow batches with a caller's function (pandas in, probabilities out)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{column: scorer(frame)})

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{column}` double"])
    return df.mapInPandas(batches, schema)


def keep_above(scored: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """Rows a tuned filter keeps."""
    return scored.filter(F.col(prob) >= F.lit(float(threshold)))
