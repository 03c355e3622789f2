"""Queries for tabular training and scoring (I, U4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.operators import ml
from cliplab.operators.metrics import at_threshold, binary_metrics, tune_threshold
from cliplab.plans.evaluation import metrics_sql
from cliplab.plans.manifests import scratch
from cliplab.plans.quality_queries import _rounded
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql

FEATURES = ["score_a", "score_b", "frame_number", "segment_number"]


def _forest_input(v: Views) -> DataFrame:
    # the label shifts score_c, so the forest has something to learn
    return v.frames().select("frame_id", "clip_key", "label", "split", "score_c", *FEATURES)


def _columns() -> list[str]:
    return ["score_c", *FEATURES]


def _fit(v: Views):
    rows = _forest_input(v)
    model = ml.fit_forest(rows.filter(F.col("split") == "train"), _columns())
    return model, rows


def _scored(v: Views, split: str) -> tuple:
    model, rows = _fit(v)
    return model, ml.positive_probability(model, rows.filter(F.col("split") == split), ["frame_id", "label"])


@query("i01_forest_predictions")
def i01(v: Views) -> DataFrame:
    """Scaler and balanced forest fitted on train, test rows scored (random forest: rows only)."""
    return ml.with_predictions(_scored(v, "test")[1], 0.5)


@query("i02_tuned_threshold")
def i02(v: Views) -> DataFrame:
    return tune_threshold(_scored(v, "val")[1], [])


@query(
    "i03_prediction_columns",
    sql("frames", """SELECT frame_id, label, pred AS pred_label, round(score_a, 4) AS pred_prob, CASE WHEN pred = 1 THEN 'Informative' ELSE 'Non-Informative' END AS pred_name,
          (pred = label)::INTEGER AS correct, CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 0 AND pred = 1 THEN 'FP' WHEN label = 0 AND pred = 0 THEN 'TN' ELSE 'FN' END AS outcome
        FROM (SELECT frame_id, label, score_a, (score_a >= 0.45)::INTEGER AS pred FROM frames)"""),
)
def i03(v: Views) -> DataFrame:
    """The columns that a prediction adds to a scored table."""
    scored = v.frames().select("frame_id", "label", F.col("score_a").alias("prob"))
    return ml.with_predictions(scored, 0.45).drop("prob")


@query("i04_feature_importances")
def i04(v: Views) -> DataFrame:
    return ml.feature_importances(_fit(v)[0], _columns())


@query("i05_forest_evaluation")
def i05(v: Views) -> DataFrame:
    """Point metrics beside bootstrap intervals of the test rows."""
    _, scored = _scored(v, "test")
    point, ci = ml.evaluate(scored, 0.5)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in ("accuracy", "auroc", "f1", "sensitivity", "specificity", "precision")])
    return point.select(F.explode(pairs).alias("p")).select("p.*").join(ci, "metric")


@query(
    "i06_save_and_load",
    sql("frames", "SELECT count(*) AS n, 0 AS n_changed FROM frames WHERE split = 'val'"),
)
def i06(v: Views) -> DataFrame:
    """A stored and reloaded pipeline scores every row as before."""
    model, rows = _fit(v)
    path = scratch(v, "model")
    ml.save_model(model, path, 0.5, _columns())
    again, _, names = ml.load_model(path)
    val = rows.filter(F.col("split") == "val")
    before = ml.positive_probability(model, val, ["frame_id"])
    after = ml.positive_probability(again, val.select("frame_id", *names), ["frame_id"]).withColumnRenamed("prob", "again")
    changed = F.sum(F.when(F.col("prob") == F.col("again"), 0).otherwise(1))
    return before.join(after, "frame_id").agg(F.count(F.lit(1)).alias("n"), changed.alias("n_changed"))


@query("i07_linear_head")
def i07(v: Views) -> DataFrame:
    """Multinomial head on frozen embeddings: predicted class counts per label of held-out rows."""
    rows = v.table("embeddings").select("vec_id", "embedding", "label")
    held_out = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = ml.fit_linear_head(rows.filter(~held_out), n_classes=10)
    scored = model.transform(ml.embedding_features(rows.filter(held_out)))
    return scored.groupBy("label", F.col("prediction").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _mean_score(frame: pd.DataFrame) -> pd.Series:
    return (frame["score_a"] + frame["score_b"]) / 2


@query(
    "i08_batch_scoring",
    sql("frames", metrics_sql("s", "split"), "s AS (SELECT split, label, (score_a + score_b) / 2 AS prob, ((score_a + score_b) / 2 >= 0.5)::INTEGER AS pred FROM frames)"),
)
def i08(v: Views) -> DataFrame:
    """A caller's scorer over Arrow batches, then metrics."""
    scored = ml.score_with(v.frames().select("split", "label", "score_a", "score_b"), _mean_score)
    return _rounded(binary_metrics(at_threshold(scored, 0.5), ["split"]))


@query(
    "u04_filter_function",
    sql("frames", "SELECT frame_id FROM frames WHERE (score_a + score_b) / 2 >= 0.6"),
)
def u04(v: Views) -> DataFrame:
    scored = ml.score_with(v.frames().select("frame_id", "score_a", "score_b"), _mean_score)
    return ml.keep_above(scored, 0.6).select("frame_id")


BLOCKS = {f"block_{k}": [f"v{i}" for i in range(16 * k, 16 * k + 16)] for k in range(4)}


@query(
    "i09_feature_groups",
    "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS v{i}" for i in range(64)) + " FROM embeddings",
)
def i09(v: Views) -> DataFrame:
    """Named feature groups choose and order columns of a wide feature table."""
    columns = ml.feature_columns(BLOCKS, ["block_3", "block_1", "block_0", "block_2"])
    wide = v.table("embeddings").select(
        "vec_id", *[F.get("embedding", int(c[1:])).cast("double").alias(c) for c in columns]
    )
    return _rounded(wide)
