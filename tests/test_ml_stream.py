from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.operators import ml
from cliplab.plans import tabular
from cliplab.streaming import ingest, routing


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        y = int(i % 3 == 0)
        x = rng.normal(size=3) + y * np.array([1.5, 0.0, -1.0])
        rows.append((f"f{i}", y, *[float(v) for v in x], [float(v) for v in x]))
    return spark.createDataFrame(rows, "frame_id string, label int, a double, b double, c double, embedding array<double>")


def test_forest_round_trip(spark, table, tmp_path):
    model = ml.fit_forest(table, ["a", "b", "c"], n_trees=15, max_depth=5)
    scored = ml.positive_probability(model, table, ["frame_id", "label"])
    assert scored.filter("prob < 0 or prob > 1").count() == 0
    threshold = ml.tune(scored)
    assert 0.05 <= threshold <= 0.95
    named = ml.with_predictions(scored, threshold)
    assert named.filter("(outcome in ('TP', 'TN')) <> (correct = 1)").count() == 0
    assert named.agg(F.avg("correct")).first()[0] > 0.8
    top = ml.feature_importances(model, ["a", "b", "c"]).collect()
    assert {r["feature"] for r in top} == {"a", "b", "c"} and sum(r["importance"] for r in top) == pytest.approx(1.0)
    ml.save_model(model, str(tmp_path / "m"), threshold, ["a", "b", "c"])
    again, t, names = ml.load_model(str(tmp_path / "m"))
    assert (t, names) == (threshold, ["a", "b", "c"])
    other = ml.positive_probability(again, table, ["frame_id"]).withColumnRenamed("prob", "p2")
    assert scored.join(other, "frame_id").filter("prob <> p2").count() == 0
    point, ci = ml.evaluate(scored, threshold, 40)
    assert point.first()["auroc"] > 0.8 and ci.count() == 6


def test_forest_queries_fit_the_whole_forest(spark, monkeypatch):
    fitted = {}

    def classifier(**parameters):
        fitted.update(parameters)
        raise InterruptedError

    monkeypatch.setattr(ml, "RandomForestClassifier", classifier)
    rows = spark.createDataFrame([("train", 1)], "split string, label int")
    monkeypatch.setattr(tabular, "_forest_input", lambda v: rows)
    with pytest.raises(InterruptedError):
        tabular._fit(None)
    assert (fitted["numTrees"], fitted["maxDepth"]) == (ml.FOREST_TREES, ml.MAX_DEPTH) == (500, 30)


@pytest.mark.parametrize("limit, passes", [(300, 2), (299, 256)])
def test_forest_passes_fit_the_cache_on_few_rows(table, monkeypatch, limit, passes):
    seen = []
    monkeypatch.setattr(ml, "FEW_ROWS", limit)
    monkeypatch.setattr(ml.Pipeline, "fit", lambda pipeline, rows: seen.append((pipeline.getStages()[-1].getMaxMemoryInMB(), rows.count())))
    ml.fit_forest(table, ["a", "b", "c"], n_trees=2)
    assert seen == [(passes, 300)]


def test_linear_head(table):
    model = ml.fit_linear_head(table)
    scored = model.transform(ml.embedding_features(table))
    assert scored.filter(F.col("prediction") == F.col("label")).count() > 230


def test_feature_groups():
    groups = {"light": ["a", "b"], "edge": ["c"], "blur": ["d", "e"]}
    assert ml.feature_columns(groups) == ["a", "b", "c", "d", "e"]
    assert ml.feature_columns(groups, ["blur", "light"]) == ["a", "b", "d", "e"]
    with pytest.raises(ValueError):
        ml.feature_columns(groups, ["colour"])


def test_user_scorer(table):
    out = ml.score_with(table, lambda f: 1 / (1 + np.exp(-f["a"])))
    assert out.columns[-1] == "prob" and out.count() == 300
    assert ml.keep_above(out, 0.5).filter("a < 0").count() == 0


def test_route_stream_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(f"i{k}", k / 10) for k in range(11)]
    spark.createDataFrame(rows, "item string, prob double").repartition(3).write.parquet(src)
    stream = ingest.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    out = str(tmp_path / "out")
    routing.route_stream(stream, out, str(tmp_path / "ck"), 0.5, 0.15).awaitTermination()
    counts = {r["category"]: r["n"] for r in routing.running_counts(spark, out).collect()}
    assert counts == {"uncertain": 3, "informative": 4, "non_informative": 4}
    # new files only: the checkpoint remembers what was routed
    spark.createDataFrame([("late", 0.99)], "item string, prob double").write.mode("append").parquet(src)
    routing.route_stream(ingest.file_stream(spark, src, stream.schema), out, str(tmp_path / "ck"), 0.5, 0.15).awaitTermination()
    assert {r["category"]: r["n"] for r in routing.running_counts(spark, out).collect()}["informative"] == 5


def test_ingest_takes_each_item_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df = spark.sql("select concat('i', id % 5) as item, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts from range(20)")
    df.write.parquet(src)
    schema = spark.read.parquet(src).schema
    late = spark.sql("select concat('i', id) as item, timestamp_ntz'2020-01-01 00:00:00' as ts from range(9) union all select null, null")
    for _ in range(3):
        stream = ingest.file_stream(spark, src, schema, files_per_batch=1)
        ingest.ingest_once(stream, out, ck, "item", "ts").awaitTermination()
        df.limit(7).write.mode("append").parquet(src)
        late.repartition(3).write.mode("append").parquet(src)
    got = spark.read.parquet(out)
    assert got.count() == 10 and got.select("item").distinct().count() == 10
