from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import classification
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cliplab.operators import forest, ml


def rows(n: int, n_classes: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    y = rng.integers(0, n_classes, n)
    x = np.stack([rng.normal(size=n) + y, rng.integers(0, 9, n) / 4 + (y == 1), rng.random(n), np.full(n, 2.0)], axis=1)
    return x, y, np.where(y == 1, 1.5, 0.75)


def binned(x, y, weight, max_bins=32):
    cuts = [forest.thresholds(v, weight, max_bins) for v in x.T]
    classes = np.diag([float(weight[y == c][0]) for c in range(y.max() + 1)])
    codes = np.stack([np.searchsorted(c, v) * len(classes) + y for c, v in zip(cuts, x.T, strict=True)])
    n_splits = np.array([len(c) for c in cuts])
    return codes.astype(forest.code_type(n_splits, len(classes))), classes, n_splits, cuts


def grown(tree: forest.Tree) -> dict:
    """The tree of all rows, each taken once."""
    return tree.grow(np.random.default_rng(0), lambda n, rng: (np.arange(n, dtype=np.int32), np.ones(n, np.uint8)))


def nested(nodes: dict, i: int = 0):
    """A tree as nested tuples, whatever the numbers of its nodes (small nodes may have several best splits)."""
    own = (nodes["prediction"][i], nodes["raw"][i], *np.round(nodes["stats"][i], 6))
    if nodes["left"][i] < 0:
        return own
    down = (nested(nodes, nodes["left"][i]), nested(nodes, nodes["right"][i]))
    return (*own, nodes["feature"][i], round(nodes["threshold"][i], 9), round(nodes["gain"][i], 9), *down)


@pytest.mark.parametrize("n_classes, min_rows, max_bins", [(2, 5, 32), (3, 12, 32), (2, 12, 8)])
def test_a_tree_is_sparks_tree(spark, tmp_path, n_classes, min_rows, max_bins):
    x, y, weight = rows(700, n_classes)
    codes, classes, n_splits, cuts = binned(x, y, weight, max_bins)
    got = grown(forest.Tree(codes, classes, n_splits, 4, min_rows, 30))
    got |= {"right": got["left"] + 1, "threshold": np.array([cuts[f][a] if f >= 0 else 0 for f, a in zip(got["feature"], got["at"], strict=True)])}
    table = spark.createDataFrame([(Vectors.dense(v), float(c), float(w)) for v, c, w in zip(x, y, weight, strict=True)], ["features", "label", "w"])
    tree = classification.DecisionTreeClassifier(weightCol="w", maxDepth=30, minInstancesPerNode=min_rows, maxBins=max_bins)
    tree.fit(table).write().save(str(tmp_path / "tree"))
    stored = spark.read.parquet(str(tmp_path / "tree" / "data")).orderBy("id").select(
        "prediction", F.col("rawCount").alias("raw"), F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), "gain", F.col("split.featureIndex").alias("feature"),
        F.coalesce(F.get("split.leftCategoriesOrThreshold", 0), F.lit(0.0)).alias("threshold"),
    ).collect()
    want = {c: [np.array(r[c]) if c == "stats" else r[c] for r in stored] for c in stored[0].__fields__}
    assert len(stored) > 20 and nested(got) == nested(want)


def test_deep_trees_grow_in_parts(monkeypatch):
    x, y, weight = rows(3000)
    table = binned(x, y, weight)[:3]
    whole = grown(forest.Tree(*table, 4, 1, 30))
    monkeypatch.setattr(forest, "SMALL_ROWS", 200)
    monkeypatch.setattr(forest, "FRONTIER", 6)
    monkeypatch.setattr(forest, "STEP_ROWS", 100)
    parts = grown(forest.Tree(*table, 4, 1, 30))
    for nodes in (whole, parts):
        nodes |= {"right": nodes["left"] + 1, "threshold": nodes["at"].astype(float)}
    assert nested(whole) == nested(parts) and len(whole["left"]) > 300


def test_limits_of_a_tree():
    x, y, weight = rows(2000)
    nodes = grown(forest.Tree(*binned(x, y, weight)[:3], 2, 40, 4))
    assert nodes["raw"].min() >= 40 and nodes["raw"][0] == 2000
    assert len(nodes["left"]) <= 31
    only = grown(forest.Tree(*binned(x, y, weight)[:3], 2, 5, 0))
    assert only["left"].tolist() == [-1]


def test_bootstrap_is_poisson(monkeypatch):
    taken, counts = forest.bootstrap(1_000_000, np.random.default_rng(1))
    drawn = np.bincount(np.bincount(taken, counts, 1_000_000).astype(int), minlength=8) / 1e6
    assert drawn[:6] == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)], abs=0.002)
    assert taken.dtype == np.int32 and (np.diff(taken) > 0).all()


def test_summaries_keep_quantiles():
    rng = np.random.default_rng(2)
    v, w = rng.exponential(size=50_000), rng.choice([0.5, 3.0], 50_000)
    few, sums = forest.summary(v, w, 500)
    assert len(few) <= 500 and sums.sum() == pytest.approx(w.sum())
    order = np.argsort(v)
    share = np.interp(few, v[order], np.cumsum(w[order]) / w.sum())
    assert np.abs(share - np.cumsum(sums) / w.sum()).max() < 0.004
    same, sums = forest.summary(np.array([2.0, 1.0, 2.0]), np.array([1.0, 2.0, 4.0]), 5)
    assert same.tolist() == [1.0, 2.0] and sums.tolist() == [2.0, 5.0]


@pytest.fixture(scope="module")
def table(spark):
    x, y, _ = rows(3000)
    found = [(i, int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(found, "id int, label int, a double, b double, c double, d double").repartition(3).cache()


def test_a_large_forest_takes_few_jobs(spark, table):
    """Spark's fit passes over the rows again and again: more than 60 jobs here."""
    spark.sparkContext.setJobGroup("large forest", "large forest")
    model = ml.fit_forest(table, ["a", "b", "c", "d"], n_trees=300)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("large forest")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getNumTrees == 300 and max(t.depth for t in model.stages[-1].trees[:20]) > 8
    assert len(jobs) <= 40


def test_forest_equals_sparks_in_quality(spark, table, monkeypatch):
    def fitted():
        model = ml.fit_forest(table, ["a", "b", "c", "d"], n_trees=60)
        prob = ml.positive_probability(model, table, ["id", "label"])
        return model.stages[-1], {r["id"]: (r["prob"], r["label"]) for r in prob.collect()}

    own, own_prob = fitted()
    monkeypatch.setattr(forest, "TASK_BYTES", 0)  # larger tables go to Spark's fit
    sparks, sparks_prob = fitted()
    assert own.uid != sparks.uid and own.numClasses == sparks.numClasses == 2 and own.numFeatures == 4
    assert own.featureImportances.toArray() == pytest.approx(sparks.featureImportances.toArray(), abs=0.05)
    assert np.mean([abs(p - sparks_prob[i][0]) for i, (p, _) in own_prob.items()]) < 0.03
    right = [np.mean([(p >= 0.5) == y for p, y in x.values()]) for x in (own_prob, sparks_prob)]
    assert right[0] == pytest.approx(right[1], abs=0.02)
    assert own.totalNumNodes == pytest.approx(sparks.totalNumNodes, rel=0.1)
    for name in ("maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "weightCol", "seed"):
        assert own.getOrDefault(name) == sparks.getOrDefault(name)


def test_one_seed_gives_one_forest(spark, table):
    stored = table.coalesce(1).sortWithinPartitions("id").persist()
    a, b = (ml.fit_forest(stored, ["a", "b", "c"], n_trees=8).stages[-1].toDebugString.split("\n", 1)[1] for _ in range(2))
    stored.unpersist()
    assert a == b


def test_rows_are_scored_once(spark, table):
    scored = spark.sparkContext.accumulator(0)

    class Model:
        def transform(self, df):
            def probability(batches):
                for batch in batches:
                    scored.add(len(batch))
                    yield batch.assign(p=1 / (1 + np.exp(-batch["a"])))

            seen = df.select("id", "label", "a").mapInPandas(probability, "id int, label int, a double, p double")
            return seen.select("id", "label", array_to_vector(F.array(1 - F.col("p"), "p")).alias("probability"))

    found = ml.positive_probability(Model(), table, ["id", "label"])
    assert found.columns == ["id", "label", "prob"]
    point, ci = ml.evaluate(found, 0.5, 20)
    assert point.first()["auroc"] > 0.6 and ci.count() == 6 and 0 < ml.tune(found) < 1
    assert scored.value == 3000


def test_labels_of_three_classes(spark):
    x, y, _ = rows(900, 3)
    found = [(Vectors.dense(v), int(c)) for v, c in zip(x, y, strict=True)]
    data = spark.createDataFrame(found, ["features", "label"])
    model = forest.RandomForestClassifier(numTrees=20, maxDepth=6, seed=-3).fit(data)
    assert model.numClasses == 3 and model.transform(data).filter("prediction = label").count() > 600
    assert len(model.trees) == 20 and model.getMaxDepth() == 6
