from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cliplab.operators import bootstrap, curves, metrics


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "label int, prob double")
    return y, p, df


def test_auroc_with_ties(scored):
    y, p, df = scored
    assert curves.auroc(df).first()["auroc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert curves.auroc(df.repartition(9)).first()["auroc"] == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_auroc_edges(spark):
    df = spark.createDataFrame(
        [("perfect", 1, 0.9), ("perfect", 0, 0.1), ("worst", 1, 0.1), ("worst", 0, 0.9), ("tie", 1, 0.5), ("tie", 0, 0.5), ("one", 1, 0.5), (None, 1, 7.0), (None, 0, -3.0)],
        "g string, label int, prob double",
    )
    got = {r["g"]: r["auroc"] for r in curves.auroc(df, ["g"]).collect()}
    assert got == {"perfect": 1.0, "worst": 0.0, "tie": 0.5, "one": None, None: 1.0}


def test_binary_metrics_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.3), (0, 0, 0.1)], "label int, pred int, prob double")
    row = metrics.binary_metrics(df).first()
    assert (row["precision"], row["sensitivity"], row["f1"], row["specificity"]) == (0.0, 0.0, 0.0, 1.0)
    only_pos = metrics.binary_metrics(df.filter("label = 1")).first()
    assert only_pos["specificity"] == 0.0 and only_pos["auroc"] is None
    assert metrics.binary_metrics(df.filter("label = 2")).first()["accuracy"] is None


def test_sweep_matches_direct_counting(scored):
    y, p, df = scored
    rows = metrics.sweep_thresholds(df).orderBy("threshold").collect()
    grid = np.linspace(0.1, 0.9, 81)
    assert len(rows) == 81
    for r, t in zip(rows, grid, strict=True):
        pred = p >= t
        assert r["threshold"] == pytest.approx(t, abs=1e-6)
        assert (r["tp"], r["fp"]) == (int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()))


def test_grid_points_themselves_count_as_reached(spark):
    grid = np.linspace(0.1, 0.9, 81)
    df = spark.createDataFrame([(1, float(t)) for t in grid], "label int, prob double")
    rows = metrics.sweep_thresholds(df, with_auroc=False).orderBy("threshold").collect()
    assert [r["tp"] for r in rows] == list(range(81, 0, -1))


def test_best_threshold_takes_the_first_maximum(spark):
    sweep = spark.createDataFrame([(0.3, 0.6, 0.5), (0.4, 0.75, 0.7), (0.5, 0.75, 0.9)], "threshold double, f1 double, accuracy double")
    assert metrics.best_threshold(sweep).first()["threshold"] == 0.4
    assert metrics.best_threshold(sweep, metric="accuracy").first()["threshold"] == 0.5
    with pytest.raises(KeyError):
        metrics.best_threshold(sweep, metric="auc")


def test_macro_and_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")
    rep = {r["class_id"]: r for r in metrics.class_report(df, [0, 1, 2, 3]).collect()}
    assert rep[0]["precision"] == 1.0 and rep[0]["recall"] == 0.5
    assert rep[1]["precision"] == pytest.approx(1 / 3) and rep[2]["f1"] == 0.0 and rep[3]["support"] == 0
    macro = metrics.macro_metrics(metrics.class_report(df, [0, 1, 2, 3])).first()
    assert macro["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    cells = {(r["label"], r["pred"]): (r["n"], r["row_share"]) for r in metrics.confusion_matrix(df, [0, 1, 2]).collect()}
    assert cells[(0, 1)] == (1, 0.5) and cells[(2, 0)] == (0, 0.0) and len(cells) == 9


def test_multiclass_auroc_partial_and_degenerate(spark):
    rows = [("all", 0, [0.7, 0.2, 0.1]), ("all", 1, [0.1, 0.8, 0.1]), ("all", 2, [0.1, 0.2, 0.7]), ("two", 0, [0.6, 0.3, 0.1]), ("two", 2, [0.1, 0.0, 0.9]), ("one", 1, [0.2, 0.5, 0.3])]
    df = spark.createDataFrame(rows, "g string, label int, probs array<double>")
    got = {r["g"]: r["auroc"] for r in curves.auroc_multiclass(df, ["g"]).collect()}
    assert got == {"all": 1.0, "two": 1.0, "one": None}


def test_roc_runs_to_the_corner(scored):
    _, _, df = scored
    last = curves.roc_points(df).orderBy("threshold").first()
    assert (last["tpr"], last["fpr"]) == (1.0, 1.0)


def test_bootstrap_matches_index_resampling(scored):
    """Distribution of the cell draws against drawing row numbers, as a plain bootstrap does."""
    y, p, df = scored
    decided = metrics.at_threshold(df, 0.5)
    pred = (p >= 0.5).astype(int)
    rng = np.random.default_rng(0)
    plain = {"accuracy": [], "auroc": [], "f1": []}
    for _ in range(1500):
        i = rng.integers(0, len(y), len(y))
        tp = ((y[i] == 1) & (pred[i] == 1)).sum()
        plain["accuracy"].append((y[i] == pred[i]).mean())
        plain["auroc"].append(brute_auc(y[i], p[i]))
        plain["f1"].append(2 * tp / (pred[i].sum() + y[i].sum()))
    rows = bootstrap.replicate_metrics(decided, [], 1500, seed=9).toPandas()
    assert len(rows) == 1500
    for name, values in plain.items():
        assert rows[name].mean() == pytest.approx(np.mean(values), abs=0.004)
        assert rows[name].std() == pytest.approx(np.std(values), rel=0.1)
        for q in (2.5, 97.5):
            assert np.percentile(rows[name], q) == pytest.approx(np.percentile(values, q), abs=0.012)


def test_bootstrap_draws_are_whole_and_seeded(scored):
    y, _, df = scored
    decided = metrics.at_threshold(df, 0.5)
    a = bootstrap.replicate_metrics(decided, [], 60, seed=1).orderBy("replicate").collect()
    b = bootstrap.replicate_metrics(decided.repartition(7), [], 60, seed=1).orderBy("replicate").collect()
    c = bootstrap.replicate_metrics(decided, [], 60, seed=2).orderBy("replicate").collect()
    assert a == b and a != c
    # accuracy is a whole number of rows out of n in every replicate
    for r in a:
        assert r["accuracy"] * len(y) == pytest.approx(round(r["accuracy"] * len(y)), abs=1e-6)


def test_bootstrap_cells_cut_across_blocks(spark):
    """Few distinct scores with many rows and many distinct scores take different draw paths."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    p = rng.random(3000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "label int, prob double")
    for d in (df, df.withColumn("prob", F.round("prob", 1))):
        rows = bootstrap.replicate_metrics(metrics.at_threshold(d, 0.5), [], 100).toPandas()
        point = curves.auroc(d).first()["auroc"]
        assert rows["auroc"].mean() == pytest.approx(point, abs=0.006)
        assert rows["auroc"].std() == pytest.approx(np.sqrt(3001 / 12) / 1500, rel=0.25)


def test_one_class_keeps_the_point_value(spark):
    rows = [("one", 1, 1, 0.5)] * 4 + [("one", 1, 0, 0.4)] + [("two", i % 2, i % 2, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, label int, pred int, prob double")
    got = {(r["model"], r["metric"]): r for r in bootstrap.metrics_with_ci(df, ["model"], 20).collect()}
    assert got["one", "sensitivity"]["mean"] == 0.8 and got["one", "accuracy"]["mean"] == 0.8
    assert all(r["lower"] is None and r["n_replicates"] == 0 for (m, _), r in got.items() if m == "one")
    assert ("one", "auroc") not in got and got["two", "auroc"]["lower"] == 1.0


def test_bootstrap_seed_fixes_the_result(spark):
    """Whatever the partitions, Arrow batches and order of the rows; more rows than one block holds."""
    rng = np.random.default_rng(4)
    df = spark.range(40_000).select(
        (F.col("id") % 3 == 0).cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("h")
    ).withColumn("prob", F.col("h") / F.lit(1e6) / (2 - F.col("label")))
    decided = metrics.at_threshold(df, 0.5)
    seen = []
    for shuffles, batch, order in ((3, 10_000, "h"), (11, 37, "prob"), (5, 1000, "label")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        rows = bootstrap.replicate_metrics(decided.repartition(int(rng.integers(2, 9))).sortWithinPartitions(order), [], 60, seed=3)
        seen.append([tuple(round(x, 12) for x in r) for r in rows.orderBy("replicate").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 60


@pytest.mark.parametrize("scale", [1 / 64, 1.0, 40.0])
def test_score_buckets_keep_the_order(spark, scale):
    rng = np.random.default_rng(2)
    scores = sorted([*((rng.random(300) - (scale > 1) / 2) * scale).tolist(), 0.0, 1.0, 0.5, 1e-300, 1 - 1e-16, -1e300, float("inf"), float("-inf")])
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", curves.score_bucket(F.col("s")).alias("b"))
    got = [r["b"] for r in df.orderBy("s").collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_perfect_scores_give_tight_interval(spark):
    df = spark.createDataFrame([("m", i % 2, i % 2, float(i % 2)) for i in range(60)], "model string, label int, pred int, prob double")
    rows = {r["metric"]: r for r in bootstrap.metrics_with_ci(df, ["model"], 50).collect()}
    assert len(rows) == 6
    assert all(r["mean"] == r["lower"] == r["upper"] == 1.0 for r in rows.values())


def test_bootstrap_counts_come_in_slices_of_bounded_size(monkeypatch):
    n = np.array([1, 3, 2, 1])
    whole = bootstrap._block_draws(np.random.default_rng(5), np.full(100, 14), 14, n)
    monkeypatch.setattr(bootstrap, "HELD_COUNTS", 40)
    sliced = bootstrap._block_draws(np.random.default_rng(5), np.full(100, 14), 14, n)
    (_, one), parts = next(iter(whole[1])), list(sliced[1])
    assert max(drawn.size for _, drawn in parts) <= 40 and len(parts) == 10
    assert (np.concatenate([drawn for _, drawn in parts]) == one).all() and (whole[0] == sliced[0]).all()


@pytest.mark.parametrize("cells", [1, 2, 3, 64])
def test_bootstrap_pairs_of_cells_equal_all_pairs(monkeypatch, cells):
    """Concordant pairs by matrix products, with scores cut by their borders, against every pair."""
    monkeypatch.setattr(bootstrap, "PAIR_CELLS", cells)
    kept = []
    draws = bootstrap._block_draws

    def seen(*args):
        inside, slices = draws(*args)
        slices = list(slices)
        kept.append(np.concatenate([drawn for _, drawn in slices]))
        return inside, iter(slices)

    monkeypatch.setattr(bootstrap, "_block_draws", seen)
    rng = np.random.default_rng(2)
    body = pd.DataFrame({"score": rng.integers(0, 6, 40) / 6, "label": rng.integers(0, 2, 40), "pred": rng.integers(0, 2, 40)})
    body = body.drop_duplicates().sort_values(["score", "label", "pred"]).assign(n=2, draws=None)
    head = pd.DataFrame({"score": [0.0], "label": [0], "pred": [0], "n": [2 * len(body)], "draws": [[30] * 20]})
    batch = pd.concat([head, body], ignore_index=True).assign(g="g", score_bucket=0)
    got = pd.concat(bootstrap._cell_draws(1)(iter([batch])))
    score, label, drawn = body["score"].to_numpy(), body["label"].to_numpy() == 1, np.concatenate(kept, axis=1)
    wins = ((score[:, None] < score) + (score[:, None] == score) / 2) * (~label[:, None] & label)
    assert got["concordant"].tolist() == ((drawn @ wins) * drawn).sum(axis=1).tolist()
    assert got["pos"].tolist() == drawn[:, label].sum(axis=1).tolist()
