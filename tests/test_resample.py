"""Bootstrap of decisions against drawing row numbers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.operators import report, resample


def rows_of(n, classes, seed):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, classes, n)
    first = np.where(rng.random(n) < 0.7, label, rng.integers(0, classes, n))
    second = np.where(rng.random(n) < 0.5, first, rng.integers(0, classes, n))
    return label, first, second


def macro_f1(label, pred, classes):
    out = []
    for c in range(classes):
        hits, seen = ((label == c) & (pred == c)).sum(), (label == c).sum() + (pred == c).sum()
        if seen:
            out.append(2 * hits / seen)
    return np.mean(out)


@pytest.mark.parametrize("classes", [2, 4])
def test_intervals_match_index_resampling(spark, monkeypatch, classes):
    """Also with many small ranges, slices and blocks."""
    monkeypatch.setattr(resample, "RANGE_PATTERNS", 5)
    monkeypatch.setattr(resample, "SLICE", 300)
    monkeypatch.setattr(resample, "BLOCK_COUNTS", 900)
    label, first, second = rows_of(240, classes, classes)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(label, first, second)], "label int, a int, b int").repartition(3)
    rules = {"a": F.col("a"), "b": F.col("b")}
    both = {"both_right": lambda m: m.hits() / m.total(), **resample.METRICS}
    got = {(r.rule, r.metric): r for r in resample.decision_intervals(df, rules, classes=classes, n_replicates=3000, metrics=both).collect()}
    rng = np.random.default_rng(0)
    for name, pred in (("a", first), ("b", second)):
        draws = [rng.integers(0, 240, 240) for _ in range(3000)]
        if classes == 2:
            tp = [((label[i] == 1) & (pred[i] == 1)).sum() for i in draws]
            f1 = np.array([2 * t / ((label[i] == 1).sum() + (pred[i] == 1).sum()) for t, i in zip(tp, draws)])
        else:
            f1 = np.array([macro_f1(label[i], pred[i], classes) for i in draws])
        r = got[name, "f1"]
        sd = f1.std()
        assert r.mean == pytest.approx(f1.mean(), abs=0.15 * sd)
        assert r.lower == pytest.approx(np.percentile(f1, 2.5), abs=0.25 * sd) and r.upper == pytest.approx(np.percentile(f1, 97.5), abs=0.25 * sd)
        assert got[name, "both_right"].point == pytest.approx((label == pred).mean())
        assert (name, "specificity") in got if classes == 2 else (name, "specificity") not in got


def test_rules_share_their_draws(spark):
    """Matrices of one replicate agree in labels and sizes; equal rules get equal matrices; whole counts only."""
    label, first, _ = rows_of(150, 3, 7)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(label, first)], "label int, a int")
    rules = {"a": F.col("a"), "again": F.col("a"), "zero": F.lit(0)}
    one = resample.confusion_replicates(df, rules, classes=3, n_replicates=40, seed=5).collect()
    two = resample.confusion_replicates(df.repartition(7), rules, classes=3, n_replicates=40, seed=5).collect()
    other = resample.confusion_replicates(df, rules, classes=3, n_replicates=40, seed=6).collect()
    table = {(r.rule, r.replicate): r.cells for r in one}
    assert table == {(r.rule, r.replicate): r.cells for r in two} != {(r.rule, r.replicate): r.cells for r in other}
    for i in range(40):
        matrix = np.array(table["a", i]).reshape(3, 3)
        assert matrix.sum() == 150 and table["a", i] == table["again", i]
        assert (matrix.sum(axis=1) == np.array(table["zero", i]).reshape(3, 3)[:, 0]).all()


def test_groups_nulls_and_one_class(spark):
    rows = [("x", 0, 0), ("x", 1, 1), ("x", 1, 0), ("x", None, 1), ("x", 1, None), ("x", 5, 1), ("only", 1, 1), ("only", 1, 0), (None, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, label int, p int")
    got = {(r.g, r.metric): r for r in resample.decision_intervals(df, {"p": F.col("p")}, ["g"], n_replicates=200).collect()}
    assert got["x", "accuracy"].point == pytest.approx(2 / 3) and got["x", "accuracy"].n_replicates > 100
    assert (got["only", "accuracy"].point, got["only", "accuracy"].lower, got["only", "accuracy"].n_replicates) == (0.5, None, 0)
    assert got[None, "accuracy"].point == 0.5 and got[None, "accuracy"].n_replicates > 50
    empty = resample.decision_intervals(df.filter("g = 'none'"), {"p": F.col("p")}, n_replicates=10)
    assert empty.filter("point IS NOT NULL AND n_replicates > 0").count() == 0


def test_methods_are_ranked_with_bounds(spark, clip_rows):
    clips = [r for i in range(20) for r in [(f"k{i}", 0, 0.1 + 0.04 * i, int(i > 9)), (f"k{i}", 1, 0.05 + 0.045 * i, int(i > 9))]]
    frames = spark.createDataFrame(clips, "clip string, frame int, prob double, label int").withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    table = report.compare_methods(frames, ["clip"], order=["frame"], n_replicates=300).orderBy("rank").collect()
    assert [r["rank"] for r in table] == list(range(1, 23)) and len({r.method for r in table}) == 22
    assert all(a.f1 >= b.f1 for a, b in zip(table, table[1:])) and all(r.n_clips == 20 == r.tp + r.fp + r.fn + r.tn for r in table)
    assert all(r.f1_lower <= r.f1 <= r.f1_upper for r in table) and {r.auroc for r in table if r.method.startswith("mean_prob")} == {1.0}
