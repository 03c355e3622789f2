from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.operators import clips


def moving(p):
    n = len(p)
    if n <= 1:
        return p
    w = max(1, n // 5)
    return np.convolve(p, np.ones(w) / w, mode="same")


def gaussian(p):
    n = len(p)
    if n <= 1:
        return p
    x = np.arange(n)
    k = np.exp(-0.5 * ((x - (n - 1) / 2) / max(1.0, n / 6.0)) ** 2)
    return np.convolve(p, k / k.sum(), mode="same")


@pytest.fixture(scope="module")
def long_clips(spark):
    rng = np.random.default_rng(3)
    sizes = {"one": 1, "two": 2, "five": 5, "six": 6, "eleven": 11, "forty": 40, "big": 333}
    data = {k: rng.random(n) for k, n in sizes.items()}
    rows = [(k, int(i * 3), f"f{i}", float(p)) for k, v in data.items() for i, p in enumerate(v)]
    return data, spark.createDataFrame(rows, "clip string, frame int, id string, prob double").repartition(5)


@pytest.mark.parametrize("limit", [512, 4])
@pytest.mark.parametrize(("kind", "reference"), [("moving_avg", moving), ("gaussian", gaussian)])
def test_smoothing_equals_convolution(long_clips, limit, kind, reference):
    data, df = long_clips
    out = clips.smoothed_frames(df, ["clip"], ["frame", "id"], kind, array_limit=limit, order_span=50).collect()
    got = {}
    for r in out:
        got.setdefault(r["clip"], {})[r["position"]] = r["smoothed"]
    for name, p in data.items():
        assert [got[name][i] for i in range(len(p))] == pytest.approx(list(reference(p)), abs=1e-11)


@pytest.mark.parametrize("limit", [512, 4])
def test_topk_of_smoothed(long_clips, limit):
    data, df = long_clips
    rows = {r["clip"]: r for r in clips.smoothed_topk(df, ["clip"], ["frame", "id"], [0.2, 0.5], array_limit=limit, order_span=50).collect()}
    for name, p in data.items():
        for ratio in (0.2, 0.5):
            k = max(1, int(np.ceil(len(p) * ratio)))
            for kind, fn in (("moving_avg", moving), ("gaussian", gaussian)):
                want = np.sort(fn(p))[-k:].mean()
                assert rows[name][f"{kind}_topk-{ratio}"] == pytest.approx(want, abs=1e-11)


def test_topk_mean_with_ties(spark):
    df = spark.createDataFrame([("a", 0.5)] * 5 + [("a", 0.9)] * 2 + [("b", 0.1)], "c string, prob double")
    rows = {r["c"]: r for r in clips.topk_mean(df, ["c"], 0.5).collect()}
    assert rows["a"]["k"] == 4 and rows["a"]["topk_mean"] == pytest.approx((1.8 + 1.0) / 4)
    assert rows["b"]["k"] == 1


def test_methods_are_22_and_unique():
    methods = clips.all_methods()
    assert len(methods) == len(set(methods)) == 22
    with pytest.raises(ValueError):
        clips.parse_method("median-0.5")


def test_label_and_vote_ties_round_to_even(clip_rows):
    out = clips.decide(clip_rows, ["clip_key"], ["majority_vote", "mean_prob-0.4", "threshold_ratio-0.5"]).collect()
    tie = {r["method"]: r for r in out if r["clip_key"] == "c3"}
    assert tie["majority_vote"]["label"] == 0 and tie["majority_vote"]["pred"] == 0
    assert tie["mean_prob-0.4"]["pred"] == 1
    assert tie["threshold_ratio-0.5"]["pred"] == 1


def test_label_rules_differ(clip_rows):
    by_rule = {
        rule: {r["clip_key"]: r["label"] for r in clips.clip_label(clip_rows, ["clip_key"], rule).collect()}
        for rule in clips.LABEL_RULES
    }
    assert by_rule["max"]["c3"] == 1 and by_rule["round_mean"]["c3"] == 0 and by_rule["mode"]["c3"] == 0
    with pytest.raises(ValueError):
        clips.clip_label(clip_rows, ["clip_key"], "median")


def test_confidence_weights_fall_back_to_the_mean(spark):
    df = spark.createDataFrame([("a", 0, 0.5, 1, 1), ("a", 1, 0.5, 1, 1)], "clip_key string, frame int, prob double, pred int, label int")
    row = clips.decide(df, ["clip_key"], ["conf_weighted-0.5"]).first()
    assert row["score"] == 0.5 and row["pred"] == 1


def test_decisions_do_not_depend_on_partitioning(clip_rows):
    runs = [
        sorted(tuple(r) for r in clips.decide(clip_rows.repartition(n), ["clip_key"], order=["frame"]).collect()) for n in (1, 7)
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 66


def test_multiclass(spark):
    df = spark.createDataFrame(
        [("a", 1, [0.2, 0.8, 0.0]), ("a", 2, [0.8, 0.2, 0.0]), ("b", 2, [0.0, 0.1, 0.9])], "clip string, label int, probs array<double>"
    )
    rows = {r["clip"]: r for r in clips.multiclass_clips(df, ["clip"]).collect()}
    assert rows["a"]["pred"] == 0 and rows["a"]["label"] == 1 and rows["b"]["pred"] == 2


def test_length_split_is_complete(long_clips):
    _, df = long_clips
    short, long = clips.split_by_length(df.withColumn(clips.CLIP, F.struct("clip")), 10)
    assert short.count() + long.count() == df.count()
    assert {r["clip"] for r in long.select("clip").distinct().collect()} == {"eleven", "forty", "big"}
    assert long.agg(F.count(F.lit(1))).first()[0] == 384


@pytest.mark.parametrize("limit", [5, 100])
def test_clips_without_key_survive_every_rule(spark, limit):
    """A null key is a clip of its own, short or long."""
    rows = [(None, i, float(i % 7) / 7, i % 2) for i in range(20)] + [("a", i, float(i % 5) / 5, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "clip string, frame int, prob double, label int").withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    for kind in ("moving_avg", "gaussian"):
        out = clips.smoothed_frames(df, ["clip"], ["frame"], kind, array_limit=limit)
        assert out.count() == 40 and out.filter("clip IS NULL").count() == 20
    decided = clips.decide(df, ["clip"], order=["frame"], array_limit=limit)
    assert decided.count() == 44 and decided.filter("clip IS NULL").count() == 22


@pytest.mark.parametrize(("kind", "reference"), [("moving_avg", moving), ("gaussian", gaussian)])
def test_rows_beyond_arrays_equal_convolution(long_clips, kind, reference):
    data, df = long_clips
    out = clips.smoothed_frames(df, ["clip"], ["frame", "id"], kind, array_limit=4, array_frames=4, order_span=50)
    assert len(re.findall("Window", out._jdf.queryExecution().optimizedPlan().toString())) > 0
    got = {(r["clip"], r["position"]): r["smoothed"] for r in out.collect()}
    assert len(got) == sum(len(p) for p in data.values())
    for name, p in data.items():
        assert [got[name, i] for i in range(len(p))] == pytest.approx(list(reference(p)), abs=1e-11)


@pytest.mark.parametrize("kind", ["moving_avg", "gaussian"])
def test_running_sums_send_every_frame_once(long_clips, kind):
    _, df = long_clips
    out = clips.smoothed_frames(df, ["clip"], ["frame", "id"], kind, array_limit=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("kind", ["moving_avg", "gaussian"])
def test_null_probability_spoils_only_its_windows(spark, kind):
    rows = [("c", i, None if i == 2 else i / 20) for i in range(20)]
    out = clips.smoothed_frames(spark.createDataFrame(rows, "clip string, frame int, prob double"), ["clip"], ["frame"], kind)
    got = [r["smoothed"] for r in out.orderBy("position").collect()]
    n, mid = 20, 9
    hit = [i - 2 <= 2 <= i + 1 if kind == "moving_avg" else 0 <= mid + i - 2 < n for i in range(n)]
    assert [v is None for v in got] == hit and not any(v is not None and np.isnan(v) for v in got)
