from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.operators import quality, sampling, splits


@pytest.fixture(scope="module")
def manifest(spark):
    rng = np.random.default_rng(2)
    rows = []
    for p in range(120):
        ratio = [0.0, 0.2, 0.7][p % 3]
        for c in range(1 + p % 4):
            for f in range(int(rng.integers(1, 9))):
                rows.append((f"p{p}", f"p{p}__s{c}", f, int(rng.random() < ratio), f"p{p}/{c}/{f}"))
    return spark.createDataFrame(rows, "patient_id string, clip_key string, frame_number int, label int, relative_path string")


def test_published_quotas(spark):
    counts = spark.createDataFrame([("low", 13), ("high", 8), ("none", 4)], "stratum string, n bigint")
    got = {r["stratum"]: (r["n_train"], r["n_val"], r["n_test"], r["rare"]) for r in splits.split_quotas(counts, 0.70, 0.15, 0.15).collect()}
    assert got == {"low": (9, 2, 2, False), "high": (5, 1, 2, False), "none": (2, 1, 1, True)}


def test_quotas_of_many_strata(spark):
    """Equal remainders by the thousand: shares sum to the target and ties go by name, without one task for all strata."""
    counts = spark.range(3000).selectExpr("concat('s', lpad(id, 5, '0')) AS stratum", "20 + id % 3 AS n")
    quotas = splits.split_quotas(counts, 0.70, 0.15, 0.15)
    rows = quotas.orderBy("stratum").collect()
    total = sum(r["n"] for r in rows)
    assert len(rows) == 3000 and sum(r["n_val"] + r["n_test"] for r in rows) == -(-total * 3 // 10)
    for size in (20, 21, 22):
        held = [r["n_val"] + r["n_test"] for r in rows if r["n"] == size]
        assert held == sorted(held, reverse=True) and max(held) - min(held) <= 1


def test_tiny_strata(spark):
    counts = spark.createDataFrame([("one", 1), ("two", 2), ("three", 3)], "stratum string, n bigint")
    got = {r["stratum"]: (r["n_train"], r["n_val"], r["n_test"]) for r in splits.split_quotas(counts, 0.70, 0.15, 0.15).collect()}
    assert got == {"one": (0, 0, 1), "two": (1, 0, 1), "three": (1, 1, 1)}


def test_split_covers_all_without_leakage(manifest):
    out = splits.assign_train_val_test_split(manifest)
    assert out.count() == manifest.count() and out.filter("split is null").count() == 0
    assert out.groupBy("patient_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert all(r["n_shared"] == 0 for r in quality.split_overlap(out).collect())
    sizes = {r["split"]: r["n"] for r in out.select("patient_id", "split").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(sizes.values()) == 120 and abs(sizes["train"] - 84) <= 2 and abs(sizes["test"] - 18) <= 2


def test_seed_decides(manifest):
    def run(seed, parts):
        return sorted(tuple(r) for r in splits.assign_train_val_test_split(manifest.repartition(parts), seed=seed).select("patient_id", "split").distinct().collect())

    assert run(1, 1) == run(1, 6) != run(2, 1)


def test_empty_and_missing(spark, manifest):
    assert splits.assign_train_val_test_split(manifest.limit(0)).count() == 0
    with pytest.raises(KeyError):
        splits.assign_train_val_test_split(manifest.drop("patient_id"))
    with pytest.raises(KeyError):
        splits.assign_train_val_test_split(manifest.drop("label"))
    with pytest.raises(ValueError):
        splits.strata(manifest, "colour")
    counts = manifest.limit(0).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    assert splits.split_strategy(counts).first()[0] == "empty"


def test_ratio_bins(spark):
    df = spark.createDataFrame(
        [("a", 0)] * 5 + [("b", 1)] + [("b", 0)] * 4 + [("c", 1)] * 4 + [("c", 0)], "patient_id string, label int"
    )
    got = {r["patient_id"]: r["stratum"] for r in splits.strata(df, "ulcer_ratio").collect()}
    assert got == {"a": "no_ulcer", "b": "low_ulcer", "c": "high_ulcer"}


def test_size_strata_and_fallback(spark):
    df = spark.createDataFrame([("p1", 1, 1), ("p1", 1, None), ("p2", 0, None)], "patient_id string, label int, ulcer_size int")
    one = lambda mode, d=df: {r["patient_id"]: r["stratum"] for r in splits.strata(d, mode).collect()}
    assert one("size") == {"p1": "1", "p2": "none"}
    assert one("size_and_presence") == {"p1": "ulcer__1", "p2": "no_ulcer__none"}
    blank = df.withColumn("ulcer_size", F.lit(None).cast("int"))
    assert one("size", blank) == {"p1": "ulcer", "p2": "no_ulcer"}
    assert one("size_and_presence", df.drop("ulcer_size")) == {"p1": "ulcer__none", "p2": "no_ulcer__none"}


def test_all_modes_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([0, 1, 1, None]), rng.choice([1, 2, 3, None])) for _ in range(300)]
    rows += [("zero", 0, 2), ("blank", None, 1), ("tie", 1, 3), ("tie", 1, 2)]
    df = spark.createDataFrame(rows, "patient_id string, label int, ulcer_size int").repartition(7)
    want = {}
    for p in {r[0] for r in rows}:
        labels = [x for q, x, _ in rows if q == p and x is not None]
        sizes = Counter(s for q, x, s in rows if q == p and x == 1 and s is not None)
        presence = "ulcer" if 1 in labels else "no_ulcer"
        size = str(min(sizes, key=lambda s: (-sizes[s], s))) if sizes else "none"
        share = sum(labels) / len(labels) if labels else None
        ratio = "no_ulcer" if share == 0 else "low_ulcer" if share is not None and share < 0.4 else "high_ulcer"
        want[p] = (size, presence, f"{presence}__{size}", ratio)
    out = splits.all_strata(df)
    assert {r["patient_id"]: tuple(r[m] for m in splits.STRAT_MODES) for r in out.collect()} == want
    assert splits.all_strata(df.limit(0)).count() == 0


def test_frames_are_shuffled_once_for_all_modes(spark, tmp_path):
    """The check for any size reuses the shuffle of the counts."""
    spark.createDataFrame([("a", 1, 2), ("b", 0, None)], "patient_id string, label int, ulcer_size int").write.parquet(f"{tmp_path}/f")
    out = splits.all_strata(spark.read.parquet(f"{tmp_path}/f"))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_folds(manifest):
    out = splits.assign_cv_folds(manifest, 5)
    per = out.groupBy("patient_id").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("fold"))
    assert per.filter("n <> 1").count() == 0 and per.count() == 120
    sizes = [r["n"] for r in per.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
    train, val = splits.cv_fold(out, 3)
    assert train.count() + val.count() == manifest.count()
    assert train.select("patient_id").intersect(val.select("patient_id")).count() == 0
    with pytest.raises(ValueError):
        splits.cv_fold(out, 5)


def test_val_split(manifest, spark):
    out = splits.assign_val_split(manifest, 0.25)
    n_val = out.filter("role = 'val'").select("patient_id").distinct().count()
    assert n_val == 30
    single = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "patient_id string, label int")
    assert splits.assign_val_split(single, 0.3).filter("role = 'val'").count() == 1


def test_train_val_roles(manifest):
    split = splits.assign_train_val_test_split(manifest)
    assert {r["role"] for r in splits.train_val_roles(split).select("role").distinct().collect()} == {"train", "val"}
    carved = splits.train_val_roles(split.filter("split <> 'val'"))
    assert carved.filter("split <> 'train'").count() == 0 and carved.filter("role = 'val'").count() > 0
    assert splits.heldout_rows(manifest).count() == manifest.count()
    assert splits.heldout_rows(split).filter("split <> 'test'").count() == 0


def test_clip_sample(manifest):
    total = manifest.select("clip_key").distinct().count()
    assert splits.sample_clips(manifest, 1.0).count() == total
    chosen = splits.sample_clips(manifest, 0.3)
    assert chosen.count() == round(total * 0.3)
    full = {r["stratum"]: r["n"] for r in splits.clip_strata(manifest).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in chosen.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect():
        assert abs(r["n"] - full[r["stratum"]] * 0.3) < 1
    assert splits.sample_train(manifest, 0.0).select("clip_key").distinct().count() == 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert [r["weight"] for r in splits.class_weights(df, 3).orderBy("class_id").collect()] == pytest.approx([8 / 18, 8 / 6, 1.0])
    assert [r["weight"] for r in splits.class_weights(df, 2, manual=3.0).orderBy("class_id").collect()] == [1.0, 3.0]
    assert [r["weight"] for r in splits.class_weights(df, 2, manual=[0.5, 2.0]).orderBy("class_id").collect()] == [0.5, 2.0]


def test_hot_stratum_is_ranked_whole(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("pid"), F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("stratum"))
    out = splits.split_ids(ids, "pid")
    got = {(r["stratum"], r["split"]): r["n"] for r in out.groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(got.values()) == 5000 and got[("hot", "test")] + got[("small", "test")] == 750


# ------------------------------------------------------------------- sampling


def test_intervals_avoid_the_last_frame(spark):
    videos = spark.createDataFrame([("a", 100, 10.0), ("b", 10, 10.0), ("c", 35, 10.0)], "video_id string, total_frames bigint, fps double")
    rows = sampling.sample_intervals(videos, 1.0, 100).collect()
    starts = sorted(r["start_frame"] for r in rows if r["video_id"] == "a")
    assert starts == list(range(0, 90, 10))
    assert not [r for r in rows if r["video_id"] == "b"]
    assert sorted(r["start_frame"] for r in rows if r["video_id"] == "c") == [0, 10, 20]
    assert sampling.sample_intervals(videos, 1.0, 2).filter("video_id = 'a'").count() == 2


def test_timestamps_and_queue(spark):
    w = spark.createDataFrame([(0.0, 2.0), (5.0, 5.0), (3.0, 4.1)], "start_s double, end_s double")
    assert sorted(r["timestamp_s"] for r in sampling.sample_timestamps(w, 2.0).collect()) == pytest.approx([0, 0.5, 1, 1.5, 3, 3.5, 4])
    assert sampling.sample_timestamps(w, 0.0).count() == 0
    q = spark.createDataFrame([(10, 31, 25.0)], "start_frame bigint, end_frame bigint, fps double")
    assert [r["frame_idx"] for r in sampling.build_frame_queue(q, sample_fps=2.5).orderBy("frame_idx").collect()] == [10, 20, 30]


def test_long_ranges_are_generated_in_blocks(spark):
    df = spark.createDataFrame([(25_001,), (0,)], "n bigint")
    out = sampling.explode_range(df, F.col("n"), "i")
    assert out.agg(F.count(F.lit(1)), F.count_distinct("i"), F.max("i")).first()[:] == (25_001, 25_001, 25_000)


def test_uniform_stride(spark):
    df = spark.createDataFrame([("g", i * 7, f"x{i}") for i in range(23)] + [("s", 1, "y")], "g string, frame int, id string")
    for k in (1, 2, 5, 10, 22, 23, 40):
        got = [r["frame"] // 7 for r in sampling.uniform_stride(df, ["g"], ["frame", "id"], k, span=40).filter("g = 'g'").orderBy("frame").collect()]
        want = list(range(23)) if k >= 23 else sorted(set(np.round(np.linspace(0, 22, k)).astype(int).tolist()))
        assert got == want


def test_diversity_both_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(8)
    data = {s: rng.normal(size=(n, 4)) for s, n in (("a", 30), ("b", 3), ("c", 12))}
    rows = [(s, i, [float(x) for x in v]) for s, m in data.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "seg string, item int, vec array<double>")

    def brute(m, k):
        taken = [0]
        while len(taken) < min(k, len(m)):
            d = np.min([np.linalg.norm(m - m[t], axis=1) for t in taken], axis=0)
            d[taken] = -1
            taken.append(int(np.argmax(d)))
        return taken

    for limit in (5000, 10):
        got = {}
        for r in sampling.diversity_sample(df, "seg", "item", "vec", 6, group_limit=limit).orderBy("pick_order").collect():
            got.setdefault(r["seg"], []).append(r["item"])
        assert got == {s: brute(m, 6) for s, m in data.items()}


def test_row_samples(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("frame_id"), (F.col("id") % 3).alias("label"))
    a = {r["frame_id"] for r in sampling.sample_rows(df, 40).collect()}
    assert len(a) == 40 and a == {r["frame_id"] for r in sampling.sample_rows(df.repartition(5), 40).collect()}
    per = sampling.sample_rows(df, 7, per=["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    assert [r["n"] for r in per] == [7, 7, 7]


def test_clip_strata_read_the_frames_once(spark):
    rows = [("c1", 1), ("c1", 0), ("c1", 1), ("c2", 0), ("c2", None), ("c3", None), (None, 1), ("c4", 1), ("c4", 0)]
    clips = splits.clip_strata(spark.createDataFrame(rows, "clip_key string, label int"))
    assert "LocalTableScan" not in clips._jdf.queryExecution().executedPlan().toString()
    got = {r["clip_key"]: (r["label"], r["n_frames"]) for r in clips.collect()}
    assert got == {"c1": (1, 3), "c2": (0, 1), None: (1, 1), "c4": (0, 2)}
