"""Manifests, quality reports, sources, sinks and reports on small tables."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab import schema
from cliplab.operators import manifest as m
from cliplab.operators import quality, ranking, report
from cliplab.sources import cache, sinks, tables

CLASSES = {"Ulcer": 1, "NonUlcer": 0}


@pytest.fixture
def tree(tmp_path):
    files = [
        "Ulcer/v1/ulcer_1/frame_001.jpg", "Ulcer/v1/ulcer_1/frame_002.JPG", "Ulcer/v2/ulcer_3/frame_001.png",
        "NonUlcer/v1/normal_2/frame_001.jpg", "NonUlcer/v2/normal_1/frame_009.jpg", "NonUlcer/v2/normal_1/.hidden.jpg",
        "NonUlcer/v2/normal_1/notes.txt", "Other/v2/x_1/frame_1.jpg",
    ]
    for f in files:
        path = tmp_path / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 2048)
    return tmp_path


def test_listing_and_manifest(spark, tree):
    listing = tables.list_files(spark, str(tree))
    assert listing.count() == 6
    assert {r["size_kb"] for r in listing.collect()} == {2.0}
    rows = {r["relative_path"]: r for r in m.clip_manifest(listing, CLASSES).collect()}
    assert len(rows) == 5
    r = rows["Ulcer/v1/ulcer_1/frame_002.JPG"]
    assert (r["video_id"], r["label"], r["segment_number"], r["clip_key"]) == ("v1", 1, 1, "v1__ulcer_1")
    assert rows["NonUlcer/v2/normal_1/frame_009.jpg"]["frame_number"] == 9
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_informative_manifest(spark):
    paths = [
        "Informative/vid_1__sample_2__frame_3.jpg", "Non-Informative/motion_blur/vid_1__sample_2__frame_4.jpg",
        "Non-Informative/vid_2__ulcer_Ulcer_1__frame_5.png", "Informative/broken.jpg", "Informative/deep/vid_1__sample_2__frame_9.jpg",
    ]
    good, rejects = m.informative_manifest(spark.createDataFrame([(p,) for p in paths], "relative_path string"))
    rows = {r["frame_number"]: r for r in good.collect()}
    assert set(rows) == {3, 4, 5} and rows[4]["cause"] == "motion blur" and rows[5]["cause"] == ""
    assert rows[5]["sample_id"] == "vid_2__ulcer_Ulcer_1" and rows[3]["label"] == 1
    assert [r[0] for r in rejects.collect()] == ["Informative/broken.jpg"]


def test_windows_lookup_and_matching(spark):
    pos = spark.createDataFrame(
        [(" vid_01 ", "00:01:00", "00:02:00", "1", "<5mm"), ("vid_01", "00:03:00", "00:02:00", "2", ">20mm"), (None, "00:01:00", "00:02:00", "3", None)],
        "record_id string, start_time string, end_time string, sample_number string, size string",
    )
    neg = spark.createDataFrame([("vid_02", "00:00:10", "00:00:20", "1")], "record_id string, start_time string, end_time string, sample_number string")
    w = m.labelled_windows(pos, neg)
    assert sorted((r["record_id"], r["label"], r["start_s"], r["end_s"]) for r in w.collect()) == [("vid_01", 1, 60.0, 120.0), ("vid_02", 0, 10.0, 20.0)]
    matched, skipped = m.match_videos(w, spark.createDataFrame([("VID_01", "/v/VID_01.mov")], "stem string, path string"))
    assert matched.first()["video_path"] == "/v/VID_01.mov" and skipped.first()["reason"] == "video_not_found"
    rows = spark.createDataFrame(
        [("a", "1", "<5mm", 1), ("a", "1", ">20mm", 2), ("a", "x", "<5mm", 3), ("b", "2.0", "?", 4)], "record_id string, sample_number string, size string, o int"
    )
    assert {(r[0], r[1]): r[2] for r in m.size_lookup(rows, "o").collect()} == {("a", 1): 3, ("b", 2): None}


def test_interval_join_edges(spark):
    frames = spark.createDataFrame([("r", float(t)) for t in range(0, 300, 30)], "record_id string, time_s double")
    windows = spark.createDataFrame([("r", 30.0, 240.0, 1), ("r", 59.0, 60.0, 2), ("q", 0.0, 500.0, 3)], "record_id string, start_s double, end_s double, w int")
    hits = m.frames_in_windows(frames, windows, bucket_s=60.0)
    assert sorted((r["w"], r["time_s"]) for r in hits.collect()) == [(1, t) for t in (30.0, 60.0, 90.0, 120.0, 150.0, 180.0, 210.0)]


def test_interval_join_of_long_windows_and_busy_cells(spark):
    """Windows of a second to a year, a record with most of the frames, cells split in small parts: all pairs once."""
    year = 365 * 86400.0
    frames = [("busy", float(t * 7919 % 1000) + t % 3 / 4) for t in range(900)] + [("calm", float(t) * 40000) for t in range(50)] + [(None, 5.0), ("busy", None)]
    spans = [("busy", 0.0, year), ("busy", 3.5, 3.75), ("busy", 0.0, 64.0), ("busy", 31.0, 159.0), ("busy", -500.0, 12.0), ("calm", 1e5, 1e5 + year)]
    spans += [("busy", 9.0, 9.0), ("calm", 8.0, 7.0), (None, 0.0, 9.0), ("lost", 0.0, year), ("calm", -year, 1.0)]
    f = spark.createDataFrame(frames, "record_id string, time_s double").repartition(3)
    w = spark.createDataFrame([(*x, i) for i, x in enumerate(spans)], "record_id string, start_s double, end_s double, w int")
    want = sorted((i, t) for k, t in frames for i, (q, a, b) in enumerate(spans) if k == q and k is not None and t is not None and a <= t < b)
    for busy in (7, 10**6):
        hits = m.frames_in_windows(f, w, bucket_s=1.0, busy_rows=busy)
        assert sorted((r["w"], r["time_s"]) for r in hits.collect()) == want
    assert m.frames_in_windows(f, w.limit(0)).count() == 0


def test_quantiles_of_any_spread(spark):
    """One outlier, a hot value and a group of most rows: every partition gets its share of the distinct values."""
    values = [("hot", float(i)) for i in range(4000)] + [("hot", 1e15)] + [("hot", 7.0)] * 2000 + [("few", -1.5), ("few", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        probs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.999, "e": 1.0}
        got = {r["g"]: [r[n] for n in probs] for r in ranking.exact_quantiles(df, ["g"], "v", probs).collect()}
        sizes = [r["count"] for r in ranking.range_buckets(df.distinct(), ["g", "v"]).groupBy("__b").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", "few", None):
        own = np.array([v for k, v in values if k == g and v is not None])
        assert got[g] == pytest.approx([np.quantile(own, p) for p in probs.values()])
    assert len(sizes) > 1 and max(sizes) < 2500


def test_duplicates(spark):
    items = spark.createDataFrame([("s", "a/1", 5), ("s", "b/1", 9), ("s", "c/1", 9), ("t", "a/2", 1)], "stem string, path string, mtime int")
    keep = lambda **k: {r["path"] for r in m.duplicate_actions(items, **k).filter("action = 'keep'").collect()}
    assert keep() == {"b/1"} and keep(keep_prefix="a/") == {"a/1"}
    assert m.duplicate_actions(items).count() == 3 and m.duplicate_groups(items).first()["n_copies"] == 3
    assert not m.has_no_duplicates(items) and m.has_no_duplicates(items.filter("stem = 't'"))


def test_reviews_and_joins_that_must_not_lose_rows(spark):
    base = spark.createDataFrame([("a", 1, ""), ("b", 0, "blur"), ("c", 0, "dark")], "image_path string, label int, cause string")
    log = spark.createDataFrame(
        [("b", "t1", "Non-Informative", "x"), ("b", "t2", "Informative", "x"), ("c", "t1", "Non-Informative", "debris")],
        "image_path string, timestamp string, new_label string, new_cause string",
    )
    got = {r["image_path"]: (r["label"], r["cause"], r["reviewed"]) for r in m.apply_reviews(base, log).collect()}
    assert got == {"a": (1, "", False), "b": (1, "", True), "c": (0, "debris", True)}
    scores = base.select(F.col("image_path").alias("frame_id"))
    with pytest.raises(ValueError):
        m.attach_predictions(scores, scores.limit(2))
    with pytest.raises(RuntimeError):
        m.attach_features(scores, scores.filter("frame_id <> 'a'"), "frame_id")
    assert [r[0] for r in m.new_items(scores, scores.limit(2), "frame_id").collect()] == ["c"]
    uncertain = spark.createDataFrame([("a", "uncertain"), ("b", "informative")], "f string, category string")
    assert m.review_queue(uncertain).count() == 1


def test_scores_are_attached_with_one_shuffle_of_each_side(spark):
    rows = spark.range(500).select(F.concat(F.lit("f"), "id").alias("frame_id"), (F.col("id") % 2).alias("label"), F.col("id").alias("x"))
    scores = spark.range(500).select((F.col("id") / 500).alias("prob"), F.concat(F.lit("f"), "id").alias("frame_id"), F.lit("s").alias("label"))
    got = m.attach_predictions(rows, scores)
    assert got.columns == ["frame_id", "label", "x", "prob", "label"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"f{i}", i % 2, i, i / 500, "s") for i in range(500))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    again, none = rows.limit(1), rows.limit(1).withColumn("frame_id", F.lit(None).cast("string"))
    for left, right in [
        (rows.union(again), scores), (rows, scores.union(scores.limit(1))), (rows.union(again), scores.union(scores.limit(1))),
        (rows.limit(499), scores), (rows.union(none), scores), (rows.union(none), scores.union(none.select("x", "frame_id", F.lit("s")))),
    ]:
        with pytest.raises(ValueError, match="is on"):
            m.attach_predictions(left, right)


def test_tasks_do_not_grow_with_a_table(spark):
    from cliplab.sources.tables import spread

    cores = spark.sparkContext.defaultParallelism
    for n in (1000, 20_000, 200_000):
        df = spread(spark.range(0, n, 1, cores), "id", rows=2000)
        assert df.rdd.getNumPartitions() == max(cores, n // 2000) and df.count() == n
        sizes = df.groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in sizes.collect()) < 2500
    assert spread(spark.range(0, 20_000, 1, cores), "id").rdd.getNumPartitions() == cores


def test_ensemble_by_clip_sorts_no_rows(spark):
    rows = [("m", "c1", 0, 0.2), ("m", "c1", 1, 0.6), ("m", "c2", None, None), ("n", "c1", 1, 1.0)]
    df = spark.createDataFrame(rows, "model string, clip_key string, label int, prob double")
    got = quality.ensemble(df, ["model", "clip_key"])
    assert got.columns == ["model", "clip_key", "prob", "label", "n_folds"]
    assert {tuple(r) for r in got.collect()} == {("m", "c1", 0.4, 1, 2), ("m", "c2", None, None, 1), ("n", "c1", 1.0, 1, 1)}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    frames = quality.ensemble(df.withColumn("frame_id", F.lit("f")))
    assert {(r["model"], r["clip_key"], r["n_folds"]) for r in frames.collect()} == {("m", "c1", 3), ("n", "c1", 1)}


def test_quality_and_leakage(spark):
    rows = [
        ("p/1.jpg", 0, "v1", "p001", "s1", 1, "c1", "train"), ("p/1.jpg", 1, "v1", "p001", "s1", 1, "c1", "train"),
        ("p/3.jpg", 1, "v2", "p001", "s2", 2, "c2", "val"), ("p/4.jpg", None, "v3", "p003", "s3", 3, "c3", "test"),
    ]
    df = spark.createDataFrame(rows, "relative_path string, label int, video_id string, patient_id string, segment_id string, frame_number int, clip_key string, split string")
    r = quality.manifest_quality(df).first()
    assert (r["rows"], r["duplicate_relative_path"], r["duplicate_clip_frame"], r["missing_cells"], r["expected_columns_present"]) == (4, 1, 1, 1, 8)
    short = quality.manifest_quality(df.drop("split", "relative_path")).first()
    assert (short["duplicate_relative_path"], short["expected_columns_missing"]) == (0, 2)
    leak = {(r["split_a"], r["split_b"]): r["n_shared"] for r in quality.split_overlap(df).collect()}
    assert leak == {("test", "train"): 0, ("test", "val"): 0, ("train", "val"): 1}
    assert [r["patient_id"] for r in quality.overlap_examples(df).collect()] == ["p001"]
    counts = quality.entity_counts(df).first()
    assert (counts["videos"], counts["patients"], counts["segments"], counts["clips"]) == (3, 2, 3, 3)
    assert quality.video_summary(df).filter("video_id = 'v1'").first()["split"] == "train"


def test_published_label_shift(spark):
    """Frame counts per split and label of a published dataset, and its shifts."""
    counts = {("test", 0): 457, ("test", 1): 211, ("train", 0): 1862, ("train", 1): 900, ("val", 0): 769, ("val", 1): 296}
    df = spark.createDataFrame([(s, y, n) for (s, y), n in counts.items()], "split string, label int, n int")
    frames = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")
    got = {r["split"]: r["label_shift"] for r in quality.label_shift(frames).collect()}
    assert got == {"test": 0.0029, "train": 0.0128, "val": 0.0351}
    assert frames.count() == 4495


def test_sample_level_rounds_before_the_mean(spark):
    df = spark.createDataFrame(
        [("s", 0.49996, 0, 1, "a"), ("s", 0.5, 1, 1, "b"), ("t", 0.1, 0, 0, None)], "sample_id string, pred_prob double, pred_label int, label int, cause string"
    )
    rows = {r["sample_id"]: r for r in quality.sample_level(df).collect()}
    assert (rows["s"]["mean_prob"], rows["s"]["pred_label"], rows["s"]["noninf_frame_pct"], rows["s"]["correct"], rows["s"]["cause"]) == (0.5, 1, 0.5, 1, "a")
    assert rows["t"]["cause"] == ""


def test_running_totals_and_quantiles_with_null_groups(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(11)] + [("g", 2.0), ("g", 4.0)], "g string, v double")
    q = {r["g"]: r["m"] for r in ranking.exact_quantiles(df, ["g"], "v", {"m": 0.25}).collect()}
    assert q == {None: 2.5, "g": 2.5}
    ranked = ranking.group_rank(df.withColumn("b", F.floor(F.col("v") / 3)), ["g"], ["b"], [F.col("v")])
    assert [r["rank"] for r in ranked.filter("g is null").orderBy("v").collect()] == list(range(1, 12))
    assert {r["rank_total"] for r in ranked.filter("g = 'g'").collect()} == {2}


def test_join_by_entity_with_hot_and_null_keys(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.filter("k is not null").select("k").distinct().withColumn("v", F.length("k"))
    out = ranking.join_by_entity(rows, table, ["k"])
    assert out.count() == 6000 and out.filter("v is null").count() == 2000 and out.filter("k = 'hot' and v = 3").count() == 2000
    assert ranking.join_by_entity(rows, table, ["k"], "inner").count() == 4000


def test_attach_by_group_keeps_hot_and_null_groups(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 990, None).otherwise("x").alias("g"))
    table = spark.createDataFrame([("hot", 1), (None, 2)], "g string, v int")
    out = ranking.attach_by_group(rows, table, ["g"])
    assert out.columns == ["id", "g", "v"]
    assert {r["v"]: r["n"] for r in out.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 700, 2: 290}
    assert ranking.attach_by_group(rows, table, ["g"], "left").count() == 1000


def test_histogram_and_entropy(spark):
    import numpy as np

    x = np.random.default_rng(0).random(500) * 7
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    got = {r["bin"]: r["n"] for r in quality.histogram(df, "v", 30).collect()}
    counts, _ = np.histogram(x, bins=30)
    assert [got.get(i, 0) for i in range(30)] == counts.tolist()
    h, _ = np.histogram(x, bins=36, range=(0, 7))
    p = h / (h.sum() + 1e-9)
    want = -(p * np.log2(p + 1e-9)).sum() / np.log2(36)
    assert quality.histogram_entropy(df, ["k"], "v", 0.0, 7.0).first()["entropy"] == pytest.approx(want, abs=1e-6)


def test_feature_cache(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 1), ("val", "b", 0)], "split string, relative_path string, label int")
    calls = []

    def build(x):
        calls.append(1)
        return x.withColumn("feature", F.length("relative_path"))

    path = str(tmp_path / "features")
    for manifest, groups, n in ((df, None, 1), (df.repartition(2), None, 1), (df, ["edge"], 2), (df.withColumn("label", F.lit(1)), ["edge"], 3)):
        assert cache.cached_features(manifest, path, build, groups).count() == 2
        assert len(calls) == n


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("p1", "c1", "a", 1, "train"), ("p2", "c2", "b", 0, "test")], "patient_id string, clip_key string, relative_path string, label int, split string"
    )
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert sorted(os.listdir(tmp_path / "m" / "manifest"))[-2:] == ["split=test", "split=train"]
    assert spark.read.json(str(tmp_path / "m" / "split_info")).count() == 2
    ci = spark.createDataFrame([("f1", 0.51239, 0.4, 0.6), ("auroc", 0.5, None, None)], "metric string, mean double, lower double, upper double")
    sinks.write_intervals(ci, str(tmp_path / "ci"), "test")
    rows = spark.read.json(str(tmp_path / "ci" / "test_ci")).collect()
    assert len(rows) == 1 and rows[0]["mean"] == 0.5124


def test_schema_checks(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError):
        schema.require_columns(df, ["a", "b"])
    assert schema.with_string_keys(df, "a").dtypes == [("a", "string")]


def test_runs(spark):
    runs = spark.createDataFrame(
        [("p", None, "resnet_cv", "2024-01-02"), ("k", "p", "fold", "2024-01-02"), ("q", None, "vit_split", "2024-01-01")],
        "run_id string, parent_id string, run_name string, start_time string",
    ).withColumn("experiment", F.lit("e"))
    values = spark.createDataFrame([("p", "f1", 0.7), ("q", "f1", 0.9), ("k", "f1", 0.99), ("q", "auroc", -1.0)], "run_id string, metric string, value double")
    assert [r["run_id"] for r in report.compare_runs(runs, values, ["f1"], 5).collect()] == ["q", "p"]
    assert m.child_runs(runs).first()["parent_name"] == "resnet_cv"
    best = report.best_run(values.withColumn("experiment", F.lit("e")), "f1").first()
    assert best["run_id"] == "k"
    ci = values.withColumns({"lower": F.col("value") - 0.1, "upper": F.col("value") + 0.1})
    rep = report.performance_report(runs, values, ci, "2024-01-02", ["f1"]).collect()
    assert [(r["display_name"], round(r["f1_half_width"], 6)) for r in rep] == [("resnet", 0.1)]
    folds = spark.createDataFrame([("m", 0, None, 0.4), ("m", 1, 0.8, 0.5), ("m", 2, 0.8, 0.6)], "model string, fold int, auroc double, threshold double")
    assert report.best_fold(folds).first()["fold"] == 1
    one = report.cv_summary(folds.limit(2), ["model"], ["auroc"]).first()
    assert one["std"] == 0.0 and one["n_folds"] == 1


def test_first_item_and_next_window(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 250.0), ("b", 2.0)], "k string, t double")
    assert {r["k"]: r["t"] for r in m.first_item(df, ["k"], F.col("t")).collect()} == {"a": 1.0, "b": 2.0}
    spans = sorted((r["start_s"], r["end_s"]) for r in m.window_pairs(df, "k", "t", 100).collect())
    assert spans == [(1.0, 3.0), (3.0, 250.0)]


def test_mtime_is_read(spark, tree):
    row = tables.list_files(spark, str(tree)).first()
    assert abs(row["mtime"].timestamp() - time.time()) < 86400 * 2


def test_fingerprint_of_reordered_rows_deals_them_to_all_tasks(spark, tmp_path):
    from cliplab.plans import QUERIES

    plan = QUERIES["a09_manifest_fingerprint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [xxhash64(relative_path" in plan
    assert "RepartitionByExpression [label" not in plan


def test_frames_join_sends_numbers_not_text(spark):
    from cliplab.plans.views import Views

    plan = Views(spark, "/root/testdata/sf0.001").frames()._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]
    assert "concat_ws(-, " in plan and "concat_ws(-, " not in below


def test_written_predictions_are_not_shuffled(spark, tmp_path):
    from cliplab.sources import tables

    rows = spark.range(500, numPartitions=1).selectExpr("'m' || id % 2 AS model", "CAST(0 AS int) AS fold", "'f' || id AS frame_id", "id")
    tables.write_predictions(rows, str(tmp_path / "p"))
    back = [r["id"] for r in spark.read.parquet(str(tmp_path / "p")).filter("model = 'm1'").collect()]
    assert back == list(range(1, 500, 2))
