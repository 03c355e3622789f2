"""Queries for aggregations and data quality (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.functions import outcomes
from cliplab.operators import quality, splits
from cliplab.operators.clips import multiclass_clips
from cliplab.operators.report import cv_summary
from cliplab.plans.manifests import CLIP_SPLIT_SQL, leaky_frames
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_MODE = """SELECT patient_id, {v} AS mode FROM (SELECT patient_id, {v}, row_number() OVER (PARTITION BY patient_id ORDER BY count(*) DESC, {v}) AS rn
   FROM {src} WHERE {v} IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"""


@query(
    "e01_modal_patient_label",
    sql("frames", f"""SELECT p.patient_id, coalesce(mode::VARCHAR, 'unknown') AS stratum FROM (SELECT DISTINCT patient_id FROM frames) p
        LEFT JOIN ({_MODE.format(v='lab', src='known')}) m ON p.patient_id = m.patient_id""",
        "known AS (SELECT patient_id, CASE WHEN frame_number % 3 <> 0 AND patient_id NOT LIKE '%7' THEN label END AS lab FROM frames)"),
)
def e01(v: Views) -> DataFrame:
    known = (F.col("frame_number") % 3 != 0) & ~F.col("patient_id").endswith("7")
    return splits.modal_label(v.frames().withColumn("label", F.when(known, F.col("label"))))


@query(
    "e02_dominant_size",
    sql("sized", f"""SELECT p.patient_id, coalesce(mode::VARCHAR, 'none') AS size_bin FROM (SELECT DISTINCT patient_id FROM sized) p
        LEFT JOIN ({_MODE.format(v='ulcer_size', src='sized')}) m ON p.patient_id = m.patient_id"""),
)
def e02(v: Views) -> DataFrame:
    return splits.dominant_size(v.sized_frames())


@query(
    "e03_presence_bin",
    sql("frames", "SELECT patient_id, CASE WHEN max(label) = 1 THEN 'ulcer' ELSE 'no_ulcer' END AS stratum FROM frames GROUP BY 1"),
)
def e03(v: Views) -> DataFrame:
    return splits.strata(v.frames(), "presence")


RATIO_BIN = "CASE WHEN avg(label) = 0 THEN 'no_ulcer' WHEN avg(label) < 0.40::DOUBLE THEN 'low_ulcer' ELSE 'high_ulcer' END"


@query("e04_ratio_bin", sql("frames", f"SELECT patient_id, {RATIO_BIN} AS stratum FROM frames GROUP BY 1"))
def e04(v: Views) -> DataFrame:
    return splits.strata(v.frames(), "ulcer_ratio")


@query(
    "e05_stratum_modes",
    sql("sized", f"""SELECT 'size' AS mode, coalesce(m.mode::VARCHAR, 'none') AS stratum, count(*) AS n FROM base b LEFT JOIN m ON b.patient_id = m.patient_id GROUP BY 2
        UNION ALL SELECT 'presence', presence, count(*) FROM base GROUP BY 2
        UNION ALL SELECT 'size_and_presence', presence || '__' || coalesce(m.mode::VARCHAR, 'none'), count(*) FROM base b LEFT JOIN m ON b.patient_id = m.patient_id GROUP BY 2
        UNION ALL SELECT 'ulcer_ratio', ratio_bin, count(*) FROM base GROUP BY 2""",
        f"base AS (SELECT patient_id, CASE WHEN max(label) = 1 THEN 'ulcer' ELSE 'no_ulcer' END AS presence, {RATIO_BIN} AS ratio_bin FROM sized GROUP BY 1)",
        f"m AS ({_MODE.format(v='ulcer_size', src='sized')})"),
)
def e05(v: Views) -> DataFrame:
    """All four modes from one read of the frames."""
    patients = splits.all_strata(v.sized_frames())
    long = patients.unpivot("patient_id", list(splits.STRAT_MODES), "mode", "stratum")
    return long.groupBy("mode", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e06_patient_profile",
    sql("frames", """SELECT patient_id, count(*) AS total_frames, sum(label)::BIGINT AS positive_frames, sum(1 - label)::BIGINT AS negative_frames,
        round(avg(label), 6) AS presence, count(DISTINCT clip_key) AS n_clips,
        CASE WHEN min(label) <> max(label) THEN 'mixed' WHEN max(label) = 1 THEN 'positive only' ELSE 'negative only' END AS patient_type FROM frames GROUP BY 1"""),
)
def e06(v: Views) -> DataFrame:
    return _rounded(quality.patient_profile(v.frames()))


@query("e06_patient_segments", sql("frames", "SELECT DISTINCT patient_id, segment_id FROM frames"))
def e06b(v: Views) -> DataFrame:
    return quality.patient_members(v.frames(), "segment_id")


@query(
    "e07_clip_summary",
    sql("sized", """SELECT clip_key, max(label) AS label_max, (avg(label) > 0.5)::INTEGER AS label_mode, count(*) AS n_frames, min(patient_id) AS patient_id,
        min(split) AS split, min(ulcer_size)::INTEGER AS ulcer_size FROM sized GROUP BY 1"""),
)
def e07(v: Views) -> DataFrame:
    frames = v.sized_frames()
    by_max = quality.clip_summary(frames, "max").withColumnRenamed("label", "label_max")
    by_mode = quality.clip_summary(frames, "mode").select("clip_key", F.col("label").alias("label_mode"))
    return by_max.join(by_mode, "clip_key")


@query(
    "e08_dataset_statistics",
    sql("frames", """SELECT * FROM (SELECT count(*) AS clips, sum((label = 1)::INTEGER)::BIGINT AS clips_positive, sum((label = 0)::INTEGER)::BIGINT AS clips_negative,
          round(avg(n), 6) AS frames_mean, round(stddev_samp(n), 6) AS frames_std, min(n) AS frames_min, max(n) AS frames_max, round(quantile_cont(n, 0.5), 6) AS frames_median,
          round(avg(n) / 10, 6) AS duration_s_mean, round(stddev_samp(n) / 10, 6) AS duration_s_std, round(min(n) / 10.0::DOUBLE, 6) AS duration_s_min,
          round(max(n) / 10.0::DOUBLE, 6) AS duration_s_max, round(quantile_cont(n, 0.5) / 10, 6) AS duration_s_median
        FROM (SELECT clip_key, max(label) AS label, count(*) AS n FROM frames GROUP BY 1)),
        (SELECT count(*) AS patients, sum(p)::BIGINT AS patients_positive, sum(1 - p)::BIGINT AS patients_negative FROM (SELECT patient_id, max(label) AS p FROM frames GROUP BY 1)),
        (SELECT count(*) AS frames, sum(label)::BIGINT AS frames_positive, sum(1 - label)::BIGINT AS frames_negative FROM frames)"""),
)
def e08(v: Views) -> DataFrame:
    return _rounded(quality.dataset_statistics(v.frames()))


@query(
    "e09_split_statistics",
    sql("frames", """SELECT f.*, c.n_clips, c.n_clips_positive, c.n_clips_negative FROM (
          SELECT split, count(DISTINCT patient_id) AS n_patients, count(*) AS n_frames, sum(label)::BIGINT AS n_frames_positive, sum(1 - label)::BIGINT AS n_frames_negative,
                 round(count(*) / (SELECT count(*) FROM frames)::DOUBLE * 100.0::DOUBLE, 6) AS pct_of_total FROM frames GROUP BY 1) f
        JOIN (SELECT split, count(*) AS n_clips, sum(label)::BIGINT AS n_clips_positive, sum(1 - label)::BIGINT AS n_clips_negative
              FROM (SELECT clip_key, min(split) AS split, max(label) AS label FROM frames GROUP BY 1) GROUP BY 1) c ON f.split = c.split"""),
)
def e09(v: Views) -> DataFrame:
    return _rounded(quality.split_statistics(v.frames()))


_SIZE_NAME = "CASE ulcer_size WHEN 1 THEN '<5mm' WHEN 2 THEN '5-20mm' WHEN 3 THEN '>20mm' ELSE 'unknown' END"


@query(
    "e09_size_distribution",
    sql("sized", f"""SELECT g.split, g.size, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / t.n::DOUBLE * 100.0::DOUBLE, 6) AS pct
        FROM (SELECT * FROM (VALUES ('train'), ('val'), ('test')) s(split), (VALUES ('<5mm'), ('5-20mm'), ('>20mm'), ('unknown')) z(size)) g
        LEFT JOIN (SELECT split, {_SIZE_NAME} AS size, count(*) AS n FROM clips GROUP BY 1, 2) c ON g.split = c.split AND g.size = c.size
        JOIN (SELECT split, count(*) AS n FROM clips GROUP BY 1) t ON g.split = t.split""",
        "clips AS (SELECT clip_key, min(split) AS split, max(label) AS label, min(ulcer_size) AS ulcer_size FROM sized GROUP BY 1 HAVING max(label) = 1)"),
)
def e09b(v: Views) -> DataFrame:
    return _rounded(quality.size_distribution(v.sized_frames()))


@query(
    "e10_video_summary",
    sql("frames", """SELECT video_id, count(*) AS frames, count(DISTINCT label) AS n_labels, count(DISTINCT segment_id) AS n_segments,
        string_agg(DISTINCT clip_split, ',' ORDER BY clip_split) AS split FROM leaky GROUP BY 1""", CLIP_SPLIT_SQL),
)
def e10(v: Views) -> DataFrame:
    return quality.video_summary(leaky_frames(v))


@query(
    "e11_clip_frame_summary",
    sql("frames", """SELECT clip_key, count(*) AS frames, any_value(video_id) AS video_id, arg_min(segment_id, k) AS segment_id, arg_min(label, k) AS label,
        any_value(split) AS split, min(frame_number) AS frame_min, max(frame_number) AS frame_max
        FROM (SELECT *, lpad(frame_number::VARCHAR, 9, '0') || relative_path AS k FROM frames) GROUP BY 1"""),
)
def e11(v: Views) -> DataFrame:
    return quality.clip_frame_summary(v.frames(rows=1_000_000))


@query(
    "e12_entity_counts",
    sql("frames", "SELECT count(DISTINCT video_id) AS videos, count(DISTINCT patient_id) AS patients, count(DISTINCT segment_id) AS segments, count(DISTINCT clip_key) AS clips FROM frames"),
)
def e12(v: Views) -> DataFrame:
    return quality.entity_counts(v.frames())


@query("e12_frames_per_split", sql("frames", "SELECT split, count(*) AS frames FROM frames GROUP BY 1"))
def e12b(v: Views) -> DataFrame:
    return quality.frames_per_split(v.frames())


@query(
    "e13_manifest_quality",
    sql("sized", """SELECT count(*) AS rows, sum((ulcer_size IS NULL)::INTEGER)::BIGINT AS missing_cells,
        count(*) - count(DISTINCT relative_path) AS duplicate_relative_path, count(*) - count(DISTINCT (video_id, segment_id, frame_number)) AS duplicate_clip_frame,
        8 AS expected_columns_present, 0 AS expected_columns_missing FROM sized"""),
)
def e13(v: Views) -> DataFrame:
    return quality.manifest_quality(v.sized_frames())


@query(
    "e13_missing_values",
    sql("sized", """SELECT 'ulcer_size' AS column_name, sum((ulcer_size IS NULL)::INTEGER)::BIGINT AS n_missing FROM sized
        UNION ALL SELECT 'label', sum((label IS NULL)::INTEGER)::BIGINT FROM sized UNION ALL SELECT 'clip_key', sum((clip_key IS NULL)::INTEGER)::BIGINT FROM sized"""),
)
def e13b(v: Views) -> DataFrame:
    return quality.missing_values(v.sized_frames().select("label", "clip_key", "ulcer_size"))


@query(
    "e14_label_shares",
    sql("frames", "SELECT split, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split)::DOUBLE, 6) AS share FROM frames GROUP BY 1, 2"),
)
def e14(v: Views) -> DataFrame:
    return _rounded(quality.label_shares(v.frames()))


@query(
    "e14_label_shift",
    sql("frames", """SELECT split, round(max(abs(g - s)), 4) AS label_shift FROM (
        SELECT a.split, l.label, l.n / (SELECT count(*) FROM frames)::DOUBLE AS g, coalesce(c.n, 0) / a.n::DOUBLE AS s
        FROM (SELECT split, count(*) AS n FROM frames GROUP BY 1) a CROSS JOIN (SELECT label, count(*) AS n FROM frames GROUP BY 1) l
        LEFT JOIN (SELECT split, label, count(*) AS n FROM frames GROUP BY 1, 2) c ON c.split = a.split AND c.label = l.label) GROUP BY 1"""),
)
def e14b(v: Views) -> DataFrame:
    return quality.label_shift(v.frames())


_MEMBERS = "members AS (SELECT DISTINCT patient_id, clip_split AS split FROM leaky)"


@query(
    "e14_patient_overlap",
    sql("frames", """SELECT g.a AS split_a, g.b AS split_b, coalesce(n, 0) AS n_shared FROM (SELECT * FROM (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) g(a, b)) g
        LEFT JOIN (SELECT a.split AS a, b.split AS b, count(*) AS n FROM members a JOIN members b ON a.patient_id = b.patient_id AND a.split < b.split GROUP BY 1, 2) c
        ON g.a = c.a AND g.b = c.b""", CLIP_SPLIT_SQL, _MEMBERS),
)
def e14c(v: Views) -> DataFrame:
    return quality.split_overlap(leaky_frames(v))


@query(
    "e14_overlap_examples",
    sql("frames", """SELECT * FROM (SELECT a.split AS split_a, b.split AS split_b, a.patient_id, row_number() OVER (PARTITION BY a.split, b.split ORDER BY a.patient_id)::INTEGER AS n
        FROM members a JOIN members b ON a.patient_id = b.patient_id AND a.split < b.split) WHERE n <= 10""", CLIP_SPLIT_SQL, _MEMBERS),
)
def e14d(v: Views) -> DataFrame:
    return quality.overlap_examples(leaky_frames(v))


@query(
    "e15_split_label_crosstab",
    sql("frames", "SELECT split, sum(1 - label)::BIGINT AS label_0, sum(label)::BIGINT AS label_1 FROM frames GROUP BY 1"),
)
def e15(v: Views) -> DataFrame:
    return quality.label_crosstab(v.frames())


_ROUTED = """routed AS (SELECT *, CASE WHEN abs(score_a - 0.5) < 0.1 THEN 'uncertain' WHEN score_a >= 0.5 THEN 'informative' ELSE 'non_informative' END AS category FROM frames)"""


def routed_frames(v: Views) -> DataFrame:
    return v.frames().withColumn("category", outcomes.route(F.col("score_a"), 0.5, 0.1))


@query(
    "e16_routing_statistics",
    sql("frames", """SELECT CASE WHEN grouping(video_id) = 1 THEN 'global' WHEN grouping(segment_id) = 1 THEN 'video' ELSE 'segment' END AS level, video_id, segment_id,
        count(*) AS total, sum((category = 'informative')::INTEGER)::BIGINT AS informative, sum((category = 'non_informative')::INTEGER)::BIGINT AS non_informative,
        sum((category = 'uncertain')::INTEGER)::BIGINT AS uncertain, round(avg((category = 'informative')::INTEGER), 4) AS inf_ratio FROM routed GROUP BY ROLLUP (video_id, segment_id)""", _ROUTED),
)
def e16(v: Views) -> DataFrame:
    return quality.routing_statistics(routed_frames(v))


@query(
    "e16_routing_summary",
    sql("frames", """SELECT count(*) AS total_frames, sum((category = 'informative')::INTEGER)::BIGINT AS kept_informative, sum((category = 'non_informative')::INTEGER)::BIGINT AS rejected_non_informative,
        sum((category = 'uncertain')::INTEGER)::BIGINT AS uncertain, round(avg((category = 'informative')::INTEGER), 4) AS kept_ratio, 0.1::DOUBLE AS epsilon, 0.5::DOUBLE AS threshold FROM routed""", _ROUTED),
)
def e16b(v: Views) -> DataFrame:
    return quality.routing_summary(routed_frames(v), 0.5, 0.1)


@query(
    "e17_video_retention",
    sql("frames", """SELECT video_id, sum((category = 'informative')::INTEGER)::BIGINT AS informative, sum((category = 'non_informative')::INTEGER)::BIGINT AS non_informative,
        sum((category = 'uncertain')::INTEGER)::BIGINT AS uncertain, count(*) AS total, round(avg((category = 'informative')::INTEGER), 6) AS kept_ratio FROM routed GROUP BY 1""", _ROUTED),
)
def e17(v: Views) -> DataFrame:
    return _rounded(quality.video_retention(routed_frames(v)))


@query(
    "e18_sample_level",
    sql("causes", """SELECT b.sample_id, n_frames, round(m, 4) AS mean_prob, (m >= 0.5)::INTEGER AS pred_label, pct AS noninf_frame_pct, true_label,
           ((m >= 0.5)::INTEGER = true_label)::INTEGER AS correct, coalesce(c.cause, '') AS cause
        FROM (SELECT sample_id, count(*) AS n_frames, round(avg(round(prob, 4)), 12) AS m, round(avg((prob < 0.4)::INTEGER), 4) AS pct,
                (avg(label) > 0.5)::INTEGER AS true_label FROM causes GROUP BY 1) b
        LEFT JOIN (SELECT sample_id, cause FROM (SELECT sample_id, cause, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, cause) AS rn
                   FROM causes WHERE cause IS NOT NULL GROUP BY 1, 2) WHERE rn = 1) c ON b.sample_id = c.sample_id"""),
)
def e18(v: Views) -> DataFrame:
    scored = v.causes().withColumns({"pred_prob": F.col("prob"), "pred_label": (F.col("prob") >= 0.4).cast("int")})
    return quality.sample_level(scored)


_DUR = """round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max, round(sum(d), 4) AS total, count(*) AS count, round(quantile_cont(d, 0.5), 6) AS median"""


def _durations(df: DataFrame) -> DataFrame:
    return _rounded(df.withColumn("total", F.round("total", 4)))


@query(
    "e19_duration_statistics",
    sql("windows", f"SELECT record_id, {_DUR} FROM (SELECT record_id, end_s - start_s AS d FROM windows) GROUP BY 1"),
)
def e19(v: Views) -> DataFrame:
    w = v.windows().withColumn("duration_s", F.col("end_s") - F.col("start_s"))
    return _durations(quality.duration_statistics(w, ["record_id"]))


@query(
    "e20_stage_statistics",
    sql("frames", f"""SELECT class_name, {_DUR.replace('count(*) AS count', 'count(*) AS clips')}, sum(n)::BIGINT AS frames FROM (
          SELECT class_name, n, n / 10.0::DOUBLE AS d FROM c UNION ALL SELECT '_total', n, n / 10.0::DOUBLE FROM c) GROUP BY 1""",
        "c AS (SELECT class_name, video_id, segment_id, count(*) AS n FROM frames GROUP BY 1, 2, 3)"),
)
def e20(v: Views) -> DataFrame:
    return _durations(quality.stage_statistics(v.frames().select("relative_path"), 10.0))


@query(
    "e21_window_durations",
    sql("windows", f"""SELECT label_name, {_DUR} FROM (SELECT CASE label WHEN 1 THEN 'Ulcer' ELSE 'NonUlcer' END AS label_name, end_s - start_s AS d FROM windows
        UNION ALL SELECT '_total', end_s - start_s FROM windows) GROUP BY 1"""),
)
def e21(v: Views) -> DataFrame:
    return _durations(quality.window_durations(v.windows(), {1: "Ulcer", 0: "NonUlcer"}))


@query(
    "e22_class_weights",
    """SELECT c.i::INTEGER AS class_id, coalesce(n, 0) AS n, round(CASE WHEN n IS NULL THEN 1.0 ELSE (SELECT count(*) FROM embeddings) / (12.0::DOUBLE * n) END, 9) AS weight
       FROM range(12) c(i) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) l ON c.i = l.label""",
)
def e22(v: Views) -> DataFrame:
    return _rounded(splits.class_weights(v.table("embeddings"), 12), 9)


@query(
    "e23_image_statistics",
    """SELECT measure, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, count(DISTINCT x) AS n_unique FROM (
         SELECT unnest(['width', 'height', 'aspect_ratio', 'file_size_kb']) AS measure,
                unnest([l_quantity, l_linenumber::DOUBLE, l_quantity / l_linenumber, l_extendedprice]) AS x FROM lineitem) GROUP BY 1""",
)
def e23(v: Views) -> DataFrame:
    images = v.table("lineitem").select(
        F.col("l_quantity").alias("width"), F.col("l_linenumber").alias("height"), F.col("l_extendedprice").alias("file_size_kb")
    )
    return _rounded(quality.image_statistics(images), 4)


@query(
    "e24_clip_length_histogram",
    sql("frames", """SELECT least(24, floor((n - lo) / ((hi - lo) / 25.0::DOUBLE)))::INTEGER AS bin, count(*) AS n,
        round(lo + least(24, floor((n - lo) / ((hi - lo) / 25.0::DOUBLE))) * ((hi - lo) / 25.0::DOUBLE), 6) AS lower,
        round(lo + (least(24, floor((n - lo) / ((hi - lo) / 25.0::DOUBLE))) + 1) * ((hi - lo) / 25.0::DOUBLE), 6) AS upper
        FROM c, (SELECT min(n) AS lo, max(n) AS hi FROM c) GROUP BY 1, 3, 4""", "c AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1)"),
)
def e24(v: Views) -> DataFrame:
    sizes = v.frames().groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))
    return _rounded(quality.histogram(sizes, "frames", 25))


@query(
    "e24_five_numbers",
    sql("frames", """SELECT label, round(min(frame_number)::DOUBLE, 6) AS q0, round(quantile_cont(frame_number, 0.25), 6) AS q25, round(quantile_cont(frame_number, 0.5), 6) AS q50,
        round(quantile_cont(frame_number, 0.75), 6) AS q75, round(max(frame_number)::DOUBLE, 6) AS q100 FROM frames GROUP BY 1"""),
)
def e24b(v: Views) -> DataFrame:
    return _rounded(quality.five_numbers(v.frames(), ["label"], "frame_number"))


@query(
    "e25_patient_types",
    sql("frames", """SELECT patient_type, count(*) AS n FROM (SELECT CASE WHEN min(label) <> max(label) THEN 'mixed' WHEN max(label) = 1 THEN 'positive only' ELSE 'negative only' END AS patient_type
        FROM frames GROUP BY patient_id) GROUP BY 1"""),
)
def e25(v: Views) -> DataFrame:
    return quality.patient_profile(v.frames()).groupBy("patient_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e26_strata_counts",
    sql("frames", f"SELECT stratum, count(*) AS n, count(*) < 8 AS rare FROM (SELECT patient_id, {RATIO_BIN} AS stratum FROM frames GROUP BY 1) GROUP BY 1"),
)
def e26(v: Views) -> DataFrame:
    limit = splits.effective_rare_threshold(0.15)
    return quality.strata_counts(splits.strata(v.frames(), "ulcer_ratio"), limit)


@query(
    "e28_cause_breakdown",
    sql("causes", "SELECT coalesce(cause, 'Unknown') AS cause, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM causes WHERE label = 0 GROUP BY 1"),
)
def e28(v: Views) -> DataFrame:
    return _rounded(quality.cause_breakdown(v.causes()))


@query(
    "e28_strata_by_split",
    sql("causes", """SELECT coalesce(stratum, 'Total') AS stratum, coalesce(split, 'Total') AS split, count(*) AS n FROM (
        SELECT split, CASE WHEN label = 1 THEN 'Informative' WHEN trim(coalesce(cause, '')) = '' THEN 'Non-Informative' ELSE 'Non-Informative / ' || trim(cause) END AS stratum FROM causes)
        GROUP BY CUBE (stratum, split)"""),
)
def e28b(v: Views) -> DataFrame:
    return quality.strata_table(v.causes())


@query(
    "e29_cv_summary",
    sql("predictions", """SELECT model, metric, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS n_folds FROM (
        SELECT model, fold, unnest(['mean_prob', 'accuracy']) AS metric, unnest([avg(prob), avg(((prob >= 0.5)::INTEGER = label)::INTEGER)]) AS x FROM predictions GROUP BY 1, 2) GROUP BY 1, 2"""),
)
def e29(v: Views) -> DataFrame:
    hit = ((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("int")
    folds = v.predictions().groupBy("model", "fold").agg(F.avg("prob").alias("mean_prob"), F.avg(hit).alias("accuracy"))
    return _rounded(cv_summary(folds, ["model"], ["mean_prob", "accuracy"]))


@query(
    "e30_tracking_info",
    sql("frames", "SELECT split, count(*) AS n, sum(label)::BIGINT AS n_positive, round(avg(label), 4) AS pos_ratio FROM frames GROUP BY 1"),
)
def e30(v: Views) -> DataFrame:
    return quality.tracking_info(v.frames())


@query(
    "e30_size_totals",
    sql("sized", "SELECT coalesce(ulcer_size::VARCHAR, 'total') AS size, count(*) AS n FROM sized WHERE ulcer_size IS NOT NULL GROUP BY ROLLUP (ulcer_size)"),
)
def e30b(v: Views) -> DataFrame:
    return quality.size_totals(v.sized_frames())


@query(
    "e31_stage_funnel",
    sql("frames", """SELECT stage_no, stage, n, greatest(0, lag(n) OVER w - n) AS removed, round(n / lag(n) OVER w::DOUBLE, 6) AS kept_ratio FROM (
        SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS n FROM frames UNION ALL SELECT 1, 'processed', count(*) FROM frames WHERE score_b >= 0.05
        UNION ALL SELECT 2, 'kept', count(*) FROM frames WHERE score_b >= 0.3) WINDOW w AS (ORDER BY stage_no)"""),
)
def e31(v: Views) -> DataFrame:
    f = v.frames()
    stages = [("raw", f), ("processed", f.filter(F.col("score_b") >= 0.05)), ("kept", f.filter(F.col("score_b") >= 0.3))]
    return _rounded(quality.stage_funnel(stages))


@query(
    "e32_fold_ensemble",
    sql("predictions", """SELECT model, clip_key, round(avg(prob), 9) AS prob, max(label) AS label, count(*) AS n_folds FROM predictions GROUP BY 1, 2"""),
)
def e32(v: Views) -> DataFrame:
    """Mean over repeated scores of one item; clips stand for items that several folds score."""
    return _rounded(quality.ensemble(v.predictions(rows=1_000_000), ["model", "clip_key"]), 9)


_VEC = "e AS (SELECT vec_id, label, x, i FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@query(
    "e33_multiclass_clips",
    f"""WITH {_VEC}, m AS (SELECT label % 4 AS clip, i - 1 AS class_id, round(avg(x), 12) AS p FROM e GROUP BY 1, 2),
        lab AS (SELECT clip, label FROM (SELECT label % 4 AS clip, label, row_number() OVER (PARTITION BY label % 4 ORDER BY count(*) DESC, label) AS rn FROM embeddings GROUP BY 1, 2) WHERE rn = 1)
       SELECT m.clip, (SELECT class_id FROM m b WHERE b.clip = m.clip ORDER BY p DESC, class_id LIMIT 1)::INTEGER AS pred, round(max(p), 9) AS top_prob, any_value(lab.label) AS label
       FROM m JOIN lab ON m.clip = lab.clip GROUP BY 1""",
)
def e33(v: Views) -> DataFrame:
    rows = v.table("embeddings").select((F.col("label") % 4).alias("clip"), "label", F.col("embedding").cast("array<double>").alias("probs"))
    return _rounded(multiclass_clips(rows, ["clip"]), 9)


@query(
    "e34_vector_moments",
    f"""WITH {_VEC}, c AS (SELECT vec_id, x, avg(x) OVER (PARTITION BY vec_id) AS m FROM e)
       SELECT vec_id, round(max(m), 7) AS mean, round(avg((x - m) ** 2), 7) AS var, round(avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5, 7) AS skew,
              round(avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3, 7) AS kurt FROM c GROUP BY 1""",
)
def e34(v: Views) -> DataFrame:
    moments = v.table("embeddings").select("vec_id", outcomes.vector_moments(F.col("embedding")).alias("m"))
    return _rounded(moments.select("vec_id", "m.*"), 7)


@query(
    "e35_histogram_entropy",
    sql("frames", """SELECT video_id, round(-sum(p * log2(p + 1e-9::DOUBLE)) / log2(36), 7) AS entropy FROM (
        SELECT video_id, count(*) / (sum(count(*)) OVER (PARTITION BY video_id) + 1e-9::DOUBLE) AS p FROM frames GROUP BY video_id, least(35, floor(score_b / (1.0::DOUBLE / 36))) ) GROUP BY 1"""),
)
def e35(v: Views) -> DataFrame:
    return _rounded(quality.histogram_entropy(v.frames(), ["video_id"], "score_b", 0.0, 1.0), 7)


# Weights of the composite score.
SCORE_WEIGHTS = {"circle": 0.35, "contour": 0.25, "highlight": 0.20, "local_var": 1.0, "entropy": 0.10}


@query(
    "e36_composite_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0, least(1.0, 0.35::DOUBLE * (l_discount * 10) + 0.25::DOUBLE * (l_quantity / 50) + 0.20::DOUBLE * least(l_tax / 0.05::DOUBLE, 1.0)
         + 0.10::DOUBLE * l_tax / 0.10::DOUBLE + 0.10::DOUBLE * (l_linenumber / 7.0::DOUBLE))), 9) AS score FROM lineitem""",
)
def e36(v: Views) -> DataFrame:
    values = {
        "circle": F.col("l_discount") * 10, "contour": F.col("l_quantity") / 50, "highlight": F.col("l_tax"),
        "local_var": F.col("l_tax"), "entropy": F.col("l_linenumber") / F.lit(7.0),
    }
    score = outcomes.weighted_score(values, SCORE_WEIGHTS, {"highlight": 0.05})
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 9).alias("score"))
