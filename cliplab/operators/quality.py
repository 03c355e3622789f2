"""Dataset statistics, quality checks and split diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.functions import parse
from cliplab.operators.ranking import exact_quantiles, join_on, modal_value
from cliplab.schema import SIZE_DISPLAY, SPLITS

# The columns of a manifest that the quality report looks for.
EXPECTED_COLUMNS = (
    "relative_path", "label", "video_id", "patient_id", "segment_id", "frame_number", "clip_key", "split",
)


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


# ------------------------------------------------------------------ profiles


def patient_profile(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Counts, class flags and positive share per patient, with the mixed / one-class type."""
    pos, neg = count_if(F.col("label") == 1), count_if(F.col("label") != 1)
    out = df.groupBy(patient).agg(
        F.count(F.lit(1)).alias("total_frames"),
        pos.alias("positive_frames"),
        neg.alias("negative_frames"),
        (pos / F.count(F.lit(1))).alias("presence"),
        F.count_distinct("clip_key").alias("n_clips"),
    )
    kind = (
        F.when((F.col("positive_frames") > 0) & (F.col("negative_frames") > 0), "mixed")
        .when(F.col("positive_frames") > 0, "positive only")
        .otherwise("negative only")
    )
    return out.withColumn("patient_type", kind)


def patient_members(df: DataFrame, member: str, patient: str = "patient_id") -> DataFrame:
    """Distinct segments / samples / causes of each patient as rows (a patient may have any number)."""
    return df.filter(F.col(member).isNotNull() & (F.col(member) != "")).select(patient, member).distinct()


def clip_summary(df: DataFrame, label_rule: str = "max", clip: str = "clip_key") -> DataFrame:
    """(clip, label, n_frames, patient_id, split, ulcer_size) with label by maximum or mode."""
    aggs = [F.count("label").alias("n_frames"), F.min("patient_id").alias("patient_id")]
    if "split" in df.columns:
        aggs.append(F.min("split").alias("split"))
    if "ulcer_size" in df.columns:
        aggs.append(F.min("ulcer_size").alias("ulcer_size"))
    if label_rule == "max":
        return df.groupBy(clip).agg(F.max("label").alias("label"), *aggs)
    return join_on(df.groupBy(clip).agg(*aggs), modal_value(df, [clip], "label", "label"), [clip])


def dataset_statistics(df: DataFrame, fps: float = 10.0) -> DataFrame:
    """One row: patients, clips and frames per class, frames per clip and clip duration."""
    clips = clip_summary(df)
    # a label's patients: one row per patient, so hot patients are combined before the shuffle
    patients = df.groupBy("patient_id").agg(F.max("label").alias("has_pos")).agg(
        F.count(F.lit(1)).alias("patients"),
        count_if(F.col("has_pos") == 1).alias("patients_positive"),
        count_if(F.col("has_pos") != 1).alias("patients_negative"),
    )
    n = F.col("n_frames")
    clip_stats = clips.agg(
        F.count(F.lit(1)).alias("clips"),
        count_if(F.col("label") == 1).alias("clips_positive"),
        count_if(F.col("label") == 0).alias("clips_negative"),
        F.avg(n).alias("frames_mean"),
        F.stddev_samp(n).alias("frames_std"),
        F.min(n).alias("frames_min"),
        F.max(n).alias("frames_max"),
        F.percentile(n, F.lit(0.5)).alias("frames_median"),  # clip lengths have few distinct values
    )
    frames = df.agg(
        F.count(F.lit(1)).alias("frames"),
        count_if(F.col("label") == 1).alias("frames_positive"),
        count_if(F.col("label") == 0).alias("frames_negative"),
    )
    out = join_on(join_on(clip_stats, patients, []), frames, [])
    stats = ("mean", "std", "min", "max", "median")
    return out.withColumns({f"duration_s_{s}": F.col(f"frames_{s}") / F.lit(float(fps)) for s in stats})


def split_statistics(df: DataFrame) -> DataFrame:
    """Per split: patients, clips and frames per class, share of all frames."""
    frames = df.groupBy("split").agg(
        F.count_distinct("patient_id").alias("n_patients"),
        F.count(F.lit(1)).alias("n_frames"),
        count_if(F.col("label") == 1).alias("n_frames_positive"),
        count_if(F.col("label") == 0).alias("n_frames_negative"),
    )
    clips = clip_summary(df).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_clips"),
        count_if(F.col("label") == 1).alias("n_clips_positive"),
        count_if(F.col("label") == 0).alias("n_clips_negative"),
    )
    # one row per split: the window is tiny
    share = F.col("n_frames") / F.sum("n_frames").over(Window.partitionBy()) * 100.0
    return join_on(frames, clips, ["split"]).withColumn("pct_of_total", share)


def size_distribution(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Positive clips per split and size label, zero-filled, with the share of the split's positive clips."""
    clips = clip_summary(df).filter(F.col("label") == 1).withColumn("size", parse.size_label(F.col("ulcer_size")))
    counts = clips.groupBy("split", "size").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split")).select(
        "split", F.explode(F.array(*[F.lit(s) for s in SIZE_DISPLAY])).alias("size")
    )
    filled = grid.join(counts, ["split", "size"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("split"))
    return filled.withColumn("pct", F.coalesce(F.col("n") / F.nullif(total, F.lit(0)) * 100.0, F.lit(0.0)))


def video_summary(df: DataFrame) -> DataFrame:
    """Frames, label and segment counts per video, with the list of splits it occurs in."""
    names = [F.when(F.bool_or(F.col("split") == s), s) for s in sorted(SPLITS)]
    return df.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_distinct("label").alias("n_labels"),
        F.count_distinct("segment_id").alias("n_segments"),
        F.concat_ws(",", *names).alias("split"),
    )


def clip_frame_summary(df: DataFrame, tie: Sequence[str] = ("relative_path",)) -> DataFrame:
    """Frames, frame range and the first row's video, segment, label and split per clip."""
    first = F.min_by(
        F.struct("video_id", "segment_id", "label", "split"), F.struct("frame_number", *tie)
    ).alias("f")
    return df.groupBy("clip_key").agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame_number").alias("frame_min"), F.max("frame_number").alias("frame_max"), first
    ).select("clip_key", "frames", "f.*", "frame_min", "frame_max")


def entity_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct videos, patients, segments (over the whole table) and clips."""
    def distinct(c: str) -> Column:
        return F.approx_count_distinct(c) if approximate else F.count_distinct(c)

    return df.agg(
        distinct("video_id").alias("videos"), distinct("patient_id").alias("patients"),
        distinct("segment_id").alias("segments"), distinct("clip_key").alias("clips"),
    )


def frames_per_split(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("frames"))


# -------------------------------------------------------------------- checks


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, n_missing) in one pass over the table."""
    one = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in df.columns])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def duplicate_excess(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: rows beyond the first of each key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))


def manifest_quality(df: DataFrame) -> DataFrame:
    """One row: rows, duplicated paths, duplicated (video, segment, frame), missing cells and expected columns."""
    keys = ["video_id", "segment_id", "frame_number"]
    zero = F.lit(0).cast("bigint")
    present = [c for c in EXPECTED_COLUMNS if c in df.columns]
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), zero).alias("missing_cells"))
    for name, cols in (("duplicate_relative_path", ["relative_path"]), ("duplicate_clip_frame", keys)):
        if all(c in df.columns for c in cols):
            out = join_on(out, duplicate_excess(df, cols, name), [])
        else:
            out = out.withColumn(name, zero)
    return out.withColumns(
        {
            "expected_columns_present": F.lit(len(present)),
            "expected_columns_missing": F.lit(len(EXPECTED_COLUMNS) - len(present)),
        }
    )


def label_crosstab(df: DataFrame, classes: Sequence[int] = (0, 1), row: str = "split") -> DataFrame:
    return df.groupBy(row).agg(*[count_if(F.col("label") == c).alias(f"label_{c}") for c in classes])


def label_shares(df: DataFrame) -> DataFrame:
    """(split, label, n, share): label mix of each split."""
    counts = df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def label_shift(df: DataFrame) -> DataFrame:
    """(split, label_shift): largest absolute difference between split and global label shares, 4 digits."""
    counts = df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy("label").agg(F.sum("n").alias("all_n"))
    # one array entry per class, attached to one row per split
    classes = overall.agg(F.collect_list(F.struct("label", "all_n"))).scalar()
    splits = counts.groupBy("split").agg(F.sum("n").alias("split_n")).withColumn("__c", classes)
    grid = splits.select("split", "split_n", F.explode("__c").alias("__o")).select("split", "split_n", "__o.*")
    full = join_on(grid, counts, ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    everything = F.sum("all_n").over(Window.partitionBy("split"))
    return (
        full.withColumn("__d", F.abs(F.col("all_n") / everything - F.col("n") / F.col("split_n")))
        .groupBy("split")
        .agg(F.round(F.max("__d"), 4).alias("label_shift"))
    )


def split_overlap(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """(split_a, split_b, n_shared) for each pair of splits, zero included."""
    members = df.filter(F.col(patient).isNotNull()).select(F.col(patient).cast("string").alias("p"), "split").distinct()
    pairs = members.alias("a").join(members.alias("b"), F.col("a.p") == F.col("b.p")).filter("a.split < b.split")
    shared = pairs.groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(
        F.count(F.lit(1)).alias("n_shared")
    )
    names = df.agg(F.array_sort(F.collect_set("split")).alias("s"))
    pair_list = F.flatten(
        F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b"))))
    )
    grid = names.select(F.explode(pair_list).alias("g")).select("g.*")
    return join_on(grid, shared, ["split_a", "split_b"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))


def overlap_examples(df: DataFrame, n: int = 10, patient: str = "patient_id") -> DataFrame:
    """First n shared ids per pair of splits (the limit is pushed below the shuffle)."""
    members = df.filter(F.col(patient).isNotNull()).select(F.col(patient).cast("string").alias("p"), "split").distinct()
    pairs = members.alias("a").join(members.alias("b"), F.col("a.p") == F.col("b.p")).filter("a.split < b.split").select(
        F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"), F.col("a.p").alias(patient)
    )
    w = Window.partitionBy("split_a", "split_b").orderBy(patient)
    return pairs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def shared_patients(df: DataFrame, a: str, b: str, patient: str = "patient_id") -> DataFrame:
    ids = [df.filter(F.col("split") == s).select(patient) for s in (a, b)]
    return ids[0].intersect(ids[1])


def one_class_patients(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients with negative frames and no positive frame."""
    neg = df.filter(F.col("label") == 0).select(patient).distinct()
    return neg.join(df.filter(F.col("label") == 1).select(patient), patient, "left_anti")


# ------------------------------------------------------------------- routing


def routing_statistics(routed: DataFrame, video: str = "video_id", segment: str = "segment_id") -> DataFrame:
    """Counts per category and informative share: overall, per video, per segment."""
    # combine to (video, segment, category) first, then roll the small table up
    base = routed.groupBy(video, segment).agg(
        F.count(F.lit(1)).alias("__t"),
        *[count_if(F.col("category") == c).alias(f"__{c}") for c in ("informative", "non_informative", "uncertain")],
    )
    total = F.sum("__t")
    return base.rollup(video, segment).agg(
        F.grouping_id().alias("__gid"),
        total.alias("total"),
        F.sum("__informative").alias("informative"),
        F.sum("__non_informative").alias("non_informative"),
        F.sum("__uncertain").alias("uncertain"),
        F.round(F.sum("__informative") / total, 4).alias("inf_ratio"),
    ).withColumn(
        "level", F.when(F.col("__gid") == 3, "global").when(F.col("__gid") == 1, "video").otherwise("segment")
    ).drop("__gid")


def video_retention(routed: DataFrame, video: str = "video_id") -> DataFrame:
    """Category counts and informative / max(total, 1) per video."""
    cats = ("informative", "non_informative", "uncertain")
    out = routed.groupBy(video).agg(*[count_if(F.col("category") == c).alias(c) for c in cats])
    total = sum((F.col(c) for c in cats), F.lit(0))
    return out.withColumn("total", total).withColumn("kept_ratio", F.col("informative") / F.greatest(F.col("total"), F.lit(1)))


def routing_summary(routed: DataFrame, threshold: float, epsilon: float = 0.0) -> DataFrame:
    """One row of routing totals, as written next to a routing log."""
    total = F.count(F.lit(1))
    return routed.agg(
        total.alias("total_frames"),
        count_if(F.col("category") == "informative").alias("kept_informative"),
        count_if(F.col("category") == "non_informative").alias("rejected_non_informative"),
        count_if(F.col("category") == "uncertain").alias("uncertain"),
        F.round(count_if(F.col("category") == "informative") / F.greatest(total, F.lit(1)), 4).alias("kept_ratio"),
    ).withColumns({"epsilon": F.lit(float(epsilon)), "threshold": F.lit(float(threshold))})


def sample_level(scored: DataFrame, threshold: float = 0.5, sample: str = "sample_id") -> DataFrame:
    """Mean probability, decision, rejected share, modal truth and cause per sample.

    Probabilities are rounded to 4 digits before the mean.
    """
    base = scored.groupBy(sample).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.round(F.avg(F.round("pred_prob", 4)), 12).alias("__m"),
        F.round(F.avg(F.when(F.col("pred_label") == 0, 1.0).otherwise(0.0)), 4).alias("noninf_frame_pct"),
    )
    out = base.select(
        sample, "n_frames", F.round("__m", 4).alias("mean_prob"),
        (F.col("__m") >= F.lit(float(threshold))).cast("int").alias("pred_label"), "noninf_frame_pct",
    )
    if "label" in scored.columns:
        truth = modal_value(scored, [sample], "label", "true_label")
        out = join_on(out, truth, [sample], "left").withColumn(
            "correct", (F.col("pred_label") == F.col("true_label")).cast("int")
        )
    if "cause" in scored.columns:
        cause = modal_value(scored, [sample], "cause", "cause")
        out = join_on(out, cause, [sample], "left").withColumn("cause", F.coalesce("cause", F.lit("")))
    return out


# ----------------------------------------------------------------- durations


def duration_statistics(df: DataFrame, groups: Sequence[str], value: str = "duration_s") -> DataFrame:
    """mean, population std, min, max, median, total and count of a duration."""
    base = df.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.sum(value).alias("total"), F.count(value).alias("count"),
    )
    return join_on(base, exact_quantiles(df, groups, value, {"median": 0.5}), groups, "left")


def with_total(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows plus a copy under the group name '_total', so that totals are one more group."""
    both = F.explode(F.array(F.col(group), F.lit("_total")))
    return df.select(both.alias(group), value)


def stage_statistics(listing: DataFrame, fps: float, relative: str = "relative_path") -> DataFrame:
    """Frames, clips and clip durations per class folder of class/video/clip/file paths, with '_total'."""
    parts = F.split(F.col(relative), "/")
    files = listing.filter((F.size(parts) == 4) & parse.is_media_file(F.col(relative), (".jpg", ".jpeg", ".png", ".bmp")))
    clips = files.groupBy(
        F.get(parts, 0).alias("class_name"), F.get(parts, 1).alias("video"), F.get(parts, 2).alias("clip")
    ).agg(F.count(F.lit(1)).alias("n"))
    clips = with_total(clips.withColumn("duration_s", F.col("n") / F.lit(float(fps))), "class_name", "duration_s")
    stats = duration_statistics(clips, ["class_name"])
    return stats.withColumn("frames", F.bround(F.col("total") * F.lit(float(fps)), 0).cast("bigint")).withColumnRenamed(
        "count", "clips"
    )


def window_durations(windows: DataFrame, names: dict[int, str]) -> DataFrame:
    """Annotation-window durations per label and in total."""
    named = windows.select(
        parse._lookup(names, F.col("label")).alias("label_name"), (F.col("end_s") - F.col("start_s")).alias("duration_s")
    )
    return duration_statistics(with_total(named, "label_name", "duration_s"), ["label_name"])


def image_statistics(images: DataFrame) -> DataFrame:
    """Size statistics of a table (width, height, file_size_kb, mode): one row per measure."""
    table = images.withColumn("aspect_ratio", F.when(F.col("height") == 0, 0.0).otherwise(F.col("width") / F.col("height")))
    measures = ("width", "height", "aspect_ratio", "file_size_kb")
    long = table.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("p")
    ).select("p.*")
    return long.groupBy("measure").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count_distinct("v").alias("n_unique"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lower, upper, n): equal bins between minimum and maximum, the last one closed."""
    lo, hi = df.agg(F.min(value).cast("double")).scalar(), df.agg(F.max(value).cast("double")).scalar()
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.floor((F.col("v") - F.col("lo")) / width))
    return (
        df.select(F.col(value).cast("double").alias("v"), lo.alias("lo"), hi.alias("hi"))
        .filter("v is not null")
        .groupBy(F.least(F.lit(bins - 1), at).cast("int").alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "n")
    )


def five_numbers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group, exact and without collecting a group."""
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    return exact_quantiles(df, groups, value, probs)


# -------------------------------------------------------------------- strata


def strata_counts(strata: DataFrame, effective_threshold: int) -> DataFrame:
    """(stratum, n, rare): rare against the threshold the split really applies."""
    return strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).withColumn("rare", F.col("n") < effective_threshold)


def cause_breakdown(df: DataFrame) -> DataFrame:
    """(cause, n, share) of negative rows; a missing cause counts as Unknown."""
    counts = df.filter(F.col("label") == 0).groupBy(F.coalesce("cause", F.lit("Unknown")).alias("cause")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def strata_table(df: DataFrame) -> DataFrame:
    """class x cause x split counts with totals on both sides."""
    cause = F.trim(F.coalesce("cause", F.lit("")))
    name = F.when(F.col("label") == 1, "Informative").when(cause == "", "Non-Informative").otherwise(
        F.concat(F.lit("Non-Informative / "), cause)
    )
    base = df.groupBy(name.alias("stratum"), "split").agg(F.count(F.lit(1)).alias("__n"))
    out = base.cube("stratum", "split").agg(F.sum("__n").alias("n"))
    return out.select(F.coalesce("stratum", F.lit("Total")).alias("stratum"), F.coalesce("split", F.lit("Total")).alias("split"), "n")


def tracking_info(df: DataFrame) -> DataFrame:
    """Per split: rows, positives and positive share (4 digits)."""
    n, pos = F.count(F.lit(1)), count_if(F.col("label") == 1)
    return df.groupBy("split").agg(n.alias("n"), pos.alias("n_positive"), F.round(pos / n, 4).alias("pos_ratio"))


def size_totals(df: DataFrame, size: str = "ulcer_size") -> DataFrame:
    """Rows per size and in total; rows without size do not count."""
    base = df.filter(F.col(size).isNotNull()).groupBy(F.col(size).cast("string").alias("size")).agg(F.count(F.lit(1)).alias("__n"))
    return base.rollup("size").agg(F.sum("__n").alias("n")).withColumn("size", F.coalesce("size", F.lit("total")))


def stage_funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(stage_no, stage, n, removed, kept_ratio) over consecutive item tables."""
    counted = None
    for i, (name, items) in enumerate(stages):
        one = items.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n")
        counted = one if counted is None else counted.unionByName(one)
    before = F.lag("n").over(Window.orderBy("stage_no"))  # one row per stage
    return counted.withColumn("__b", before).select(
        "stage_no", "stage", "n",
        F.greatest(F.lit(0), F.col("__b") - F.col("n")).alias("removed"),
        F.when(F.col("__b").isNotNull(), F.coalesce(F.col("n") / F.nullif("__b", F.lit(0)), F.lit(0.0))).alias("kept_ratio"),
    )


def histogram_entropy(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int = 36) -> DataFrame:
    """(keys, entropy): Shannon entropy of a value histogram divided by log2(bins)."""
    inside = df.filter(F.col(value).between(lo, hi))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / F.lit((hi - lo) / bins)))
    counts = inside.groupBy(*keys, b.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    packed = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"), F.collect_list("__n").alias("__ns"))  # <= bins values
    p = lambda n: n / (F.col("__t") + 1e-9)
    summed = F.aggregate("__ns", F.lit(0.0), lambda acc, n: acc + p(n) * F.log2(p(n) + 1e-9))
    return packed.select(*keys, (-summed / F.log2(F.lit(float(bins)))).alias("entropy"))


def ensemble(predictions: DataFrame, keys: Sequence[str] = ("model", "frame_id")) -> DataFrame:
    """Mean probability over folds per model and item, with the item's label and clip.

    Where the clip is a key itself, only numbers are combined: Spark hashes these and needs no sort of all rows for them.
    """
    clip = [] if "clip_key" in keys else [F.min("clip_key").alias("clip_key")]
    return predictions.groupBy(*keys).agg(
        F.avg("prob").alias("prob"), F.max("label").alias("label"), *clip, F.count(F.lit(1)).alias("n_folds")
    )
