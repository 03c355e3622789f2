"""Leakage-safe splits, folds and stratified subsets.

Assignments are exact functions of (seed, id): ids are ordered by a seeded
digest inside their stratum and cut by integer quotas.  Quotas come from the
strata counts, a table with one row per stratum.  Strata can hold any share of
the ids: ranking works on digest buckets, not on whole strata.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplab.functions.hashing import seeded_digest
from cliplab.operators.ranking import attach_by_group, group_rank, join_by_entity, join_on, modal_value, range_buckets
from cliplab.session import cut_lineage
from cliplab.schema import require_columns

# The names of the modes.
STRAT_MODES = ("size", "presence", "size_and_presence", "ulcer_ratio")

# ------------------------------------------------------------------- strata


def patient_profile(df: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """One grouped pass per patient: frames, positives, label ratio and the presence / ratio bins."""
    ratio = F.avg(label)
    return df.groupBy(F.col(patient).cast("string").alias(patient)).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
        ratio.alias("label_ratio"),
        F.when(F.max(F.when(F.col(label) == 1, 1).otherwise(0)) == 1, "ulcer").otherwise("no_ulcer").alias("presence_bin"),
        F.when(ratio == 0, "no_ulcer").when(ratio < 0.40, "low_ulcer").otherwise("high_ulcer").alias("ratio_bin"),
    )


def modal_label(df: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """(patient, stratum): most frequent label as text, lowest on ties, 'unknown' without labels."""
    keyed = df.withColumn(patient, F.col(patient).cast("string"))
    modes = modal_value(keyed, [patient], label, "__m")
    everyone = keyed.select(patient).distinct()
    return join_on(everyone, modes, [patient], "left").select(
        patient, F.coalesce(F.col("__m").cast("int").cast("string"), F.lit("unknown")).alias("stratum")
    )


def dominant_size(df: DataFrame, patient: str = "patient_id", label: str = "label", size: str = "ulcer_size") -> DataFrame:
    """(patient, size_bin): most frequent size among positive rows, 'none' if there is none."""
    keyed = df.withColumn(patient, F.col(patient).cast("string"))
    positive = keyed.withColumn("__s", F.when(F.col(label) == 1, F.col(size)))
    modes = modal_value(positive, [patient], "__s", "__m")
    everyone = keyed.select(patient).distinct()
    return join_on(everyone, modes, [patient], "left").select(
        patient, F.coalesce(F.col("__m").cast("int").cast("string"), F.lit("none")).alias("size_bin")
    )


def all_strata(
    df: DataFrame, patient: str = "patient_id", label: str = "label", size: str = "ulcer_size"
) -> DataFrame:
    """(patient, <one column per mode>) in one pass: frames are counted by (patient, label, size) once.

    Without any size value in the table 'size' falls back to presence and 'size_and_presence' uses 'none'
    as size; a patient without positive sizes has size 'none'.
    """
    key, is_pos = F.col("patient"), F.col("label") == 1
    sized = F.col(size) if size in df.columns else F.lit(None).cast("int")
    cells = df.groupBy(
        F.col(patient).cast("string").alias("patient"), F.col(label).alias("label"), sized.alias("size")
    ).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.sum(F.col("label") * F.col("n")) / F.sum(F.when(F.col("label").isNotNull(), F.col("n")))
    # a patient has one cell per positive size: the largest is the mode, the lowest size on ties
    largest = F.min_by(F.col("size"), F.when(is_pos & F.col("size").isNotNull(), F.struct(-F.col("n"), F.col("size"))))
    profile = cells.groupBy(key).agg(
        ratio.alias("ratio"),
        F.when(F.max(is_pos.cast("int")) == 1, "ulcer").otherwise("no_ulcer").alias("presence"),
        F.coalesce(largest.cast("int").cast("string"), F.lit("none")).alias("mode"),
    )
    # every column takes part in the check, so that Spark finds the same shuffle and makes it once
    any_size = cells.agg(F.bool_or(F.col("size").isNotNull() & (F.col("n") > 0))).scalar()
    ratio_bin = F.when(F.col("ratio") == 0, "no_ulcer").when(F.col("ratio") < 0.40, "low_ulcer").otherwise("high_ulcer")
    modes = {
        "size": F.when(any_size, F.col("mode")).otherwise(F.col("presence")),
        "presence": F.col("presence"),
        "size_and_presence": F.concat_ws("__", "presence", F.when(any_size, F.col("mode")).otherwise(F.lit("none"))),
        "ulcer_ratio": ratio_bin,
    }
    return profile.select(key.alias(patient), *[modes[m].alias(m) for m in STRAT_MODES])


def strata(
    df: DataFrame, mode: str, patient: str = "patient_id", label: str = "label", size: str = "ulcer_size"
) -> DataFrame:
    """(patient, stratum) for one of the four modes; see `all_strata`."""
    if mode not in STRAT_MODES:
        raise ValueError(f"unknown strat_mode {mode!r}; choose one of {STRAT_MODES}")
    return all_strata(df, patient, label, size).select(patient, F.col(mode).alias("stratum"))


def strata_by(df: DataFrame, aggregate: Callable[[], Column], patient: str = "patient_id") -> DataFrame:
    """(patient, stratum) from a caller's aggregate expression, evaluated once per patient."""
    return df.groupBy(F.col(patient).cast("string").alias(patient)).agg(aggregate().cast("string").alias("stratum"))


# ------------------------------------------------------------------- quotas


def effective_rare_threshold(test_ratio: float, rare_threshold: int = 3) -> int:
    return max(rare_threshold, math.ceil(1.0 / test_ratio) + 1)


def _largest_remainder(counts: DataFrame, exact: Column, target: Column, name: str) -> DataFrame:
    """Integer shares that sum to `target`: floors plus one for the largest remainders, ties by name.

    Strata are ranked range by range, so any number of them will do.
    """
    floor = F.floor(exact + 1e-9)
    part = counts.withColumns({"__f": floor, "__x": -F.round(exact - floor, 9)})
    rows = range_buckets(part, ["__x", "stratum"])
    given = rows.agg(F.sum("__f")).scalar()
    ranked = group_rank(rows, [], ["__b"], [F.col("__x"), F.col("stratum")], "__rank")
    share = F.col("__f") + F.when(F.col("__rank") <= target - given, 1).otherwise(0)
    return ranked.withColumn(name, share.cast("bigint")).drop("__f", "__x", "__b", "__rank", "__rank_total")


def split_quotas(
    counts: DataFrame, train_ratio: float, val_ratio: float, test_ratio: float, rare_threshold: int = 3
) -> DataFrame:
    """(stratum, n, rare, n_train, n_val, n_test) from (stratum, n).

    Rare strata get fixed quotas with at least one id for test; the others
    share the global holdout size by largest remainder.
    """
    limit = effective_rare_threshold(test_ratio, rare_threshold)
    n = F.col("n")
    rare = counts.filter(n < limit)
    te = F.greatest(F.lit(1), F.bround(n * test_ratio, 0)).cast("bigint")
    va = F.greatest(F.lit(1), F.bround(n * val_ratio, 0)).cast("bigint")
    missing = F.greatest(F.lit(0), 1 - (n - te - va))  # train must keep one id
    va_fixed = F.greatest(F.lit(0), va - missing)
    rare = rare.select(
        "stratum",
        "n",
        F.lit(True).alias("rare"),
        F.when(n >= 3, va_fixed).otherwise(0).cast("bigint").alias("n_val"),
        F.when(n >= 3, te).otherwise(1).cast("bigint").alias("n_test"),
    )

    common = counts.filter(n >= limit)
    common = common.withColumn("__all", common.agg(F.sum("n")).scalar())
    holdout = F.ceil(F.col("__all") * (val_ratio + test_ratio) - 1e-9)
    common = _largest_remainder(common, n * holdout / F.col("__all"), holdout, "__hold")
    test_total = F.ceil(holdout * (test_ratio / (val_ratio + test_ratio)) - 1e-9)
    share = F.col("__hold") * test_total / F.nullif(holdout, F.lit(0))
    common = _largest_remainder(common, F.coalesce(share, F.lit(0.0)), test_total, "n_test")
    common = common.select(
        "stratum", "n", F.lit(False).alias("rare"), (F.col("__hold") - F.col("n_test")).alias("n_val"), "n_test"
    )
    both = rare.unionByName(common)
    return both.select("stratum", "n", "rare", (n - F.col("n_val") - F.col("n_test")).alias("n_train"), "n_val", "n_test")


def _hash_ranked(ids: DataFrame, id_col: str, seed: int) -> DataFrame:
    keyed = ids.withColumn("__d", seeded_digest(seed, id_col)).withColumn("__b", F.substring("__d", 1, 2))
    return group_rank(keyed, ["stratum"], ["__b"], [F.col("__d"), F.col(id_col)], "__rank").drop("__d", "__b")


def split_ids(
    ids: DataFrame,
    id_col: str,
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
    test_ratio: float = 0.15,
    seed: int = 42,
    rare_threshold: int = 3,
) -> DataFrame:
    """Three-way stratified split of (id, stratum) rows: adds `split` and `rare`."""
    counts = cut_lineage(ids.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    quotas = split_quotas(counts, train_ratio, val_ratio, test_ratio, rare_threshold)
    ranked = _hash_ranked(ids, id_col, seed)
    cut = attach_by_group(ranked, quotas, ["stratum"])
    split = (
        F.when(F.col("__rank") <= F.col("n_test"), "test")
        .when(F.col("__rank") <= F.col("n_test") + F.col("n_val"), "val")
        .otherwise("train")
    )
    return cut.select(*ids.columns, split.alias("split"), "rare")


def split_strategy(counts: DataFrame, test_ratio: float = 0.15, rare_threshold: int = 3) -> DataFrame:
    """One row: 'empty', 'partial' (some strata rare) or 'stratified'."""
    limit = effective_rare_threshold(test_ratio, rare_threshold)
    return counts.agg(
        F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, "empty")
        .when(F.min("n") < limit, "partial")
        .otherwise("stratified")
        .alias("strategy")
    )


def assign_train_val_test_split(
    df: DataFrame,
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
    test_ratio: float = 0.15,
    seed: int = 42,
    patient: str = "patient_id",
    label: str = "label",
    strata_table: DataFrame | None = None,
    rare_threshold: int = 3,
) -> DataFrame:
    """Add `split` to every frame; all frames of a patient share it.

    The default stratum is the patient's label-ratio bin.
    """
    require_columns(df, [patient])
    if strata_table is None:
        require_columns(df, [label])
        strata_table = strata(df.filter(F.col(patient).isNotNull()), "ulcer_ratio", patient, label)
    assigned = split_ids(strata_table, patient, train_ratio, val_ratio, test_ratio, seed, rare_threshold)
    keyed = df.withColumn(patient, F.col(patient).cast("string"))
    return join_by_entity(keyed, assigned.select(patient, "split"), [patient])


def split_info(df: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """Patients, frames and frames per label of each split, as long rows."""
    sizes = df.groupBy("split").agg(
        F.count_distinct(patient).alias("n_patients"), F.count(F.lit(1)).alias("n_frames")
    )
    labels = df.groupBy("split", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_label_frames"))
    return join_on(labels, sizes, ["split"]).select("split", "n_patients", "n_frames", "label", "n_label_frames")


# -------------------------------------------------------------------- folds


def assign_cv_folds(
    df: DataFrame, n_splits: int = 5, seed: int = 42, strata_table: DataFrame | None = None,
    patient: str = "patient_id", label: str = "label",
) -> DataFrame:
    """Add `fold` (0..n_splits-1), constant per patient, balanced in size and stratum.

    Inside a stratum patients are dealt largest first in serpentine order, with
    the first fold rotated per stratum.  Default stratum: modal label.
    """
    if strata_table is None:
        strata_table = modal_label(df, patient, label)
    folds = patient_folds(df, strata_table, n_splits, seed, patient)
    keyed = df.withColumn(patient, F.col(patient).cast("string"))
    return join_by_entity(keyed, folds.select(patient, "fold"), [patient])


def patient_folds(
    df: DataFrame, strata_table: DataFrame, n_splits: int = 5, seed: int = 42, patient: str = "patient_id"
) -> DataFrame:
    """(patient, stratum, n_frames, fold)."""
    sizes = df.groupBy(F.col(patient).cast("string").alias(patient)).agg(F.count(F.lit(1)).alias("n_frames"))
    ids = join_on(strata_table, sizes, [patient])
    ids = ids.withColumns({"__d": seeded_digest(seed, patient), "__neg": -F.col("n_frames")})
    ids = ids.withColumn("__b", F.substring("__d", 1, 1))
    ranked = group_rank(
        ids, ["stratum"], ["__neg", "__b"], [F.col("__neg"), F.col("__d"), F.col(patient)], "__rank"
    )
    # one row per stratum: each begins its deal at another fold
    strata = range_buckets(strata_table.select("stratum").distinct(), ["stratum"], "__range")
    start = group_rank(strata, [], ["__range"], [F.col("stratum")], "__place")
    start = start.select("stratum", ((F.col("__place") - 1) % n_splits).alias("__start"))
    pos = (F.col("__rank") - 1) % n_splits
    lap = F.floor((F.col("__rank") - 1) / n_splits) % 2
    dealt = F.when(lap == 0, pos).otherwise(n_splits - 1 - pos)
    placed = attach_by_group(ranked, start, ["stratum"])
    return placed.select(
        patient, "stratum", "n_frames", ((dealt + F.col("__start")) % n_splits).cast("int").alias("fold")
    )


def fold_table(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Long (cv_fold, role, item...) from a table with `fold`: each row is val once and train elsewhere."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    return df.withColumn("cv_fold", every).withColumn(
        "role", F.when(F.col("fold") == F.col("cv_fold"), "val").otherwise("train")
    )


def cv_fold(df: DataFrame, fold: int, n_splits: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, val) rows of one fold of a table with `fold`."""
    if not 0 <= fold < n_splits:
        raise ValueError(f"fold must be in [0, {n_splits}), got {fold}")
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def train_pool(manifest: DataFrame, use_full_trainset: bool = False, use_all_splits: bool = False) -> DataFrame:
    """Rows that may be used for training: train, train+val, or everything."""
    if use_all_splits:
        return manifest
    return manifest.filter(F.col("split").isin("train", "val") if use_full_trainset else F.col("split") == "train")


def assign_val_split(
    df: DataFrame, val_ratio: float = 0.15, seed: int = 42, strata_table: DataFrame | None = None,
    patient: str = "patient_id", label: str = "label",
) -> DataFrame:
    """Add `role` = train / val per patient.

    ceil(patients * val_ratio) patients go to val, spread over the strata by
    largest remainder; strata are ignored if one has fewer than two patients.
    """
    if strata_table is None:
        strata_table = modal_label(df, patient, label)
    counts = strata_table.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    too_small = counts.agg(F.min("n") < 2).scalar()
    ids = strata_table.withColumn("stratum", F.when(too_small, F.lit("all")).otherwise(F.col("stratum")))
    counts = cut_lineage(ids.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    sized = counts.withColumn("__all", counts.agg(F.sum("n")).scalar())
    target = F.ceil(F.col("__all") * val_ratio - 1e-9)
    quotas = _largest_remainder(sized, F.col("n") * target / F.col("__all"), target, "n_val")
    ranked = attach_by_group(_hash_ranked(ids, patient, seed), quotas.select("stratum", "n_val"), ["stratum"])
    roles = ranked.select(patient, F.when(F.col("__rank") <= F.col("n_val"), "val").otherwise("train").alias("role"))
    keyed = df.withColumn(patient, F.col(patient).cast("string"))
    return join_by_entity(keyed, roles, [patient])


def train_val_roles(manifest: DataFrame, val_ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """Train / val rows of a manifest: its own val rows if it has any, else a carved patient set."""
    has_val = len(manifest.filter(F.col("split") == "val").limit(1).take(1)) > 0
    if has_val:
        return manifest.filter(F.col("split").isin("train", "val")).withColumn("role", F.col("split"))
    return assign_val_split(manifest.filter(F.col("split") == "train"), val_ratio, seed)


def heldout_rows(manifest: DataFrame) -> DataFrame:
    """Rows with split = test if there are any, else all rows."""
    if "split" not in manifest.columns:
        return manifest
    has_test = manifest.select(F.bool_or(F.col("split") == "test")).scalar()
    return manifest.filter(F.when(has_test, F.col("split") == "test").otherwise(F.lit(True)))


# ------------------------------------------------------------------ subsets


def clip_strata(df: DataFrame, label: str = "label", clip: str = "clip_key") -> DataFrame:
    """(clip, label, n_frames, stratum): class x tertile of clip length within the class.

    Bins are right-closed; when both cut points agree the lower moves down by one.
    """
    # label and length come from the same counts, kept because cuts, quotas and ranks all read them
    counts = df.filter(F.col(label).isNotNull()).groupBy(clip, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    clips = cut_lineage(
        counts.groupBy(clip).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.sum("n").alias("n_frames"))
    )
    # distinct clip lengths per class are few: their count is at most sqrt(2 * frames)
    cuts = clips.groupBy("label").agg(
        F.percentile("n_frames", F.lit(1.0 / 3.0)).alias("__q33"), F.percentile("n_frames", F.lit(2.0 / 3.0)).alias("__q66")
    ).withColumn("__q33", F.when(F.col("__q33") == F.col("__q66"), F.col("__q66") - 1).otherwise(F.col("__q33")))
    binned = attach_by_group(clips, cuts, ["label"])
    name = (
        F.when(F.col("n_frames") <= F.col("__q33"), "few")
        .when(F.col("n_frames") <= F.col("__q66"), "medium")
        .otherwise("many")
    )
    return binned.select(clip, "label", "n_frames", F.concat_ws("_", F.col("label").cast("string"), name).alias("stratum"))


def sample_clips(
    df: DataFrame, subset_ratio: float, seed: int = 42, label: str = "label", clip: str = "clip_key"
) -> DataFrame:
    """(clip, label, n_frames, stratum) of the chosen clips: max(1, round(clips * ratio)) by largest remainder."""
    clips = clip_strata(df, label, clip)
    counts = cut_lineage(clips.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    sized = counts.withColumn("__all", counts.agg(F.sum("n")).scalar())
    target = F.greatest(F.lit(1), F.bround(F.col("__all") * subset_ratio, 0)).cast("bigint")
    quotas = _largest_remainder(sized, F.col("n") / F.col("__all") * target, target, "quota")
    ranked = attach_by_group(_hash_ranked(clips, clip, seed), quotas.select("stratum", "quota"), ["stratum"])
    return ranked.filter(F.col("__rank") <= F.col("quota")).select(clip, "label", "n_frames", "stratum")


def sample_train(
    df: DataFrame, subset_ratio: float, seed: int = 42, label: str = "label", clip: str = "clip_key"
) -> DataFrame:
    """All frames of a class- and length-stratified clip sample."""
    return join_by_entity(df, sample_clips(df, subset_ratio, seed, label, clip).select(clip), [clip], "inner")


def class_weights(
    df: DataFrame, n_classes: int, label: str = "label", manual: Sequence[float] | float | None = None
) -> DataFrame:
    """(class_id, n, weight): n / (k * n_c), 1.0 for an absent class, or the caller's own weights.

    A scalar is the weight of the positive class of a binary task.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("class_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    classes = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id"))
    table = classes.join(counts, "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if isinstance(manual, (int, float)) and n_classes == 2:
        return table.withColumn("weight", F.when(F.col("class_id") == 0, 1.0).otherwise(float(manual)))
    if isinstance(manual, (list, tuple)) and len(manual) == n_classes:
        given = F.array(*[F.lit(float(w)) for w in manual])
        return table.withColumn("weight", F.get(given, F.col("class_id")))
    return table.withColumn(
        "weight",
        F.when(F.col("n") == 0, F.lit(1.0)).otherwise(total.cast("double") / (F.lit(float(n_classes)) * F.col("n"))),
    )
