"""Manifests, lookups, interval joins, duplicates and review logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.functions import parse
from cliplab.operators.ranking import attach_by_group, join_by_entity, join_on
from cliplab.session import cut_lineage, keep_rows


def clip_manifest(listing: DataFrame, classes: Mapping[str, int], relative: str = "relative_path") -> DataFrame:
    """class/video/segment/file paths -> manifest rows; other paths and file types are left out."""
    path = F.col(relative)
    parts = F.split(path, "/")
    video, segment = F.get(parts, 1), F.get(parts, 2)
    label = parse._lookup(classes, F.get(parts, 0))
    known = (F.size(parts) == 4) & F.get(parts, 0).isin(*classes) & parse.is_media_file(path)
    image = F.col("path") if "path" in listing.columns else path
    return listing.filter(known).select(
        image.alias("image_path"),
        video.alias("video_id"),
        video.alias("patient_id"),
        F.get(parts, 0).alias("class_name"),
        label.cast("int").alias("label"),
        segment.alias("segment_id"),
        parse.segment_number(segment).alias("segment_number"),
        parse.frame_number(F.get(parts, 3)).alias("frame_number"),
        parse.clip_key(video, segment).alias("clip_key"),
        path.alias("relative_path"),
    )


def informative_manifest(listing: DataFrame, relative: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """(manifest, rejects): Informative/<file>, Non-Informative/<cause>/<file> or Non-Informative/<file>.

    The cause is the folder name with blanks for underscores; names that do not
    parse are rejected, not lost.
    """
    path = F.col(relative)
    parts = F.split(path, "/")
    depth, top = F.size(parts), F.get(parts, 0)
    placed = ((top == "Informative") & (depth == 2)) | ((top == "Non-Informative") & depth.isin(2, 3))
    image = F.col("path") if "path" in listing.columns else path
    rows = listing.filter(placed & parse.is_media_file(path)).select(
        image.alias("image_path"),
        path.alias("relative_path"),
        top.alias("class_name"),
        F.when(top == "Informative", 1).otherwise(0).alias("label"),
        F.when((top == "Non-Informative") & (depth == 3), F.regexp_replace(F.get(parts, 1), "_", " "))
        .otherwise("")
        .alias("cause"),
        parse.sample_name(parse.file_stem(path)).alias("p"),
    )
    good = rows.filter("p is not null").select(
        "image_path",
        F.col("p.record_id").alias("patient_id"),
        "class_name",
        "label",
        F.concat_ws("__", F.col("p.record_id"), F.col("p.unique_sample_id")).alias("sample_id"),
        F.col("p.unique_sample_id").alias("unique_sample_id"),
        F.col("p.frame_number").alias("frame_number"),
        "cause",
        "relative_path",
    )
    return good, rows.filter("p is null").select("relative_path")


def labelled_windows(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Two annotation tables (record_id, start_time, end_time, sample_number, size) -> one labelled table.

    Rows without keys or readable times, or with end <= start, are left out.
    """
    both = positive.withColumn("label", F.lit(1)).unionByName(
        negative.withColumn("label", F.lit(0)), allowMissingColumns=True
    )
    timed = both.withColumns(
        {
            "record_id": F.trim(F.col("record_id").cast("string")),
            "start_s": parse.hms_to_seconds(F.col("start_time")),
            "end_s": parse.hms_to_seconds(F.col("end_time")),
        }
    )
    return timed.dropna(subset=["record_id", "start_s", "end_s"]).filter("end_s > start_s").drop("start_time", "end_time")


def size_lookup(rows: DataFrame, order: str) -> DataFrame:
    """(record_id, sample_number, size_code): unreadable numbers dropped, the last row of a key wins."""
    typed = rows.select(
        F.trim(F.col("record_id").cast("string")).alias("record_id"),
        F.col("sample_number").cast("string").try_cast("double").cast("int").alias("sample_number"),
        parse.size_code(F.coalesce(F.col("size"), F.lit(""))).alias("size_code"),
        F.col(order).alias("__o"),
    ).filter("sample_number is not null")
    return typed.groupBy("record_id", "sample_number").agg(
        F.max_by(F.struct("size_code"), "__o").alias("s")
    ).select("record_id", "sample_number", "s.size_code")


def attach_size(manifest: DataFrame, lookup: DataFrame) -> DataFrame:
    """ulcer_size from the lookup for positive rows, null for all others."""
    keyed = lookup.select(
        F.col("record_id").alias("video_id"), F.col("sample_number").alias("segment_number"), "size_code"
    )
    joined = join_by_entity(manifest, keyed, ["video_id", "segment_number"])
    return joined.withColumn("ulcer_size", F.when(F.col("label") == 1, F.col("size_code"))).drop("size_code")


def match_videos(windows: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, skipped) annotation windows by lower-cased record id; `videos` has (stem, path)."""
    keyed = windows.withColumn("__k", F.lower("record_id"))
    index = videos.groupBy(F.lower("stem").alias("__k")).agg(F.max("path").alias("video_path"))
    skipped = keyed.join(index, "__k", "left_anti").drop("__k").withColumn("reason", F.lit("video_not_found"))
    return join_by_entity(keyed, index, ["__k"], "inner").drop("__k"), skipped


BUSY_ROWS = 1 << 20  # frames of one cell that go to one task


def frames_in_windows(
    frames: DataFrame, windows: DataFrame, key: str = "record_id", time: str = "time_s", bucket_s: float = 60.0,
    offset: str | None = None, busy_rows: int = BUSY_ROWS,
) -> DataFrame:
    """Inner join on key and start_s <= t < end_s (plus a per-window offset).

    Cells of time come in levels of bucket_s, 2 * bucket_s, 4 * bucket_s, ...  A window lies in at most two cells of the
    first level that is no shorter than itself, so a window of a year costs no more rows than one of a second;
    a frame has one cell on each level that some window uses (at most some forty).  Frames of a cell are
    counted, and a cell of more than `busy_rows` is split: its frames are dealt out by hash, its windows
    go to every part.  Null times and keys match nothing; windows that don't end after their start are empty.
    """
    shift = F.col(offset) if offset is not None else F.lit(0.0)
    w = windows.withColumns({"__from": F.col("start_s") + shift, "__to": F.col("end_s") + shift}).filter("__to > __from")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("__to") - F.col("__from")) / float(bucket_s)) + 1e-9)).cast("int")
    w = w.withColumn("__level", level)
    levels = sorted(r[0] for r in w.select("__level").distinct().collect())

    def cell(at: Column) -> Column:
        return F.floor(at / (F.lit(float(bucket_s)) * F.pow(F.lit(2.0), F.col("__level")))).cast("long")

    first, last = cell(F.col("__from")), cell(F.col("__to"))
    w = w.withColumn("__cell", F.explode(F.array_distinct(F.array(first, last))))
    f = frames.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    f = f.withColumn("__cell", cell(F.col(time))).filter(F.col("__cell").isNotNull() & F.col(key).isNotNull())
    place = [key, "__level", "__cell"]
    busy = f.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > busy_rows)
    busy = cut_lineage(busy.select(*place, F.ceil(F.col("__n") / busy_rows).cast("int").alias("__parts")))
    if busy.isEmpty():
        f, w, place = f.withColumn("__part", F.lit(0)), w.withColumn("__part", F.lit(0)), [*place, "__part"]
    else:
        parts = F.coalesce("__parts", F.lit(1))
        f = attach_by_group(f, busy, place, "left").withColumn("__part", F.pmod(F.xxhash64(*frames.columns), parts).cast("int")).drop("__parts")
        every = F.explode(F.sequence(F.lit(0), parts - 1))
        w, place = attach_by_group(w, busy, place, "left").withColumn("__part", every).drop("__parts"), [*place, "__part"]
    joined = f.join(w, place).filter((F.col(time) >= F.col("__from")) & (F.col(time) < F.col("__to")))
    return joined.drop("__level", "__cell", "__part", "__from", "__to")


def apply_reviews(manifest: DataFrame, log: DataFrame, item: str = "image_path") -> DataFrame:
    """Latest review per item overrides label and cause; cause is blank for informative rows."""
    newest = log.groupBy(item).agg(
        F.max_by(F.struct("new_label", "new_cause"), F.struct("timestamp", "new_label", "new_cause")).alias("r")
    )
    joined = manifest.join(newest, item, "left")
    label = F.when(F.col("r").isNull(), F.col("label")).otherwise(
        F.when(F.col("r.new_label") == "Informative", 1).otherwise(0)
    )
    cause = (
        F.when(F.col("r").isNull(), F.col("cause"))
        .when(F.col("r.new_label") == "Informative", "")
        .otherwise(F.col("r.new_cause"))
    )
    return joined.withColumns(
        {"label": label.cast("int"), "cause": cause, "reviewed": F.col("r").isNotNull()}
    ).drop("r")


def review_queue(scored: DataFrame, outcomes: Sequence[str] | None = None) -> DataFrame:
    """Rows whose outcome is asked for, or the uncertain rows of a routing table."""
    if outcomes is None:
        return scored.filter(F.col("category") == "uncertain")
    return scored.filter(F.col("outcome").isin(*outcomes))


def new_items(arrived: DataFrame, done: DataFrame, key: str = "relative_path") -> DataFrame:
    """Items not yet in the output (incremental batch)."""
    return arrived.join(done.select(key).distinct(), key, "left_anti")


def attach_predictions(manifest: DataFrame, scores: DataFrame, key: str = "frame_id") -> DataFrame:
    """Join scores by key; raises unless every key is there exactly once on either side.

    Rows travel to their key once: each side is counted there, one row a key is joined, and the joined rows are kept,
    so that they are checked before they are returned.
    """
    joined = keep_rows(_counted(manifest, key, "__m").join(_counted(scores, key, "__s"), key, "full_outer"))
    n = [F.coalesce(F.col(c), F.lit(0)) for c in ("__m", "__s")]
    bad = joined.filter((n[0] != 1) | (n[1] != 1)).select(F.col(key).alias("key"), n[0].alias("m"), n[1].alias("s")).first()
    if bad is not None:
        raise ValueError(f"key {bad['key']!r} is on {bad['m']} manifest rows and {bad['s']} scores")
    return joined.drop("__m", "__s")


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row of each key with the number of its rows."""
    own = Window.partitionBy(key).orderBy(key)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = df.withColumns({name: F.count(F.lit(1)).over(whole), "__i": F.row_number().over(own)})
    return counted.filter("__i = 1").drop("__i")


def attach_features(features: DataFrame, manifest: DataFrame, key: str = "relative_path") -> DataFrame:
    """Feature rows joined to the manifest; raises if a feature row has no manifest row."""
    lost = features.join(manifest.select(key), key, "left_anti").limit(1).count()
    if lost:
        raise RuntimeError("feature rows are missing from the manifest; compute the features again")
    return features.join(manifest, key)


def child_runs(runs: DataFrame) -> DataFrame:
    """(parent_id, run_id, ...) of nested runs beside their parent's name."""
    parents = runs.filter(F.col("parent_id").isNull()).select(
        F.col("run_id").alias("parent_id"), F.col("run_name").alias("parent_name")
    )
    return runs.filter(F.col("parent_id").isNotNull()).join(parents, "parent_id")


# --------------------------------------------------------------- duplicates


def duplicate_groups(items: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, n_copies) of stems that occur more than once."""
    return items.groupBy(stem).agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")


def duplicate_report(items: DataFrame, stem: str = "stem") -> DataFrame:
    """All rows of duplicated stems with their number of copies."""
    return items.join(duplicate_groups(items, stem), stem)


def has_no_duplicates(items: DataFrame, stem: str = "stem") -> bool:
    return duplicate_groups(items, stem).limit(1).count() == 0


def duplicate_actions(
    items: DataFrame, stem: str = "stem", path: str = "path", mtime: str = "mtime", keep_prefix: str | None = None
) -> DataFrame:
    """One row per copy with action keep / delete (a dry run: nothing is deleted).

    Keeps the newest copy, or the newest one whose folder starts with
    `keep_prefix`; the lowest path decides ties.  The keeper is a map-side
    combined maximum, so a stem with any number of copies is fine.
    """
    preferred = F.col(path).startswith(keep_prefix) if keep_prefix else F.lit(False)
    marked = items.withColumn("__p", preferred.cast("int"))
    is_time = dict(items.dtypes)[mtime].startswith("timestamp")
    age = -(F.unix_micros(F.col(mtime).cast("timestamp")) if is_time else F.col(mtime).cast("double"))
    best = marked.groupBy(stem).agg(
        F.min(F.struct(-F.col("__p"), age, F.col(path).alias("keep"))).getField("keep").alias("__keep"),
        F.count(F.lit(1)).alias("n_copies"),
    ).filter("n_copies > 1")
    out = items.join(best, stem)
    return out.withColumn("action", F.when(F.col(path) == F.col("__keep"), "keep").otherwise("delete")).drop("__keep")


def overlay_offset(probes: DataFrame, video: str = "video_id", text: str = "text", probe: str = "probe_s") -> DataFrame:
    """(video, offset_s): probe time minus overlay time at the first probe whose text can be read."""
    read = probes.withColumn("overlay_s", parse.stopwatch_seconds(F.col(text), hint=F.col(probe)))
    return (
        read.filter("overlay_s is not null")
        .groupBy(video)
        .agg(F.min_by(F.col(probe).cast("double") - F.col("overlay_s"), "probe_order").alias("offset_s"))
    )


def first_item(items: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First item per group in the given order (a combined minimum, no sort)."""
    rest = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("f")).select(*keys, "f.*")


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First n rows (a distributed top-n: no full sort)."""
    return df.orderBy(*order).limit(n)


def window_pairs(events: DataFrame, key: str, time: str, span: int) -> DataFrame:
    """Each row with the time of the next row of its key, as [start_s, end_s) windows.

    Works per (key, time bucket); only the first time of every bucket crosses buckets.
    """
    b = events.withColumn("__b", F.floor(F.col(time) / F.lit(span)))
    inside = Window.partitionBy(key, "__b").orderBy(time)
    firsts = b.groupBy(key, "__b").agg(F.min(time).alias("__first"))
    after = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(key).orderBy("__b")))
    joined = join_on(b.withColumn("__lead", F.lead(time).over(inside)), after.select(key, "__b", "__next"), [key, "__b"])
    return joined.select(
        *events.columns, F.col(time).alias("start_s"), F.coalesce("__lead", "__next").alias("end_s")
    ).filter("end_s > start_s")
