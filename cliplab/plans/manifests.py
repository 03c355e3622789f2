"""Queries for sources (A), filters (C), joins (D), ordered picks (F) and set operations (S)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.functions import parse
from cliplab.functions.outcomes import outcome, route
from cliplab.operators import manifest as m
from cliplab.operators import quality, report, sampling, splits
from cliplab.operators.clips import topk_mean
from cliplab.operators.ranking import join_by_entity
from cliplab.operators.significance import complete_models, normal_interval
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql
from cliplab.sources import cache, sinks, tables

CLASSES = {"Ulcer": 1, "NonUlcer": 0}


def scratch(v: Views, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder (or /tmp in local runs)."""
    shared = v.spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not v.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors don't share /tmp")
        return tempfile.mkdtemp(prefix=f"cliplab-{name}-", dir="/tmp")
    token = v.spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{shared.rstrip('/')}/cliplab-{name}-{token}"


# ------------------------------------------------------------------- sources


@query(
    "a01_manifest_scan",
    sql("frames", "SELECT frame_id, clip_key, label FROM frames WHERE split = 'train'"),
)
def a01(v: Views) -> DataFrame:
    """Split filter over the manifest view: columns are pruned to those used."""
    return v.frames().filter(F.col("split") == "train").select("frame_id", "clip_key", "label")


@query(
    "a02_listing_by_stem",
    """SELECT stem, count(*) AS n_files, min(path) AS first_path FROM (
         SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path,
                regexp_replace(split_part(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages)
       GROUP BY 1""",
)
def a02(v: Views) -> DataFrame:
    """Index of paths by file stem, as the file listing builds it."""
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    items = v.table("pages").select(path.alias("path"), parse.file_stem(path).alias("stem"))
    return items.groupBy("stem").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))


@query(
    "a02_listed_files",
    """SELECT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS folder, 1::BIGINT AS n_files, true AS has_content FROM documents GROUP BY 1""",
)
def a02_files(v: Views) -> DataFrame:
    """One file of ids per language, written to the shared folder and listed again."""
    root = scratch(v, "listing")
    ids = v.table("documents").select(F.col("doc_id").cast("string").alias("value"), "lang")
    ids.repartition("lang").write.partitionBy("lang").text(root)
    listed = tables.list_files(v.spark, root, (".txt",))
    return listed.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), (F.min("size_kb") >= 0).alias("has_content"))


@query(
    "a03_manifest_from_paths",
    sql(
        "frames",
        """SELECT relative_path AS image_path, video_id, patient_id, class_name, label, segment_id, segment_number, frame_number,
             video_id || '__' || segment_id AS clip_key, relative_path FROM frames""",
    ),
)
def a03(v: Views) -> DataFrame:
    return m.clip_manifest(v.frames().select("relative_path"), CLASSES)


_INF_PATH = """CASE WHEN label = 1 THEN 'Informative/' WHEN coalesce(cause, '') = '' THEN 'Non-Informative/'
     ELSE 'Non-Informative/' || replace(cause, ' ', '_') || '/' END"""


@query(
    "a04_informative_manifest",
    sql(
        "causes",
        f"""SELECT {_INF_PATH} || sample_id || '__sample_' || (doc_id % 7) || '__frame_' || doc_id || '.JPG' AS relative_path,
              sample_id AS patient_id, CASE WHEN label = 1 THEN 'Informative' ELSE 'Non-Informative' END AS class_name, label,
              sample_id || '__sample_' || (doc_id % 7) AS sample_id, 'sample_' || (doc_id % 7) AS unique_sample_id,
              doc_id::INTEGER AS frame_number, coalesce(cause, '') AS cause, false AS rejected FROM causes WHERE doc_id % 11 <> 0
            UNION ALL SELECT {_INF_PATH} || sample_id || '__clip_' || (doc_id % 7) || '__frame_' || doc_id || '.JPG', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true
            FROM causes WHERE doc_id % 11 = 0""",
    ),
)
def a04(v: Views) -> DataFrame:
    tag = F.when(F.col("doc_id") % 11 == 0, "clip").otherwise("sample")
    name = F.concat(
        F.expr(_INF_PATH), F.col("sample_id"), F.lit("__"), tag, F.lit("_"), (F.col("doc_id") % 7).cast("string"),
        F.lit("__frame_"), F.col("doc_id").cast("string"), F.lit(".JPG"),
    )
    good, rejects = m.informative_manifest(v.causes().select(name.alias("relative_path")))
    both = good.drop("image_path").withColumn("rejected", F.lit(False))
    return both.unionByName(rejects.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


@query(
    "a05_labelled_windows",
    """SELECT record_id, sample_number, label, start_s, end_s FROM (
         SELECT 'u' || user_id AS record_id, event_id AS sample_number, (event_type = 'click')::INTEGER AS label,
                hour(ts) * 3600.0::DOUBLE + minute(ts) * 60.0::DOUBLE + second(ts)::DOUBLE AS start_s,
                hour(ts + INTERVAL 90 SECOND) * 3600.0::DOUBLE + minute(ts + INTERVAL 90 SECOND) * 60.0::DOUBLE + second(ts + INTERVAL 90 SECOND)::DOUBLE AS end_s
         FROM events WHERE event_type IN ('click', 'view') AND user_id % 10 <> 0) WHERE end_s > start_s""",
)
def a05(v: Views) -> DataFrame:
    record = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(" ")))
    e = v.table("events").select(
        "event_type", record.alias("record_id"), F.col("event_id").alias("sample_number"),
        F.date_format("ts", "HH:mm:ss").alias("start_time"),
        F.date_format(F.col("ts") + F.expr("interval 90 seconds"), "HH:mm:ss").alias("end_time"),
    )
    sheets = [e.filter(F.col("event_type") == t).drop("event_type") for t in ("click", "view")]
    return m.labelled_windows(*sheets)


@query(
    "a06_size_lookup",
    """WITH typed AS (SELECT 'brand' || l_partkey % 50 AS record_id, l_suppkey AS sample_number, p_size,
           l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord
         FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 9 <> 0)
       SELECT record_id, sample_number::INTEGER AS sample_number,
         arg_max(CASE WHEN p_size <= 16 THEN 1 WHEN p_size <= 33 THEN 2 WHEN p_size <= 45 THEN 3 ELSE -1 END, ord) AS size_code
       FROM typed GROUP BY 1, 2""",
)
def a06(v: Views) -> DataFrame:
    li = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.expr("CASE WHEN p_size <= 16 THEN '<5mm' WHEN p_size <= 33 THEN '5-20mm' WHEN p_size <= 45 THEN '>20mm' END")
    number = F.when(F.col("l_suppkey") % 9 == 0, "n/a").otherwise(F.col("l_suppkey").cast("string"))
    rows = li.select(
        F.concat(F.lit(" brand"), (F.col("l_partkey") % 50).cast("string")).alias("record_id"), number.alias("sample_number"),
        size.alias("size"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"),
    )
    return m.size_lookup(rows, "ord").withColumn("size_code", F.coalesce("size_code", F.lit(-1)))


@query(
    "a07_prediction_facts",
    sql(
        "predictions",
        """SELECT model, fold, count(*) AS n, count(DISTINCT frame_id) AS n_frames, round(sum(prob), 6) AS sum_prob
           FROM predictions WHERE model = 'blend' AND fold IN (1, 3) GROUP BY 1, 2""",
    ),
)
def a07(v: Views) -> DataFrame:
    """Fact table written by model and fold, read back with partition filters."""
    path = scratch(v, "predictions")
    facts = v.predictions().select("model", "fold", "frame_id", "clip_key", "label", "prob")
    tables.write_predictions(facts, path)
    part = tables.read_predictions(v.spark, path).filter((F.col("model") == "blend") & F.col("fold").isin(1, 3))
    return part.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("frame_id").alias("n_frames"), F.round(F.sum("prob"), 6).alias("sum_prob")
    )


@query(
    "a08_complete_fold_history",
    """WITH hist AS (SELECT p_brand AS experiment, l_suppkey % 10 AS model, year(l_shipdate) AS fold, avg(l_discount) AS value
          FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 10 <> year(l_shipdate) - 1995 GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY fold) AS f, count(*) OVER (PARTITION BY experiment, model) AS c FROM hist),
        kept AS (SELECT * FROM ranked WHERE f <= 7 AND c >= 7)
       SELECT experiment, model, f - 1 AS fold, round(value, 9) AS value FROM kept
       WHERE experiment IN (SELECT experiment FROM kept GROUP BY 1 HAVING count(DISTINCT model) >= 2)""",
)
def a08(v: Views) -> DataFrame:
    li = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    model, fold = F.col("l_suppkey") % 10, F.year("l_shipdate")
    hist = li.filter(model != fold - 1995).groupBy(
        F.col("p_brand").alias("experiment"), model.alias("model"), fold.alias("fold")
    ).agg(F.avg("l_discount").alias("value"))
    return complete_models(hist, 7).withColumn("value", F.round("value", 9))


@query(
    "a09_manifest_fingerprint",
    sql(
        "frames",
        """SELECT 'same' AS version, true AS reused, count(*) AS n_rows FROM frames
           UNION ALL SELECT 'changed', false, count(*) FROM frames""",
    ),
)
def a09(v: Views) -> DataFrame:
    """Order-insensitive fingerprint: equal for reordered rows, different after one label change."""
    base = v.frames().select("split", "relative_path", "label")
    shuffled = base.repartition(F.xxhash64("relative_path"))
    changed = base.withColumn("label", F.when(F.col("split") == "val", 1 - F.col("label")).otherwise(F.col("label")))
    first = cache.manifest_fingerprint(base)
    rows = [("same", shuffled), ("changed", changed)]
    parts = [
        cache.manifest_fingerprint(df).join(
            first.withColumnsRenamed({"hash_sum": "s", "hash_xor": "x"}), "n_rows"
        ).select(F.lit(name).alias("version"), ((F.col("hash_sum") == F.col("s")) & (F.col("hash_xor") == F.col("x"))).alias("reused"), "n_rows")
        for name, df in rows
    ]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------------- sinks


@query(
    "k01_manifest_by_split",
    sql("frames", "SELECT split, count(*) AS n, count(DISTINCT patient_id) AS n_patients, sum(label)::BIGINT AS n_pos FROM frames GROUP BY 1"),
)
def k01(v: Views) -> DataFrame:
    path = scratch(v, "manifest")
    sinks.write_manifest(v.frames().select("frame_id", "patient_id", "clip_key", "relative_path", "label", "split"), path)
    back = v.spark.read.parquet(f"{path}/manifest")
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_patients"), F.sum("label").alias("n_pos")
    )


@query(
    "k02_routing_log",
    sql(
        "frames",
        """SELECT category, count(*) AS n, round(avg(score_a), 9) AS mean_prob FROM (
             SELECT score_a, CASE WHEN abs(score_a - 0.5) < 0.05 THEN 'uncertain' WHEN score_a >= 0.5 THEN 'informative' ELSE 'non_informative' END AS category FROM frames)
           GROUP BY 1""",
    ),
)
def k02(v: Views) -> DataFrame:
    path = scratch(v, "routing")
    routed = v.frames().select("frame_id", F.col("score_a").alias("prob"), route(F.col("score_a"), 0.5, 0.05).alias("category"))
    sinks.write_routing(routed, path, 0.5, 0.05)
    back = v.spark.read.parquet(f"{path}/predictions")
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 9).alias("mean_prob"))


@query(
    "k03_eda_tables",
    sql("frames", "SELECT split, sum((label = 0)::INTEGER)::BIGINT AS label_0, sum((label = 1)::INTEGER)::BIGINT AS label_1 FROM frames GROUP BY 1"),
)
def k03(v: Views) -> DataFrame:
    path = scratch(v, "eda")
    sinks.write_tables({"split_label_table": quality.label_crosstab(v.frames())}, path)
    return v.spark.read.schema("split string, label_0 bigint, label_1 bigint").option("header", True).csv(f"{path}/split_label_table")


@query(
    "k04_interval_table",
    sql("predictions", """SELECT model, round(avg(x), 4) AS mean, round(avg(x) - 1.959963984540054::DOUBLE * stddev_samp(x) / sqrt(count(x)), 4) AS lower,
        round(avg(x) + 1.959963984540054::DOUBLE * stddev_samp(x) / sqrt(count(x)), 4) AS upper FROM (
        SELECT model, clip_key, avg(prob) AS x FROM predictions GROUP BY 1, 2) GROUP BY 1"""),
)
def k04(v: Views) -> DataFrame:
    """Intervals written as JSON rows with four digits, and read back."""
    path = scratch(v, "intervals")
    per_clip = v.predictions().groupBy("model", "clip_key").agg(F.avg("prob").alias("value"))
    sinks.write_intervals(normal_interval(per_clip, ["model"]), path, "test")
    return v.spark.read.schema("model string, mean double, lower double, upper double").json(f"{path}/test_ci")


# ------------------------------------------------------------------- filters


@query(
    "c01_split_filter",
    sql(
        "frames",
        """SELECT 'train' AS pool, count(*) AS n FROM frames WHERE split = 'train'
           UNION ALL SELECT 'train_val', count(*) FROM frames WHERE split IN ('train', 'val')
           UNION ALL SELECT 'all', count(*) FROM frames""",
    ),
)
def c01(v: Views) -> DataFrame:
    f = v.frames().select("split")
    pools = {
        "train": splits.train_pool(f), "train_val": splits.train_pool(f, use_full_trainset=True),
        "all": splits.train_pool(f, use_all_splits=True),
    }
    out = None
    for name, df in pools.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("pool"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("c02_heldout_rule", sql("frames", "SELECT split, count(*) AS n FROM frames WHERE split = 'test' GROUP BY 1"))
def c02(v: Views) -> DataFrame:
    return splits.heldout_rows(v.frames()).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c03_valid_windows",
    """SELECT user_id, count(*) AS n FROM events WHERE value > 20 AND event_type <> 'error' GROUP BY 1""",
)
def c03(v: Views) -> DataFrame:
    """Annotations need keys, readable times and end > start."""
    e = v.table("events")
    hms = lambda c: F.concat_ws(":", *[F.lpad(x.cast("int").cast("string"), 2, "0") for x in (c / 3600, (c / 60) % 60, c % 60)])
    rows = e.select(
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("record_id"),
        hms(F.lit(20.0)).alias("start_time"), hms(F.ceil("value").cast("double")).alias("end_time"),
    )
    good = m.labelled_windows(rows, rows.limit(0))
    return good.groupBy(F.col("record_id").cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c04_extension_filter",
    """SELECT count(*) AS n, sum(regexp_matches(url, '(?i)\\.html$')::INTEGER)::BIGINT AS n_media FROM pages""",
)
def c04(v: Views) -> DataFrame:
    hit = parse.is_media_file(F.col("url"), (".HTML",))
    return v.table("pages").agg(F.count(F.lit(1)).alias("n"), quality.count_if(hit).alias("n_media"))


@query("c05_keep_above_threshold", sql("frames", "SELECT frame_id, score_b FROM frames WHERE score_b >= 0.62"))
def c05(v: Views) -> DataFrame:
    return v.frames().filter(F.col("score_b") >= 0.62).select("frame_id", "score_b")


@query(
    "c06_review_queue",
    sql("frames", "SELECT frame_id, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS outcome FROM frames WHERE label <> (score_c >= 0.5)::INTEGER"),
)
def c06(v: Views) -> DataFrame:
    tag = outcome(F.col("label"), (F.col("score_c") >= 0.5).cast("int"))
    return m.review_queue(v.frames().select("frame_id", tag.alias("outcome")), ["FP", "FN"])


@query(
    "c07_inside_duration",
    sql(
        "event_times",
        """SELECT e.event_id, round(e.time_s + o.off, 6) AS video_ts FROM event_times e
           JOIN (SELECT record_id, max(time_s) * 0.9::DOUBLE AS dur, -min(value) * 1000.0::DOUBLE AS off FROM event_times GROUP BY 1) o ON e.record_id = o.record_id
           WHERE e.time_s + o.off >= 0 AND e.time_s + o.off < o.dur""",
    ),
)
def c07(v: Views) -> DataFrame:
    e = v.event_times()
    videos = e.groupBy("record_id").agg(
        (F.max("time_s") * F.lit(0.9)).alias("dur"), (-F.min("value") * F.lit(1000.0)).alias("off")
    )
    t = F.col("time_s") + F.col("off")
    return e.join(videos, "record_id").filter((t >= 0) & (t < F.col("dur"))).select("event_id", F.round(t, 6).alias("video_ts"))


@query(
    "c08_long_segments",
    sql("windows", "SELECT window_id FROM windows WHERE end_s - start_s > 300.0 AND lower(record_id) = lower('REC_7')"),
)
def c08(v: Views) -> DataFrame:
    w = v.windows()
    return w.filter((F.col("end_s") - F.col("start_s") > 300.0) & (F.lower("record_id") == F.lit("REC_7".lower()))).select("window_id")


@query(
    "c09_incremental_anti_join",
    sql("frames", "SELECT DISTINCT relative_path FROM frames WHERE relative_path NOT IN (SELECT relative_path FROM frames WHERE split <> 'test')"),
)
def c09(v: Views) -> DataFrame:
    f = v.frames()
    return m.new_items(f.select("relative_path"), f.filter(F.col("split") != "test")).distinct()


_RUNS = """runs AS (
  SELECT 'run_' || o_orderkey AS run_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'run_' || (o_orderkey - o_orderkey % 6) END AS parent_id,
         'model_' || (o_orderkey % 97) || CASE WHEN o_orderkey % 2 = 0 THEN '_cv' ELSE '_split' END AS run_name,
         o_orderpriority AS experiment, o_orderdate AS start_time FROM orders),
run_metrics AS (
  SELECT 'run_' || l_orderkey AS run_id, CASE l_returnflag WHEN 'R' THEN 'f1' WHEN 'A' THEN 'auroc' ELSE 'accuracy' END AS metric,
         max(l_discount * l_quantity / 5.0::DOUBLE) AS value FROM lineitem GROUP BY ALL)"""


def runs(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return v.table("orders").select(
        F.concat(F.lit("run_"), k.cast("string")).alias("run_id"),
        F.when(k % 6 != 0, F.concat(F.lit("run_"), (k - k % 6).cast("string"))).alias("parent_id"),
        F.concat(F.lit("model_"), (k % 97).cast("string"), F.when(k % 2 == 0, "_cv").otherwise("_split")).alias("run_name"),
        F.col("o_orderpriority").alias("experiment"), F.col("o_orderdate").alias("start_time"),
    )


def run_metrics(v: Views) -> DataFrame:
    metric = F.when(F.col("l_returnflag") == "R", "f1").when(F.col("l_returnflag") == "A", "auroc").otherwise("accuracy")
    return v.table("lineitem").groupBy(
        F.concat(F.lit("run_"), F.col("l_orderkey").cast("string")).alias("run_id"), metric.alias("metric")
    ).agg(F.max(F.col("l_discount") * F.col("l_quantity") / F.lit(5.0)).alias("value"))


@query("c10_top_level_runs", f"WITH {_RUNS} SELECT run_id, run_name FROM runs WHERE parent_id IS NULL")
def c10(v: Views) -> DataFrame:
    return report.top_level(runs(v)).select("run_id", "run_name")


# --------------------------------------------------------------------- joins


@query(
    "d01_size_lookup_join",
    sql(
        "sized",
        """SELECT f.frame_id, CASE WHEN f.label = 1 THEN l.code END AS ulcer_size FROM sized f LEFT JOIN (
             SELECT video_id, segment_number, max(ulcer_size) AS code FROM sized WHERE ulcer_size IS NOT NULL GROUP BY 1, 2) l
           ON f.video_id = l.video_id AND f.segment_number = l.segment_number""",
    ),
)
def d01(v: Views) -> DataFrame:
    sized = v.sized_frames()
    lookup = sized.filter("ulcer_size is not null").groupBy(
        F.col("video_id").alias("record_id"), F.col("segment_number").alias("sample_number")
    ).agg(F.max("ulcer_size").alias("size_code"))
    return m.attach_size(sized.drop("ulcer_size"), lookup).select("frame_id", "ulcer_size")


@query(
    "d02_video_index_join",
    sql(
        "windows",
        """SELECT w.window_id, CASE WHEN c_custkey IS NULL THEN 'video_not_found' ELSE 'REC_' || c_custkey || '.mov' END AS video
           FROM windows w LEFT JOIN customer ON lower('REC_' || c_custkey) = lower(record_id) AND c_nationkey < 20""",
    ),
)
def d02(v: Views) -> DataFrame:
    stem = F.concat(F.lit("REC_"), F.col("c_custkey").cast("string"))
    videos = v.table("customer").filter("c_nationkey < 20").select(stem.alias("stem"), F.concat(stem, F.lit(".mov")).alias("path"))
    matched, skipped = m.match_videos(v.windows(), videos)
    return matched.select("window_id", F.col("video_path").alias("video")).unionByName(
        skipped.select("window_id", F.col("reason").alias("video"))
    )


@query(
    "d03_clip_label_join",
    sql(
        "predictions",
        """SELECT p.model, p.clip_key, p.prob, l.label FROM
             (SELECT model, clip_key, round(avg(prob), 9) AS prob FROM predictions GROUP BY 1, 2) p
           JOIN (SELECT clip_key, (avg(label) > 0.5)::INTEGER AS label FROM frames WHERE split <> 'val' GROUP BY 1) l ON p.clip_key = l.clip_key""",
    ),
)
def d03(v: Views) -> DataFrame:
    known = v.frames().filter(F.col("split") != "val")
    out = report.heldout_clip_scores(v.predictions(), known, ["model"])
    return out.select("model", "clip_key", F.round("prob", 9).alias("prob"), "label")


@query(
    "d04_frames_of_chosen_clips",
    sql("frames", "SELECT frame_id FROM frames WHERE clip_key IN (SELECT clip_key FROM frames GROUP BY 1 HAVING count(*) >= 6)"),
)
def d04(v: Views) -> DataFrame:
    f = v.frames()
    chosen = f.groupBy("clip_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 6")
    return join_by_entity(f, chosen, ["clip_key"], "inner").select("frame_id")


@query(
    "d06_attach_scores_by_key",
    sql("frames", "SELECT frame_id, label, score_b AS prob FROM frames"),
)
def d06(v: Views) -> DataFrame:
    f = v.frames()
    return m.attach_predictions(f.select("frame_id", "label"), f.select("frame_id", F.col("score_b").alias("prob")))


@query(
    "d07_cached_feature_join",
    sql("frames", "SELECT l.frame_id, l.label, r.score_a FROM frames l JOIN frames r ON l.frame_id = r.frame_id WHERE r.split = 'test'"),
)
def d07(v: Views) -> DataFrame:
    f = v.frames()
    features = f.filter(F.col("split") == "test").select("frame_id", "score_a")
    return m.attach_features(features, f.select("frame_id", "label"), "frame_id").select("frame_id", "label", "score_a")


@query(
    "d09_parent_child_runs",
    f"""WITH {_RUNS} SELECT p.run_id AS parent_id, p.run_name AS parent_name, count(*) AS n_children FROM runs c JOIN runs p ON c.parent_id = p.run_id GROUP BY 1, 2""",
)
def d09(v: Views) -> DataFrame:
    return m.child_runs(runs(v)).groupBy("parent_id", "parent_name").agg(F.count(F.lit(1)).alias("n_children"))


@query(
    "d10_frames_in_windows",
    sql(
        "windows",
        """SELECT e.event_id, w.window_id, w.label FROM event_times e JOIN windows w
           ON e.record_id = w.record_id AND e.time_s >= w.start_s + 5.0 AND e.time_s < w.end_s + 5.0""",
    ),
)
def d10(v: Views) -> DataFrame:
    w = v.windows().withColumn("offset_s", F.lit(5.0))
    hits = m.frames_in_windows(v.event_times(), w, bucket_s=600.0, offset="offset_s")
    return hits.select("event_id", "window_id", "label")


@query(
    "d11_apply_review_log",
    sql(
        "causes",
        """SELECT c.doc_id, CASE WHEN r.doc_id IS NULL THEN c.label WHEN r.lab = 'Informative' THEN 1 ELSE 0 END AS label,
             CASE WHEN r.doc_id IS NULL THEN c.cause WHEN r.lab = 'Informative' THEN '' ELSE 'page ' || r.n END AS cause, r.doc_id IS NOT NULL AS reviewed
           FROM causes c LEFT JOIN (
             SELECT conv_id AS doc_id, max(turn) AS n, CASE WHEN max(turn) % 2 = 0 THEN 'Informative' ELSE 'Non-Informative' END AS lab
             FROM conversations GROUP BY 1) r ON c.doc_id = r.doc_id""",
    ),
)
def d11(v: Views) -> DataFrame:
    """Conversation turns stand for review log rows: the last turn decides."""
    log = v.table("conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("timestamp"),
        F.when(F.col("turn") % 2 == 0, "Informative").otherwise("Non-Informative").alias("new_label"),
        F.concat(F.lit("page "), F.col("turn").cast("string")).alias("new_cause"),
    )
    return m.apply_reviews(v.causes(), log, "doc_id").select("doc_id", "label", "cause", "reviewed")


# ------------------------------------------------------------- ordered picks


@query(
    "f06_first_item_per_video",
    sql("frames", "SELECT video_id, min(relative_path) AS relative_path FROM frames GROUP BY 1"),
)
def f06(v: Views) -> DataFrame:
    return m.first_item(v.frames().select("video_id", "relative_path"), ["video_id"], F.col("relative_path"))


_COPIES = """copies AS (SELECT md5(text) AS stem, lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, doc_id % 13 AS mtime FROM documents
   UNION ALL SELECT 'page' || page_id % 100, 'pages/' || lpad(page_id::VARCHAR, 9, '0'), page_id % 5 FROM pages)"""


def _copies(v: Views) -> DataFrame:
    docs = v.table("documents").select(
        F.md5("text").alias("stem"), F.concat_ws("/", "lang", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        (F.col("doc_id") % 13).alias("mtime"),
    )
    pages = v.table("pages").select(
        F.concat(F.lit("page"), (F.col("page_id") % 100).cast("string")).alias("stem"),
        F.concat(F.lit("pages/"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("path"), (F.col("page_id") % 5).alias("mtime"),
    )
    return docs.unionByName(pages)


@query(
    "f07_duplicate_keeper",
    f"""WITH {_COPIES}, d AS (SELECT *, count(*) OVER (PARTITION BY stem) AS n_copies,
           row_number() OVER (PARTITION BY stem ORDER BY starts_with(path, 'en/') DESC, mtime DESC, path) AS rn FROM copies)
       SELECT stem, path, mtime, n_copies, CASE WHEN rn = 1 THEN 'keep' ELSE 'delete' END AS action FROM d WHERE n_copies > 1""",
)
def f07(v: Views) -> DataFrame:
    return m.duplicate_actions(_copies(v), keep_prefix="en/").select("stem", "path", "mtime", "n_copies", "action")


@query("e27_duplicate_groups", f"WITH {_COPIES} SELECT stem, path, mtime, count(*) OVER (PARTITION BY stem) AS n_copies FROM copies QUALIFY n_copies > 1")
def e27(v: Views) -> DataFrame:
    return m.duplicate_report(_copies(v)).select("stem", "path", "mtime", "n_copies")


@query(
    "f08_best_run",
    f"""WITH {_RUNS}, j AS (SELECT experiment, r.run_id, m.value FROM runs r JOIN run_metrics m ON r.run_id = m.run_id WHERE metric = 'auroc' AND value > 0)
       SELECT experiment, run_id, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY value DESC, run_id) AS rn FROM j) WHERE rn = 1""",
)
def f08(v: Views) -> DataFrame:
    joined = runs(v).select("run_id", "experiment").join(run_metrics(v), "run_id")
    return report.best_run(joined, "auroc").withColumn("value", F.round("value", 9))


@query("f09_top_videos", sql("frames", "SELECT video_id, count(*) AS frames FROM frames GROUP BY 1 ORDER BY frames DESC, video_id LIMIT 20"))
def f09(v: Views) -> DataFrame:
    counts = v.frames().groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))
    return m.top_n(counts, 20, [F.col("frames").desc(), F.col("video_id")])


@query(
    "f10_compare_runs",
    f"""WITH {_RUNS}, w AS (SELECT run_id, max(CASE WHEN metric = 'f1' THEN value END) AS f1, max(CASE WHEN metric = 'auroc' THEN value END) AS auroc FROM run_metrics GROUP BY 1)
       SELECT r.run_id, run_name, round(f1, 9) AS f1, round(auroc, 9) AS auroc FROM runs r LEFT JOIN w ON r.run_id = w.run_id
       WHERE parent_id IS NULL ORDER BY w.f1 DESC NULLS LAST, r.run_id LIMIT 10""",
)
def f10(v: Views) -> DataFrame:
    top = report.compare_runs(runs(v), run_metrics(v), ["f1", "auroc"], 10)
    return top.select("run_id", "run_name", F.round("f1", 9).alias("f1"), F.round("auroc", 9).alias("auroc"))


@query("f11_sorted_windows", sql("windows", "SELECT record_id, start_s, end_s, window_id FROM windows ORDER BY record_id, start_s, window_id"))
def f11(v: Views) -> DataFrame:
    return v.windows().select("record_id", "start_s", "end_s", "window_id").orderBy("record_id", "start_s", "window_id")


@query(
    "h32_performance_report",
    f"""WITH {_RUNS}, w AS (SELECT run_id, max(CASE WHEN metric = 'f1' THEN value END) AS f1, max(CASE WHEN metric = 'auroc' THEN value END) AS auroc FROM run_metrics GROUP BY 1)
       SELECT r.run_id, regexp_replace(run_name, '(_split|_cv)$', '') AS display_name, round(f1, 9) AS f1, round(auroc, 9) AS auroc,
              round((f1 * 1.1::DOUBLE - f1 * 0.8::DOUBLE) / 2, 9) AS f1_half_width, round((auroc * 1.1::DOUBLE - auroc * 0.8::DOUBLE) / 2, 9) AS auroc_half_width
       FROM runs r LEFT JOIN w ON r.run_id = w.run_id WHERE parent_id IS NULL AND start_time >= TIMESTAMP '1997-01-01'""",
)
def h32(v: Views) -> DataFrame:
    metrics = run_metrics(v)
    bounds = metrics.withColumns({"lower": F.col("value") * F.lit(0.8), "upper": F.col("value") * F.lit(1.1)})
    out = report.performance_report(runs(v), metrics, bounds, "1997-01-01", ["f1", "auroc"])
    rounded = [F.round(c, 9).alias(c) for c in ("f1", "auroc", "f1_half_width", "auroc_half_width")]
    return out.select("run_id", "display_name", *rounded)


# ------------------------------------------------------------ set operations


@query(
    "s01_union_of_sheets",
    sql("windows", "SELECT label, count(*) AS n, count(window_id) AS n_ids FROM windows GROUP BY 1"),
)
def s01(v: Views) -> DataFrame:
    w = v.windows()
    sheets = [w.filter(F.col("label") == i).drop("label") for i in (1, 0)]
    both = sheets[0].withColumn("label", F.lit(1)).unionByName(sheets[1].withColumn("label", F.lit(0)))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("window_id").alias("n_ids"))


CLIP_SPLIT_SQL = "leaky AS (SELECT *, CASE WHEN segment_number % 10 < 7 THEN 'train' WHEN segment_number % 10 < 9 THEN 'val' ELSE 'test' END AS clip_split FROM frames)"


def leaky_frames(v: Views) -> DataFrame:
    """Frames split by clip instead of by patient, so that patients leak."""
    k = F.col("segment_number") % 10
    return v.frames().withColumn("split", F.when(k < 7, "train").when(k < 9, "val").otherwise("test"))


@query(
    "s02_shared_patients",
    sql("frames", "SELECT patient_id FROM leaky WHERE clip_split = 'train' INTERSECT SELECT patient_id FROM leaky WHERE clip_split = 'test'", CLIP_SPLIT_SQL),
)
def s02(v: Views) -> DataFrame:
    return quality.shared_patients(leaky_frames(v), "train", "test")


@query(
    "s03_negative_only_patients",
    sql("frames", "SELECT DISTINCT patient_id FROM frames WHERE label = 0 EXCEPT SELECT patient_id FROM frames WHERE label = 1"),
)
def s03(v: Views) -> DataFrame:
    return quality.one_class_patients(v.frames())


# ----------------------------------------------------------------- sampling


@query(
    "g08_random_intervals",
    """WITH v AS (SELECT o_custkey AS video_id, count(*) * 40 AS total FROM orders GROUP BY 1),
         g AS (SELECT video_id, unnest(range(0, total - 75, 75)) AS start_frame FROM v),
         r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5(concat_ws('|', '42', video_id, start_frame)), start_frame) AS rn FROM g)
       SELECT video_id, start_frame, start_frame + 75 AS end_frame FROM r WHERE rn <= 3""",
)
def g08(v: Views) -> DataFrame:
    videos = v.table("orders").groupBy(F.col("o_custkey").alias("video_id")).agg(
        (F.count(F.lit(1)) * 40).alias("total_frames"), F.lit(25.0).alias("fps")
    )
    return sampling.sample_intervals(videos, 3.0, 3)


@query(
    "g09_segment_intervals",
    sql(
        "windows",
        """SELECT window_id, floor((start_s + off) * 25.0)::BIGINT AS start_frame, floor((start_s + off + 120.0) * 25.0)::BIGINT AS end_frame FROM (
             SELECT window_id, start_s, ('0x' || substr(md5(concat_ws('|', '42', window_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (end_s - start_s - 120.0::DOUBLE) AS off
             FROM windows WHERE end_s - start_s > 120.0)""",
    ),
)
def g09(v: Views) -> DataFrame:
    w = v.windows().withColumn("fps", F.lit(25.0))
    return sampling.sample_segment_intervals(w, 120.0, key=["window_id"]).select("window_id", "start_frame", "end_frame")


@query(
    "g10_frame_queue",
    """SELECT o_orderkey, f AS frame_idx, round(f / 29.97::DOUBLE, 9) AS timestamp_s FROM (
         SELECT o_orderkey, unnest(range(o_custkey, o_custkey + o_orderkey % 90, 5)) AS f FROM orders)""",
)
def g10(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    intervals = v.table("orders").select(
        k, F.col("o_custkey").alias("start_frame"), (F.col("o_custkey") + k % 90).alias("end_frame"), F.lit(29.97).alias("fps")
    )
    queue = sampling.build_frame_queue(intervals, sample_fps=5.0)
    return queue.select("o_orderkey", "frame_idx", F.round("timestamp_s", 9).alias("timestamp_s"))


@query(
    "g11_timestamp_grid",
    sql(
        "windows",
        """SELECT window_id, frame_number, round(t, 9) AS timestamp_s FROM (
             SELECT window_id, round_even(t * 30.0, 0)::BIGINT AS frame_number, t FROM (
               SELECT window_id, start_s + i * 4.0::DOUBLE - 300.0::DOUBLE AS t FROM (
                 SELECT window_id, start_s, unnest(range(0, ceil((end_s - start_s) / 4.0::DOUBLE)::BIGINT)) AS i FROM windows WHERE end_s > start_s))
             WHERE t >= 0 AND t < 2500000.0)""",
    ),
)
def g11(v: Views) -> DataFrame:
    w = v.windows().withColumns({"offset": F.lit(-300.0), "fps": F.lit(30.0), "duration": F.lit(2500000.0)})
    grid = sampling.sample_timestamps(w, 0.25, offset="offset", fps="fps", duration="duration")
    return grid.select("window_id", "frame_number", F.round("timestamp_s", 9).alias("timestamp_s"))


@query(
    "g13_random_sample",
    sql(
        "frames",
        """SELECT 'overall' AS sample, frame_id FROM (SELECT frame_id FROM frames ORDER BY md5(concat_ws('|', '42', frame_id)), frame_id LIMIT 500)
           UNION ALL SELECT 'per class', frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', frame_id)), frame_id) AS rn FROM frames) WHERE rn <= 1500""",
    ),
)
def g13(v: Views) -> DataFrame:
    f = v.frames().select("frame_id", "label")
    overall = sampling.sample_rows(f, 500).select(F.lit("overall").alias("sample"), "frame_id")
    per_class = sampling.sample_rows(f, 1500, per=["label"]).select(F.lit("per class").alias("sample"), "frame_id")
    return overall.unionByName(per_class)


@query(
    "g14_every_nth",
    sql(
        "frames",
        """SELECT 'number' AS mode, frame_id FROM frames WHERE frame_number % 7 = 0
           UNION ALL SELECT 'rank', frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_number, frame_id) AS rn FROM frames) WHERE (rn - 1) % 5 = 0""",
    ),
)
def g14(v: Views) -> DataFrame:
    f = v.frames().select("frame_id", "video_id", "frame_number")
    ranked = sampling.every_nth_ranked(f, 5, ["video_id"], ["frame_number", "frame_id"])
    return sampling.every_nth(f, 7).select(F.lit("number").alias("mode"), "frame_id").unionByName(
        ranked.select(F.lit("rank").alias("mode"), "frame_id")
    )


@query(
    "f05_uniform_stride",
    sql(
        "frames",
        """SELECT frame_id FROM (SELECT frame_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_number, frame_id) - 1 AS r,
              count(*) OVER (PARTITION BY video_id) AS n FROM frames) q
           WHERE n <= 9 OR list_contains(list_transform(range(0, 9), lambda i: CASE WHEN i = 8 THEN (n - 1)::DOUBLE ELSE round_even(i * ((n - 1) / 8.0::DOUBLE), 0) END), r::DOUBLE)""",
    ),
)
def f05(v: Views) -> DataFrame:
    f = v.frames().select("frame_id", "video_id", "frame_number")
    return sampling.uniform_stride(f, ["video_id"], ["frame_number", "frame_id"], 9).select("frame_id")


@query("g12_diversity_sample")
def g12(v: Views) -> DataFrame:
    """Farthest-point picks per embedding label (iterative: checked against brute force in the tests)."""
    return sampling.diversity_sample(v.table("embeddings"), "label", "vec_id", "embedding", 12)


@query(
    "f03_topk_mean",
    sql(
        "frames",
        """SELECT video_id, n AS n_frames, k, round(sum(score_a) / k, 9) AS topk_mean FROM (
             SELECT video_id, score_a, row_number() OVER (PARTITION BY video_id ORDER BY score_a DESC) AS rn, count(*) OVER (PARTITION BY video_id) AS n,
                    greatest(1, ceil(count(*) OVER (PARTITION BY video_id) * 0.3::DOUBLE))::BIGINT AS k FROM frames) WHERE rn <= k GROUP BY 1, 2, 3""",
    ),
)
def f03(v: Views) -> DataFrame:
    out = topk_mean(v.frames(), ["video_id"], 0.3, "score_a")
    return out.withColumn("topk_mean", F.round("topk_mean", 9))
