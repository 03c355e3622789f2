"""The given tables seen as frames, clips, patients, predictions and annotations.

Each view exists twice: as a DataFrame for the Spark plans and as a common table
expression for the SQL that checks them.

lineitem row = frame, order = segment/clip, customer = video and patient,
return flag 'R' = positive label, part size third = size code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplab.functions.hashing import digest_int, digest_uniform, seeded_digest
from cliplab.sources.tables import spread

SEED = 42
MODELS = ("forest-allBackbone", "linear-freezeBackbone", "blend")


def _hash_split(key: Column) -> Column:
    u = digest_uniform(seeded_digest(SEED, key))
    return F.when(u < 0.70, "train").when(u < 0.85, "val").otherwise("test")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fact(self, name: str, *keys: str) -> DataFrame:
        return spread(self.table(name), *keys)

    def frames(self, rows: int | None = None) -> DataFrame:
        """Manifest rows; scores score_a..score_c ride along and are pruned when unused.

        `rows` bounds the rows of a task for queries that sort their text (see `spread`).
        """
        # numbers travel to the join, text is made from them behind it
        li = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) * 8 + F.col("l_linenumber"))
            .cast("int")
            .alias("frame_number"),
        )
        li = spread(li, "l_orderkey", rows=rows)
        video = F.concat(F.lit("vid_"), F.col("o_custkey").cast("string"))
        # split and fold are hashed once per order, not once per frame
        orders = self.table("orders").select(
            "o_orderkey",
            video.alias("video_id"),
            _hash_split(video).alias("split"),
            (digest_int(seeded_digest(SEED, video)) % 5).cast("int").alias("fold"),
        )
        j = li.join(orders, li.l_orderkey == orders.o_orderkey).withColumns(
            {
                "frame_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
                "score_a": F.col("l_quantity") / F.lit(50.0),
                "score_b": (F.col("l_extendedprice") % F.lit(1000.0)) / F.lit(1000.0),
            }
        )
        video = F.col("video_id")
        segment = F.concat(F.when(F.col("label") == 1, "ulcer_").otherwise("normal_"), F.col("l_orderkey").cast("string"))
        cls = F.when(F.col("label") == 1, "Ulcer").otherwise("NonUlcer")
        return j.select(
            "frame_id",
            "video_id",
            video.alias("patient_id"),
            cls.alias("class_name"),
            "label",
            segment.alias("segment_id"),
            F.col("l_orderkey").cast("int").alias("segment_number"),
            "frame_number",
            F.concat_ws("__", video, F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"))).alias("clip_key"),
            F.concat_ws(
                "/", cls, video, segment, F.concat(F.lit("frame_"), F.col("frame_number").cast("string"), F.lit(".jpg"))
            ).alias("relative_path"),
            "l_partkey",
            "split",
            "fold",
            "score_a",
            "score_b",
            (F.lit(0.7) * F.col("score_b") + F.lit(0.3) * F.col("label")).alias("score_c"),
        )

    def sized_frames(self) -> DataFrame:
        """Frames with the size code of their part, for positive rows only."""
        size = F.when(F.col("p_size") <= 16, 1).when(F.col("p_size") <= 33, 2).when(F.col("p_size") <= 45, 3)
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), size.alias("__size"))
        return (
            self.frames()
            .join(part, "l_partkey", "left")
            .withColumn("ulcer_size", F.when(F.col("label") == 1, F.col("__size")))
            .drop("__size")
        )

    def predictions(self, rows: int | None = None) -> DataFrame:
        """Long fact table (model, fold, frame_id, clip_key, patient_id, label, prob)."""
        scores = F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.col(c).alias("prob"))
                for m, c in zip(MODELS, ("score_a", "score_b", "score_c"), strict=True)
            ]
        )
        frames = self.frames(rows).select(
            "fold", "frame_id", "clip_key", "patient_id", "split", "frame_number", "label", F.explode(scores).alias("s")
        )
        return frames.select(
            "s.model", "fold", "frame_id", "clip_key", "patient_id", "split", "frame_number", "label", "s.prob"
        )

    def causes(self) -> DataFrame:
        """Informative / non-informative rows of documents: quality label, cause from the language."""
        docs = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        labels = self.table("labels")
        cause = F.when(F.col("quality") == 1, "").when(F.col("lang") == "en", "motion blur").when(
            F.col("lang") == "fr", "low  light"
        ).when(F.col("lang") == "de", "debris")
        return docs.join(labels, "doc_id").select(
            "doc_id", F.col("source").alias("sample_id"), F.col("quality").cast("int").alias("label"),
            F.col("toxic").cast("int").alias("toxic"), "n_chars", cause.alias("cause"),
            _hash_split(F.col("doc_id").cast("string")).alias("split"),
            ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("prob"),
        )

    def event_times(self) -> DataFrame:
        """Events with seconds since 2024-01-01 as time_s and the user as record id."""
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", start, F.col("ts"))
        return self.table("events").select(
            "event_id", "ts", "event_type", "value",
            F.concat(F.lit("Rec_"), F.col("user_id").cast("string")).alias("record_id"),
            (micros / F.lit(1000000.0)).alias("time_s"),
        )

    def windows(self) -> DataFrame:
        """Annotation windows: click and view events open a window of 10 x value seconds."""
        e = self.event_times().filter(F.col("event_type").isin("click", "view"))
        return e.select(
            F.col("event_id").alias("window_id"), "record_id", F.col("time_s").alias("start_s"),
            (F.col("time_s") + F.col("value") * 10.0).alias("end_s"),
            (F.col("event_type") == "click").cast("int").alias("label"),
        )


# ------------------------------------------------------------------ the same in SQL

HASH = "('0x' || substr(md5(concat_ws('|', '42', {key})), 1, 8))::BIGINT"


def _split_sql(key: str) -> str:
    u = f"({HASH.format(key=key)} / 4294967296.0::DOUBLE)"
    return f"CASE WHEN {u} < 0.70 THEN 'train' WHEN {u} < 0.85 THEN 'val' ELSE 'test' END"


FRAMES = f"""frames AS (
  SELECT frame_id, video_id, video_id AS patient_id, class_name, label, segment_id, segment_number, frame_number,
         video_id || '__order_' || l_orderkey AS clip_key,
         class_name || '/' || video_id || '/' || segment_id || '/frame_' || frame_number || '.jpg' AS relative_path,
         l_partkey, {_split_sql('video_id')} AS split, ({HASH.format(key='video_id')} % 5)::INTEGER AS fold,
         score_a, score_b, 0.7::DOUBLE * score_b + 0.3::DOUBLE * label AS score_c
  FROM (
    SELECT l_orderkey, l_partkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS frame_id,
           'vid_' || o_custkey AS video_id,
           CASE WHEN l_returnflag = 'R' THEN 'Ulcer' ELSE 'NonUlcer' END AS class_name,
           (l_returnflag = 'R')::INTEGER AS label,
           CASE WHEN l_returnflag = 'R' THEN 'ulcer_' ELSE 'normal_' END || l_orderkey AS segment_id,
           l_orderkey::INTEGER AS segment_number,
           (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 8 + l_linenumber)::INTEGER AS frame_number,
           l_quantity / 50.0::DOUBLE AS score_a, (l_extendedprice % 1000.0::DOUBLE) / 1000.0::DOUBLE AS score_b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""

SIZED = """sized AS (
  SELECT f.*, CASE WHEN label = 1 THEN CASE WHEN p_size <= 16 THEN 1 WHEN p_size <= 33 THEN 2 WHEN p_size <= 45 THEN 3 END END AS ulcer_size
  FROM frames f LEFT JOIN part ON l_partkey = p_partkey)"""

PREDICTIONS = """predictions AS (
  SELECT 'forest-allBackbone' AS model, fold, frame_id, clip_key, patient_id, split, frame_number, label, score_a AS prob FROM frames
  UNION ALL SELECT 'linear-freezeBackbone', fold, frame_id, clip_key, patient_id, split, frame_number, label, score_b FROM frames
  UNION ALL SELECT 'blend', fold, frame_id, clip_key, patient_id, split, frame_number, label, score_c FROM frames)"""

CAUSES = f"""causes AS (
  SELECT d.doc_id, source AS sample_id, quality::INTEGER AS label, toxic::INTEGER AS toxic, n_chars,
         CASE WHEN quality = 1 THEN '' WHEN lang = 'en' THEN 'motion blur' WHEN lang = 'fr' THEN 'low  light' WHEN lang = 'de' THEN 'debris' END AS cause,
         {_split_sql('d.doc_id')} AS split, (n_chars % 1000) / 1000.0::DOUBLE AS prob
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EVENT_TIMES = """event_times AS (
  SELECT event_id, ts, event_type, value, 'Rec_' || user_id AS record_id,
         date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1000000.0::DOUBLE AS time_s
  FROM events)"""

WINDOWS = """windows AS (
  SELECT event_id AS window_id, record_id, time_s AS start_s, time_s + value * 10.0::DOUBLE AS end_s, (event_type = 'click')::INTEGER AS label
  FROM event_times WHERE event_type IN ('click', 'view'))"""

_NEEDS = {
    "frames": (FRAMES,), "sized": (FRAMES, SIZED), "predictions": (FRAMES, PREDICTIONS), "causes": (CAUSES,),
    "event_times": (EVENT_TIMES,), "windows": (EVENT_TIMES, WINDOWS),
}


def sql(view: str, body: str, *ctes: str) -> str:
    """`body` over a view, with further common table expressions in between."""
    return "WITH " + ",\n".join([*_NEEDS[view], *ctes]) + "\n" + body
