"""Queries for the parsing functions (B) over texts built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.functions import outcomes, parse
from cliplab.operators.manifest import overlay_offset
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql


@query(
    "b01_hms_to_seconds",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
         ELSE hour(ts) * 3600.0::DOUBLE + minute(ts) * 60.0::DOUBLE + second(ts)::DOUBLE END AS seconds FROM events""",
)
def b01(v: Views) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", " HH:mm:ss"))
    return v.table("events").select("event_id", parse.hms_to_seconds(text).alias("seconds"))


@query(
    "b02_parse_timestamp",
    """SELECT event_id, CASE event_type
         WHEN 'click' THEN hour(ts) * 3600.0::DOUBLE + minute(ts) * 60.0::DOUBLE + second(ts)::DOUBLE + 0.5::DOUBLE
         WHEN 'view' THEN minute(ts) * 60.0::DOUBLE + second(ts)::DOUBLE END AS seconds FROM events""",
)
def b02(v: Views) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.date_format("ts", "H:mm:ss"), F.lit(",5")))
        .when(F.col("event_type") == "view", F.date_format("ts", "m:ss"))
        .when(F.col("event_type") == "error", F.date_format("ts", "HH:mm:s:"))
    )
    return v.table("events").select("event_id", parse.parse_timestamp(text).alias("seconds"))


@query(
    "b03_segment_number",
    sql("frames", """SELECT frame_id, CASE WHEN label = 1 THEN segment_number ELSE -1 END AS segment_number FROM frames"""),
)
def b03(v: Views) -> DataFrame:
    text = F.when(F.col("label") == 1, F.col("segment_id")).otherwise(F.concat("segment_id", F.lit("_x")))
    return v.frames().select("frame_id", parse.segment_number(text).alias("segment_number"))


@query(
    "b04_frame_number",
    sql("frames", """SELECT frame_id, CASE WHEN label = 1 THEN frame_number ELSE -1 END AS frame_number FROM frames"""),
)
def b04(v: Views) -> DataFrame:
    name = F.when(F.col("label") == 1, parse.path_component(F.col("relative_path"), 3)).otherwise("frame.jpg")
    return v.frames().select("frame_id", parse.frame_number(name).alias("frame_number"))


_SAMPLE_TEXT = "concat('vid_', l_orderkey, '__', CASE WHEN l_returnflag = 'R' THEN 'Sample' WHEN l_returnflag = 'A' THEN 'ulcer_NonUlcer' ELSE 'other' END, '_', l_linenumber, '__frame_', l_partkey)"


@query(
    "b05_parse_filename",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag <> 'N' THEN 'vid_' || l_orderkey END AS record_id,
         CASE l_returnflag WHEN 'R' THEN 'Sample_' || l_linenumber WHEN 'A' THEN 'ulcer_NonUlcer_' || l_linenumber END AS unique_sample_id,
         CASE WHEN l_returnflag <> 'N' THEN l_partkey::INTEGER END AS frame_number FROM lineitem""",
)
def b05(v: Views) -> DataFrame:
    parsed = v.table("lineitem").withColumn("p", parse.sample_name(F.expr(_SAMPLE_TEXT)))
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*")


@query(
    "b06_normalize_video_id",
    """SELECT c_custkey, 'customer#' || lpad(c_custkey::VARCHAR, 9, '0') || '_' || lower(c_mktsegment) AS video_id FROM customer""",
)
def b06(v: Views) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit(" -\t"), F.col("c_mktsegment"), F.lit(" "))
    return v.table("customer").select("c_custkey", parse.normalize_video_id(raw).alias("video_id"))


@query(
    "b07_clean_stopwatch_text",
    r"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (
         SELECT doc_id, regexp_replace(translate(upper(replace(text, 'ß', 'SS')), 'OSIL', '0511'), '[^0-9:\-\n ]', ' ', 'g') AS t FROM documents)""",
)
def b07(v: Views) -> DataFrame:
    t = parse.clean_stopwatch_text(F.col("text"))
    return v.table("documents").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("digest"))


def _stopwatch_rows(v: Views) -> DataFrame:
    """Overlay texts with letters read for digits: hours, minutes only, or unreadable."""
    stamp = F.date_format("ts", "HH:mm:ss")
    later = F.date_format(F.col("ts") + F.expr("interval 25 minutes"), "HH:mm:ss")
    two = F.concat(F.lit("#a "), F.translate(stamp, "015", "oIs"), F.lit("\n t "), later)
    text = (
        F.when(F.col("event_type").isin("click", "view"), two)
        .when(F.col("event_type") == "error", F.concat(F.lit("x "), F.date_format("ts", "m : ss"), F.lit(" y")))
        .otherwise("no clock")
    )
    hint = F.when(F.col("event_type") == "view", F.col("value").cast("double"))
    return v.fact("events", "event_id").select("event_id", "user_id", text.alias("text"), hint.alias("hint"))


_CLOCK = """clock AS (
  SELECT event_id, user_id, event_type, value, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS t1,
         (hour(ts + INTERVAL 25 MINUTE) * 3600 + minute(ts + INTERVAL 25 MINUTE) * 60 + second(ts + INTERVAL 25 MINUTE)) AS t2,
         minute(ts) * 60 + second(ts) AS short FROM events)"""
_READ = """CASE WHEN event_type = 'click' THEN CASE WHEN t1 < 3600 THEN t1 ELSE t2 END
     WHEN event_type = 'view' THEN CASE WHEN abs(t2 % 3600 - value % 3600.0::DOUBLE) < abs(t1 % 3600 - value % 3600.0::DOUBLE) THEN t2 ELSE t1 END
     WHEN event_type = 'error' THEN short END"""


@query(
    "b08_stopwatch_seconds",
    f"""WITH {_CLOCK} SELECT event_id, (CASE WHEN event_type = 'click' AND t1 >= 3600 AND t2 < 3600 THEN t2 ELSE {_READ} END)::BIGINT AS seconds FROM clock""",
)
def b08(v: Views) -> DataFrame:
    return _stopwatch_rows(v).select("event_id", parse.stopwatch_seconds(F.col("text"), hint=F.col("hint")).alias("seconds"))


@query(
    "b09_overlay_offset",
    f"""WITH {_CLOCK}, read AS (
         SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN
             CASE WHEN abs(t2 % 3600 - value % 3600.0::DOUBLE) < abs(t1 % 3600 - value % 3600.0::DOUBLE) THEN t2 ELSE t1 END
           WHEN event_type = 'error' THEN short END AS overlay, value FROM clock)
       SELECT user_id, round(arg_min(value - overlay, event_id), 6) AS offset_s FROM read WHERE overlay IS NOT NULL GROUP BY 1""",
)
def b09(v: Views) -> DataFrame:
    rows = _stopwatch_rows(v).drop("hint").join(v.table("events").select("event_id", "value"), "event_id")
    probes = rows.withColumns({"probe_order": F.col("event_id"), "probe_s": F.col("value").cast("double")})
    return overlay_offset(probes, "user_id").select("user_id", F.round("offset_s", 6).alias("offset_s"))


@query("b10_clip_key", sql("frames", "SELECT frame_id, video_id || '__' || segment_id AS clip_key FROM frames"))
def b10(v: Views) -> DataFrame:
    return v.frames().select("frame_id", parse.clip_key(F.col("video_id"), F.col("segment_id")).alias("clip_key"))


_SIZE_TEXT = "CASE WHEN p_size <= 16 THEN '<5mm' WHEN p_size <= 33 THEN ' 5-20mm ' WHEN p_size <= 45 THEN '>20mm' ELSE 'n/a' END"
_SIZE_CODE = "CASE WHEN p_size <= 16 THEN 1 WHEN p_size <= 33 THEN 2 WHEN p_size <= 45 THEN 3 END"


@query(
    "b11_size_codes",
    f"""SELECT p_partkey, {_SIZE_CODE} AS size_code,
         CASE WHEN p_size > 45 THEN 'unknown' ELSE trim({_SIZE_TEXT}) END AS size_label,
         CASE WHEN p_size <= 16 THEN 0 WHEN p_size <= 33 THEN 1 WHEN p_size <= 45 THEN 2 ELSE 3 END AS size_rank FROM part""",
)
def b11(v: Views) -> DataFrame:
    coded = v.table("part").select("p_partkey", parse.size_code(F.expr(_SIZE_TEXT)).alias("size_code"))
    named = coded.withColumn("size_label", parse.size_label(F.col("size_code")))
    return named.withColumn("size_rank", parse.size_rank(F.col("size_label")))


@query(
    "b12_cause_stratum",
    sql(
        "causes",
        r"""SELECT doc_id, CASE WHEN label = 1 THEN 'informative' WHEN trim(coalesce(cause, '')) = '' THEN 'non_informative__none'
         ELSE 'non_informative__' || regexp_replace(trim(cause), '\s+', '_', 'g') END AS stratum FROM causes""",
    ),
)
def b12(v: Views) -> DataFrame:
    return v.causes().select("doc_id", parse.cause_stratum(F.col("label"), F.col("cause")).alias("stratum"))


@query(
    "b13_safe_cause_and_clock",
    r"""SELECT event_id, coalesce(nullif(trim(regexp_replace(trim(event_type || ' / ' || CASE WHEN event_id % 7 = 0 THEN '' ELSE props END), '[^A-Za-z0-9_\-]', '_', 'g'), '_'), ''), 'Unknown') AS cause,
         printf('%02d:%02d:', floor(value / 3600)::BIGINT, floor(value / 60)::BIGINT % 60) || lpad(printf('%.2f', value - floor(value / 60) * 60), 5, '0') AS clock
       FROM events""",
)
def b13(v: Views) -> DataFrame:
    extra = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("props"))
    cause = F.concat("event_type", F.lit(" / "), extra)
    return v.table("events").select(
        "event_id", parse.safe_cause(cause).alias("cause"), parse.seconds_to_text(F.col("value")).alias("clock")
    )


@query(
    "b14_model_display_name",
    sql(
        "predictions",
        """SELECT CASE model WHEN 'forest-allBackbone' THEN 'Forest' WHEN 'linear-freezeBackbone' THEN 'linear' ELSE model END AS display_name,
         count(*) AS n FROM predictions GROUP BY 1""",
    ),
)
def b14(v: Views) -> DataFrame:
    name = parse.model_display_name(F.col("model"), {"forest": "Forest"})
    return v.predictions().groupBy(name.alias("display_name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_outcome_tag",
    sql(
        "frames",
        """SELECT frame_id, CASE WHEN label = 1 AND score_c >= 0.5 THEN 'TP' WHEN label = 0 AND score_c >= 0.5 THEN 'FP'
              WHEN label = 0 THEN 'TN' ELSE 'FN' END AS outcome,
         ((score_c >= 0.5)::INTEGER = label)::INTEGER AS correct,
         CASE WHEN score_c >= 0.5 THEN 'Informative' ELSE 'Non-Informative' END AS pred_name FROM frames""",
    ),
)
def b15(v: Views) -> DataFrame:
    pred = (F.col("score_c") >= 0.5).cast("int")
    return v.frames().select(
        "frame_id", outcomes.outcome(F.col("label"), pred).alias("outcome"), (pred == F.col("label")).cast("int").alias("correct"),
        outcomes.label_name(pred).alias("pred_name"),
    )


@query(
    "b16_three_way_routing",
    sql(
        "frames",
        """SELECT frame_id, CASE WHEN abs(score_a - 0.5) < 0.15 THEN 'uncertain' WHEN score_a >= 0.6 THEN 'informative' ELSE 'non_informative' END AS category FROM frames""",
    ),
)
def b16(v: Views) -> DataFrame:
    return v.frames().select("frame_id", outcomes.route(F.col("score_a"), 0.6, 0.15).alias("category"))


@query(
    "b17_interval_text",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '0.5 (CI unavailable)' ELSE '0.5 (0.25–0.75)' END AS ci FROM orders""",
)
def b17(v: Views) -> DataFrame:
    lower = F.when(F.col("o_orderkey") % 3 != 0, F.lit(0.25))
    return v.table("orders").select("o_orderkey", outcomes.format_interval(F.lit(0.5), lower, F.lit(0.75)).alias("ci"))


@query("b18_video_from_path", sql("frames", "SELECT video_id, count(*) AS n FROM frames GROUP BY 1"))
def b18(v: Views) -> DataFrame:
    return v.frames().groupBy(parse.path_component(F.col("relative_path"), 1).alias("video_id")).agg(F.count(F.lit(1)).alias("n"))


# The device rules, first match wins, and the class of the rest.
DEVICE_RULES = (
    ("Olympus", [("total", "<", 1.0)]),
    ("Fuji", [("g", ">", 20.0), ("r", "<", 10.0)]),
    ("Olympus", [("total", ">=", 12.0), ("total", "<=", 16.0), ("gap", "<", 1.0)]),
    ("Fuji", [("g", ">", 25.0)]),
)


@query(
    "b19_device_class",
    """SELECT o.l_orderkey, CASE WHEN total < 1.0 THEN 'Olympus' WHEN g > 20.0 AND r < 10.0 THEN 'Fuji'
         WHEN total BETWEEN 12.0 AND 16.0 AND abs(b - r) < 1.0 THEN 'Olympus' WHEN g > 25.0 THEN 'Fuji' ELSE 'Olympus' END AS device
       FROM (SELECT l_orderkey, min(l_quantity) AS b, avg(l_quantity) AS g, min(l_quantity) + 2 * min(l_discount) AS r,
                    (min(l_quantity) * 2 + max(l_quantity)) / 3 AS total FROM lineitem GROUP BY 1) o""",
)
def b19(v: Views) -> DataFrame:
    q = F.min("l_quantity")
    stats = v.table("lineitem").groupBy("l_orderkey").agg(
        q.alias("b"), F.avg("l_quantity").alias("g"), (q + 2 * F.min("l_discount")).alias("r"),
        ((q * 2 + F.max("l_quantity")) / 3).alias("total"),
    )
    values = {c: F.col(c) for c in ("g", "r", "total")} | {"gap": F.abs(F.col("b") - F.col("r"))}
    return stats.select("l_orderkey", outcomes.first_rule(values, DEVICE_RULES, "Olympus").alias("device"))
