"""Queries for incremental ingest and stream routing (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.plans.manifests import scratch
from cliplab.plans.registry import query
from cliplab.plans.views import Views
from cliplab.streaming import ingest, routing


def _event_stream(v: Views) -> DataFrame:
    schema = v.table("events").schema
    reader = v.spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet")
    return reader.load(v.sf_dir)


@query("j01_ingest_once", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_items FROM events GROUP BY 1")
def j01(v: Views) -> DataFrame:
    """Every event arrives twice, late and in other files; each is stored once."""
    path = scratch(v, "ingest")
    twice = v.table("events").select("event_id", "ts", "event_type").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    arrival = F.pmod(F.xxhash64("event_id") + F.col("copy") * 3, F.lit(5))
    twice.withColumn("file", arrival).repartition("file").write.partitionBy("file").parquet(f"{path}/arriving")
    arriving = v.spark.read.parquet(f"{path}/arriving")
    stream = ingest.file_stream(v.spark, f"{path}/arriving", arriving.schema, files_per_batch=2)
    ingest.ingest_once(stream, f"{path}/table", f"{path}/checkpoint", "event_id", "ts").awaitTermination()
    stored = v.spark.read.parquet(f"{path}/table")
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_items"))


@query(
    "j02_route_stream",
    """SELECT CASE WHEN abs(p - 0.5) < 0.1 THEN 'uncertain' WHEN p >= 0.55 THEN 'informative' ELSE 'non_informative' END AS category, count(*) AS n
       FROM (SELECT (value % 10) / 10.0::DOUBLE AS p FROM events) GROUP BY 1""",
)
def j02(v: Views) -> DataFrame:
    path = scratch(v, "route")
    scored = _event_stream(v).select("event_id", ((F.col("value") % 10) / F.lit(10.0)).alias("prob"))
    routing.route_stream(scored, path, f"{path}/checkpoint", 0.55, 0.1).awaitTermination()
    return routing.running_counts(v.spark, path)
