"""Score-and-route of arriving items into kept, rejected and uncertain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.functions.outcomes import route


def routed(stream: DataFrame, threshold: float, epsilon: float = 0.0, prob: str = "prob") -> DataFrame:
    return stream.withColumns(
        {
            "pred_label": (F.col(prob) >= F.lit(float(threshold))).cast("int"),
            "category": route(F.col(prob), threshold, epsilon),
        }
    )


def _batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch id: a replayed batch overwrites itself
        marked = batch.withColumn("batch_id", F.lit(batch_id))
        marked.write.mode("overwrite").partitionBy("category").parquet(f"{path}/routed/batch={batch_id}")
        # counted from what was written: the batch is scored once
        written = batch.sparkSession.read.parquet(f"{path}/routed/batch={batch_id}")
        counts = written.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return write


def route_stream(stream: DataFrame, path: str, checkpoint: str, threshold: float, epsilon: float = 0.0, prob: str = "prob"):
    """Route arriving rows; each batch writes its rows by category and its counts."""
    return (
        routed(stream, threshold, epsilon, prob)
        .writeStream.foreachBatch(_batch_writer(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(spark, path: str) -> DataFrame:
    """Rows per category over all batches so far."""
    return spark.read.parquet(f"{path}/counts").groupBy("category").agg(F.sum("n").alias("n"))
