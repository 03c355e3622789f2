"""Writing manifests, routing logs, tables and interval reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.operators.quality import patient_profile, routing_summary
from cliplab.operators.splits import split_info


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest partitioned by split, plus split and patient summaries as JSON rows."""
    manifest.write.mode("overwrite").partitionBy("split").parquet(f"{path}/manifest")
    split_info(manifest).write.mode("overwrite").json(f"{path}/split_info")
    patient_profile(manifest).write.mode("overwrite").json(f"{path}/patient_info")


def write_routing(routed: DataFrame, path: str, threshold: float, epsilon: float = 0.0) -> None:
    """Routing log partitioned by category and its one-row summary."""
    routed.write.mode("overwrite").partitionBy("category").parquet(f"{path}/predictions")
    routing_summary(routed, threshold, epsilon).write.mode("overwrite").json(f"{path}/filter_stats")


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.json)(f"{path}/{name}")


def interval_rows(intervals: DataFrame) -> DataFrame:
    """Interval rows as stored: metrics without an interval left out, 4 digits."""
    return intervals.filter("lower is not null and upper is not null").withColumns(
        {c: F.round(c, 4) for c in ("mean", "lower", "upper")}
    )


def write_intervals(intervals: DataFrame, path: str, split: str) -> None:
    interval_rows(intervals).write.mode("overwrite").json(f"{path}/{split}_ci")
