"""Feature tables that are reused only for the manifest and settings they were built from."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_fingerprint(manifest: DataFrame, columns: Sequence[str] = ("split", "relative_path", "label")) -> DataFrame:
    """One row (n_rows, hash_sum, hash_xor): equal for equal row sets in any order."""
    h = F.xxhash64(*columns)
    return manifest.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.pmod(h, F.lit(1 << 31))).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def _settings(manifest: DataFrame, groups: Sequence[str] | None, extra: bool) -> dict:
    row = manifest_fingerprint(manifest).first()
    return {"fingerprint": list(row), "groups": list(groups) if groups else None, "extra": bool(extra)}


def cached_features(
    manifest: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], groups: Sequence[str] | None = None,
    extra: bool = False, recompute: bool = False,
) -> DataFrame:
    """Stored features if manifest and settings are unchanged, else build and store them."""
    spark: SparkSession = manifest.sparkSession
    wanted = _settings(manifest, groups, extra)
    if not recompute:
        try:
            stored = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        except AnalysisException:
            stored = None
        if stored == wanted:
            return spark.read.parquet(f"{path}/features")
    build(manifest).write.mode("overwrite").parquet(f"{path}/features")
    note = spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1)
    note.write.mode("overwrite").text(f"{path}/settings")
    return spark.read.parquet(f"{path}/features")
