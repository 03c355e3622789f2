"""Table schemas and column checks that fail before any job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("image_path", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("segment_id", T.StringType()),
        T.StructField("segment_number", T.IntegerType()),
        T.StructField("frame_number", T.IntegerType()),
        T.StructField("clip_key", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("ulcer_size", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

INFORMATIVE_MANIFEST = T.StructType(
    [
        T.StructField("image_path", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("unique_sample_id", T.StringType()),
        T.StructField("frame_number", T.IntegerType()),
        T.StructField("cause", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

HELDOUT_MANIFEST = T.StructType(
    [
        T.StructField("relative_path", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("clip_key", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("frame_id", T.StringType()),
        T.StructField("clip_key", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("prob", T.DoubleType()),
    ]
)

# Split names in reporting order, size codes and their labels.
SPLITS = ("train", "val", "test")
SIZE_CODES = {"<5mm": 1, "5-20mm": 2, ">20mm": 3}
SIZE_DISPLAY = ("<5mm", "5-20mm", ">20mm", "unknown")


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what}: missing required column(s) {missing}")
    return df


def with_string_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Group keys compare as text, whatever type they were stored in."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
