"""Reading the tables the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplab.schema import MANIFEST, PREDICTIONS

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = MANIFEST) -> DataFrame:
    """Manifest with a fixed schema; nothing is inferred, unread columns are pruned."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Recursive listing (path, relative_path, folder, filename, stem, size_kb, mtime).

    File contents are never read: the content column is pruned.
    """
    choices = ",".join("".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in e) for e in extensions)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{{{choices}}}")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    clean = root.rstrip("/")
    local = F.regexp_replace("path", "^file:/*", "/")
    relative = F.regexp_replace(local, f"^.*?{_escape(clean)}/", "")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        relative.alias("relative_path"),
        F.regexp_replace(relative, r"/?[^/]*$", "").alias("folder"),
        name.alias("filename"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.round(F.col("length") / 1024, 1).alias("size_kb"),
        F.col("modificationTime").alias("mtime"),
    ).filter(~F.col("filename").startswith("."))


def _escape(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|" else ch for ch in text)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Repartition by key only if the input has fewer splits than the session has cores.

    Files of one row group are read by one task; everything after it would stay
    there.  Inputs with enough splits are left alone, so large tables pay no
    extra shuffle.  With `rows`, tables of more than that many rows a core go to
    as many tasks as get about `rows` rows each, so that a task doesn't grow with
    the table; a join on the keys then uses this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = -(-df.count() // rows) if rows else 0
    return df.repartition(max(cores, tasks), *keys) if tasks > cores or df.rdd.getNumPartitions() < cores else df


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Fact table partitioned by model and fold; filters on those prune whole folders."""
    return spark.read.schema(PREDICTIONS).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Partition by model and fold; every task writes its own rows, so none are shuffled (one file a task, model and fold)."""
    df.write.mode("overwrite").partitionBy("model", "fold").parquet(path)


def read_annotations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Annotation windows; a column named 'Size:' becomes size."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return raw.withColumnsRenamed({"Size:": "size"})
