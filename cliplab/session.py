"""Session helpers: defaults for local runs and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cliplab")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to /tmp where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cliplab-ckpt-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably, so that lost executors do not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_rows(df: DataFrame) -> DataFrame:
    """Rows of `df` as compressed Parquet in the checkpoint folder: less to write than a checkpoint, any column names."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4()}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
