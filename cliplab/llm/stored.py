"""Tables kept in the cluster's shared folder, and joins with sides of a checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENT_ROWS = 200_000  # of a few numbers or one short word each: some 10 MB
SENT_CHARS = 16_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; under /tmp only where a local master names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder before {name}")
        return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp") + "/table"
    token = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{shared.rstrip('/')}/{name}-{token}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_few(df: DataFrame, rows: int = SENT_ROWS, chars: Column | None = None) -> DataFrame:
    """`df` marked to be sent to every task if its counted rows, and the sum of `chars` over them, are few.

    Beyond that the join is left to Spark, which shuffles both sides.  `df` should be cheap to read twice.
    """
    weight = F.lit(0) if chars is None else F.sum(chars)
    n, size = df.agg(F.count(F.lit(1)), weight).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= SENT_CHARS else df


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
