"""A corpus pipeline: documents in, encoded and mixed training documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last keep the columns of `documents`.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplab.llm import jaccard_join, language, mixing, pieces, repeated_windows

#: No SQL: the first stage is a trained network.  tests/llm compares the operators of the later stages with brute force.
ORACLE_SQL = None


#: rows that travel to and from Python together: whole texts, so fewer than Spark's 10,000
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """Bound the Arrow buffers of the session's tasks; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and unclear ones go."""
    _small_batches(spark)
    return language.in_known_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    _small_batches(spark)
    return jaccard_join.one_per_group(docs, shingle=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word windows that an earlier text or place has already."""
    _small_batches(spark)
    shorter = repeated_windows.without_repeated_words(docs, width=20)
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 3, 1, 2 by source, 150% of all words, at most twice."""
    _small_batches(spark)
    return mixing.mixed_documents(docs, weights=(3.0, 1.0, 2.0), share=1.5, limit=2.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether they decode to its text."""
    _small_batches(spark)
    coded = pieces.encode(docs, check=True)
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("language", known_languages),
    ("near_duplicates", one_of_each_group),
    ("repeated_windows", without_repeats),
    ("mix", mixed),
    ("sentencepiece", encoded),
]


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running the pipeline")
        return tempfile.mkdtemp(prefix="corpus-pipeline-", dir="/tmp")
    token = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{shared.rstrip('/')}/corpus-pipeline-{token}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
