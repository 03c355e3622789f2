from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
#: nulls, empty and one-word texts, repeated rows, ties, a very long text, and a column of a clashing name
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(f"x{i % 977}y{i % 31}" for i in range(30_000))
EDGE = [
    (1, " ".join(WORDS), "en", "a", "n1"), (2, " ".join(WORDS), "en", "a", "n2"),
    (3, " ".join(WORDS[:58] + ["new", "end"]), "en", "b", None), (4, None, "de", None, "n"), (5, "", None, "b", "n"),
    (6, "one", "fr", "b", "n"), (6, "one", "fr", "b", "n"), (7, "  \t\n ", "en", None, "n"), (None, "lost words here", None, None, "n"),
    (8, LONG, "en", "c", "n"), (9, LONG + " tail", "en", "c", "n"), (10, "12 34 !!", "en", "c", "n"), (11, "été 日本 ﬁ \U0001f642 ok", "fr", "d", "n"),
]
SCHEMA = "doc_id long, text string, lang string, source string, node string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """The smallest corpus, in several partitions."""
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(5).cache()
