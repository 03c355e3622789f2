"""Seeded, engine-portable pseudo-randomness.

md5 text is the same in every SQL engine, so samples and splits can be
reproduced outside Spark.  The digest orders rows; its leading hex digits are
an even, order-preserving bucket, which lets a huge stratum be ranked by many
tasks (see operators.ranking).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def digest_bucket(digest: Column, hex_digits: int = 2) -> Column:
    return F.substring(digest, 1, hex_digits)


def digest_int(digest: Column) -> Column:
    """First 32 bits as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def digest_uniform(digest: Column) -> Column:
    """Uniform double in [0, 1)."""
    return digest_int(digest).cast("double") / F.lit(4294967296.0)
