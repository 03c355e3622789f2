"""Column functions over scored rows and feature vectors."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(label: Column, pred: Column) -> Column:
    """TP, FP, TN or FN (anything else than those first three is FN)."""
    return (
        F.when((label == 1) & (pred == 1), "TP")
        .when((label == 0) & (pred == 1), "FP")
        .when((label == 0) & (pred == 0), "TN")
        .otherwise("FN")
    )


def label_name(label: Column) -> Column:
    return F.when(label == 1, "Informative").when(label == 0, "Non-Informative")


def route(prob: Column, threshold: float | Column, epsilon: float = 0.0) -> Column:
    """uncertain (|p - 0.5| < epsilon) first, then informative / non_informative by threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(F.abs(prob - 0.5) < F.lit(float(epsilon)), "uncertain")
        .when(prob >= limit, "informative")
        .otherwise("non_informative")
    )


def format_interval(mean: Column, lower: Column, upper: Column) -> Column:
    """'mean (lower–upper)', or 'mean (CI unavailable)'."""
    text = [c.cast("string") for c in (mean, lower, upper)]
    return F.when(lower.isNull() | upper.isNull(), F.concat(text[0], F.lit(" (CI unavailable)"))).otherwise(
        F.concat(text[0], F.lit(" ("), text[1], F.lit("–"), text[2], F.lit(")"))
    )


def first_rule(values: Mapping[str, Column], rules: Sequence[tuple[str, Sequence[tuple[str, str, float]]]], default: str) -> Column:
    """Class of the first rule whose conditions (value name, comparison, bound) all hold, else `default`."""
    compare = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    result = F.lit(default)
    for name, conditions in reversed(rules):
        holds = reduce(operator.and_, [compare[sign](values[v], F.lit(float(bound))) for v, sign, bound in conditions])
        result = F.when(holds, name).otherwise(result)
    return result


def vector_moments(vector: Column) -> Column:
    """struct(mean, var, skew, kurt): population moments, excess kurtosis, zeros for an empty vector.

    One pass: power sums of the distance to the first element, then central moments.
    """
    first = F.coalesce(F.get(vector, 0).cast("double"), F.lit(0.0))
    names = ("n", "s1", "s2", "s3", "s4")

    def add(acc: Column, x: Column) -> Column:
        d = x.cast("double") - first
        return F.struct(
            (acc["n"] + 1.0).alias("n"), (acc["s1"] + d).alias("s1"), (acc["s2"] + d * d).alias("s2"),
            (acc["s3"] + d * d * d).alias("s3"), (acc["s4"] + d * d * d * d).alias("s4"),
        )

    sums = F.aggregate(vector, F.struct(*[F.lit(0.0).alias(n) for n in names]), add)

    def finish(s: Column) -> Column:
        n = F.nullif(s["n"], F.lit(0.0))
        m, r2, r3, r4 = (s[c] / n for c in names[1:])
        var = r2 - m * m
        third = r3 - 3 * m * r2 + 2 * m * m * m
        fourth = r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m
        spread = F.nullif(var, F.lit(0.0))
        return F.struct(
            F.coalesce(m + first, F.lit(0.0)).alias("mean"),
            F.coalesce(var, F.lit(0.0)).alias("var"),
            F.when(s["n"] == 0, 0.0).otherwise(third / F.pow(spread, F.lit(1.5))).alias("skew"),
            F.when(s["n"] == 0, 0.0).otherwise(fourth / (spread * spread) - 3.0).alias("kurt"),
        )

    # a one-element array binds the sums, so they are computed once
    return F.get(F.transform(F.array(sums), finish), 0)


def weighted_score(values: Mapping[str, Column], weights: Mapping[str, float], full_at: Mapping[str, float] | None = None) -> Column:
    """Weighted sum clamped to [0, 1]; a value named in `full_at` counts in full from that size on."""
    full_at = full_at or {}
    shares = {n: F.least(c / F.lit(full_at[n]), F.lit(1.0)) if n in full_at else c for n, c in values.items()}
    total = reduce(operator.add, [F.lit(float(weights[n])) * share for n, share in shares.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
