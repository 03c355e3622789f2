"""Tail probabilities of test statistics as column expressions.

Spark SQL has no erfc, chi-square, studentised range or signed-rank function.  Each is written here as a
finite sum over array functions, for one row per pair or experiment.  A null statistic has a null p.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The complementary error function is a contour integral; its trapezoidal sum with step 1/2 is exact to
# exp(-(pi / STEP)^2), below the precision of a double, and its terms fall as exp(-k^2 / 4).
STEP = 0.5
ERFC_TERMS = 13
# Near zero that sum loses digits; the Maclaurin series of erf takes over.
SMALL = 0.5
ERF_TERMS = 16


def _series(x: Column) -> Column:
    """erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum of 2^k x^(2k+1) / (2k+1)!!, by Horner's rule."""
    square, total = x * x, F.lit(1.0)
    for k in range(ERF_TERMS, 0, -1):
        total = 1.0 + square * (2.0 / (2 * k + 1)) * total
    return F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-square) * x * total


def erfc(x: Column) -> Column:
    """Complementary error function to about 1e-14 relative; null for null."""

    def positive(v: Column) -> Column:
        square = v * v
        total = 1.0 / square
        for k in range(1, ERFC_TERMS + 1):
            node = (k * STEP) ** 2
            total = total + 2.0 * math.exp(-node) / (square + node)
        pole = F.when(v < math.pi / STEP, 2.0 / (1.0 - F.exp(v * (2.0 * math.pi / STEP)))).otherwise(0.0)
        return F.lit(STEP / math.pi) * v * F.exp(-square) * total + pole

    size = F.abs(x)
    tail = F.when(size < SMALL, 1.0 - _series(size)).otherwise(positive(F.greatest(size, F.lit(SMALL))))
    return F.when(x < 0, 2.0 - tail).when(x >= 0, tail)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal z."""
    return erfc(F.abs(z.cast("double")) / math.sqrt(2.0))


def chi2_p(x: Column, dof: Column) -> Column:
    """Upper tail for whole degrees of freedom: a Poisson sum, which starts from erfc if they are odd."""
    half = F.greatest(x.cast("double"), F.lit(0.0)) / 2.0
    odd = dof % 2 == 1
    first = F.when(odd, 2.0 * F.sqrt(half / math.pi) * F.exp(-half)).otherwise(F.exp(-half))
    shift = F.when(odd, 0.5).otherwise(0.0)
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def add(state: Column, k: Column) -> Column:
        # term k is half^(k - 1 + shift) * exp(-half) / gamma(k + shift)
        return F.struct((state["term"] * half / (k + shift)).alias("term"), (state["total"] + state["term"]).alias("total"))

    n_terms = F.floor(dof / 2).cast("int")
    steps = F.when(n_terms > 0, F.sequence(F.lit(1), n_terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, add, lambda s: s["total"])
    return F.when(x.isNotNull() & dof.isNotNull(), F.least(F.lit(1.0), total + F.when(odd, erfc(F.sqrt(half))).otherwise(0.0)))


# Nodes per unit and reach of the integral over the greatest of the normals; the trapezoidal rule on a
# smooth function that vanishes at both ends gains digits exponentially in the nodes.
NODES = 8
REACH = 9


def studentized_range_p(q: Column, k: Column) -> Column:
    """P(range of k standard normals > q), for infinitely many degrees of freedom."""
    q, k = q.cast("double"), k.cast("double")
    nodes = F.sequence(F.lit(-REACH * NODES), F.ceil((REACH + F.greatest(q, F.lit(0.0))) * NODES).cast("int"))

    def add(total: Column, i: Column) -> Column:
        t = i / F.lit(float(NODES))
        between = (erfc((t - q) / math.sqrt(2.0)) - erfc(t / math.sqrt(2.0))) / 2.0
        return total + F.exp(-t * t / 2.0) * F.pow(F.greatest(between, F.lit(0.0)), k - 1.0)

    # `between` is the share of normals in [t - q, t]: the greatest of the k lies at t
    inside = F.aggregate(nodes, F.lit(0.0), add) * k / (NODES * math.sqrt(2.0 * math.pi))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - inside))
    return F.when(q.isNotNull() & k.isNotNull(), F.when(q <= 0, 1.0).otherwise(p))


def signed_rank_exact(w: Column, n: Column) -> Column:
    """Two-sided exact p of the smaller signed-rank sum of n untied, non-zero differences.

    The number of subsets of the ranks 1..r with each sum up to w follows from the one for 1..r-1.
    """
    top = F.floor(w).cast("int")
    empty = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), top))

    def with_rank(ways: Column, r: Column) -> Column:
        return F.transform(ways, lambda v, s: v + F.coalesce(F.get(ways, s - r), F.lit(0.0)))

    ranks = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    ways = F.aggregate(ranks, empty, with_rank)
    low = F.aggregate(ways, F.lit(0.0), lambda a, v: a + v)
    return F.least(F.lit(1.0), 2.0 * low / F.pow(F.lit(2.0), n.cast("double")))


EXACT_UP_TO = 50


def signed_rank_pvalue(w: Column, n: Column, ties: Column, zeros: Column, exact_up_to: int = EXACT_UP_TO) -> Column:
    """Exact without ties or zeros for n <= `exact_up_to`; normal with tie correction otherwise.

    `ties` is the sum of t^3 - t over groups of equal absolute differences.
    """
    m = n.cast("double")
    variance = m * (m + 1.0) * (2.0 * m + 1.0) / 24.0 - ties / 48.0
    rough = F.when(variance <= 0, 1.0).otherwise(normal_p((w - m * (m + 1.0) / 4.0) / F.sqrt(variance)))
    exact = (ties == 0) & (zeros == 0) & (n <= exact_up_to)
    return F.when(n == 0, 1.0).when(exact, signed_rank_exact(w, n)).otherwise(rough)
