"""Ranks, running sums, top-k and quantiles that no single hot group can stall.

A window partitioned by the group alone puts a whole group in one task.  The
operators here split every group by an order-preserving bucket, run the window
inside (group, bucket) and add the totals of the earlier buckets.  Exact: the
bucket only moves work, it never changes the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.session import cut_lineage

# row_number() <= n with n up to this limit is pushed below the shuffle by Spark
GROUP_LIMIT_PUSHDOWN = 1000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; key columns come from the left.

    With no keys, `right` must be a one-row aggregate; its columns are attached
    to every row as a scalar subquery.
    """
    if not keys:
        one = right.select(F.struct(*right.columns).alias("one")).scalar()
        return left.withColumn("__one", one).select(*left.columns, "__one.*")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, Column],
    bucket_desc: bool = False,
) -> DataFrame:
    """Add `<name>` (inclusive running sum) and `<name>_total` per group.

    `bucket` columns must grow (or fall, with `bucket_desc`) with `order`.
    """
    group, bucket = list(group), list(bucket)
    # a struct key is never null itself and its null fields compare as equal, so the join
    # below keeps null groups and still reuses the partitioning of the window
    df = df.withColumn("__g", F.struct(*group) if group else F.lit(0))
    part = ["__g", *bucket]
    local_w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"__l_{n}": F.sum(c).over(local_w) for n, c in values.items()})

    totals = df.groupBy(*part).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in values.items()])
    bucket_order = [F.col(b).desc() if bucket_desc else F.col(b).asc() for b in bucket]
    before = Window.partitionBy("__g").orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__g")
    offsets = totals.select(
        *part,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values],
        *[F.sum(f"__t_{n}").over(whole).alias(f"{n}_total") for n in values],
    )
    out = local.join(offsets, part)
    out = out.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in values})
    return out.select(*[c for c in df.columns if c != "__g"], *values, *[f"{n}_total" for n in values])


def group_rank(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    bucket_desc: bool = False,
) -> DataFrame:
    """Add `<name>` = 1..n inside each group and `<name>_total` = n."""
    return running_totals(df, group, bucket, order, {name: F.lit(1).cast("bigint")}, bucket_desc)


def first_by_hash(df: DataFrame, group: Sequence[str], digest: str, tie: Sequence[str], n: int) -> DataFrame:
    """Keep the `n` rows of each group whose digest sorts first."""
    order = [F.col(digest), *[F.col(t) for t in tie]]
    if n <= GROUP_LIMIT_PUSHDOWN:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
    bucketed = df.withColumn("__b", F.substring(F.col(digest), 1, 2))
    ranked = group_rank(bucketed, group, ["__b"], order, "__n")
    return ranked.filter(F.col("__n") <= n).drop("__n", "__n_total", "__b")


def modal_value(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key, lowest value on ties.

    Rows are combined to (key, value) counts first, so a hot key ships one row
    per value and task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def range_buckets(df: DataFrame, order: Sequence[str], name: str = "__b") -> DataFrame:
    """Add a bucket that grows with `order`: the task of a range partition, kept by a checkpoint.

    Ranges follow a sample of the data, so buckets are alike in size for any spread of the values, and a
    group has at most as many buckets as there are partitions.  Rows equal in `order` share a bucket.
    """
    spread = df.repartitionByRange(*order)
    return cut_lineage(spread.withColumn(name, F.spark_partition_id()))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group from a histogram of distinct values, ranked range by range."""
    group = list(group)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    hist = range_buckets(hist, [*group, "__v"])
    cum = running_totals(hist, group, ["__b"], [F.col("__v")], {"__cum": F.col("__c")})
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__cum_total") - 1)
        below = F.col("__cum") - F.col("__c")
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (below <= pos) & (pos < F.col("__cum"))
            aggs.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{name}_{tag}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"__{name}_w"))
    picked = cum.groupBy(*group).agg(*aggs)
    return picked.select(
        *group,
        *[
            (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_w")).alias(n)
            for n in probs
        ],
    )


BROADCAST_ROWS = 100_000  # entries of a few numbers each


def attach_by_group(rows: DataFrame, table: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows to a table with one entry per group (a stratum, a model, a class).

    The table is made once; if its entries are counted and few, they go to every task and the rows
    stay where they are.  A larger table is an ordinary join, whose hot groups Spark splits.
    """
    if not group:
        return join_on(rows, table, [])
    made = cut_lineage(table)
    return join_on(rows, F.broadcast(made) if made.count() <= BROADCAST_ROWS else made, group, how)


def join_by_entity(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join item rows to a table with one row per patient, clip or stem; adaptive execution splits hot keys."""
    return rows.join(table, list(keys), how)
