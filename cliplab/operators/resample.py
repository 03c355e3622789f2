"""Bootstrap of decisions: shared draws for many decision rules, any number of classes, any metric of the caller.

Rows that agree in label and in all decisions weigh the same in every replicate.  So rows are first combined to
such patterns, and the multinomial is drawn over patterns: once for all rules, which makes the replicates
paired.  The state of a replicate is one confusion matrix per rule.  Matrices of different tasks add up, and a
metric is an expression over the summed matrix (`Matrix`), evaluated by Spark.

The draw has two exact steps: how many rows fall in each range of patterns (ranges hold some 2,000 patterns, at
most 4,096 ranges a group), then which patterns of the range.  Replicates are drawn in slices by tasks of their own.
One seed gives one result: a generator is seeded by (seed, group, range, slice) and patterns come in the order of
a hash, whatever the partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplab.operators.metrics import ratio
from cliplab.operators.ranking import join_on

RANGE_PATTERNS = 2048
MOST_RANGES = 4096
SLICE = 500  # replicates drawn by one task
BLOCK_COUNTS = 4_000_000  # counts held at once: replicates x patterns of a block


class Matrix:
    """Counts of one confusion matrix as columns; classes are 0 .. n - 1."""

    def __init__(self, cells: Column, classes: int):
        self.cells, self.classes = cells, classes

    def at(self, label: int, pred: int) -> Column:
        return self.cells[label * self.classes + pred]

    def support(self, label: int) -> Column:
        return sum((self.at(label, p) for p in range(1, self.classes)), self.at(label, 0))

    def predicted(self, pred: int) -> Column:
        return sum((self.at(c, pred) for c in range(1, self.classes)), self.at(0, pred))

    def hits(self) -> Column:
        return sum((self.at(c, c) for c in range(1, self.classes)), self.at(0, 0))

    def total(self) -> Column:
        return sum((self.support(c) for c in range(1, self.classes)), self.support(0))

    def seen(self, c: int) -> Column:
        """The class occurs as a label or as a prediction."""
        return (self.support(c) + self.predicted(c)) > 0

    def macro(self, value: Callable[[int], Column]) -> Column:
        """Mean of a value over the classes that are seen."""
        kept = [F.when(self.seen(c), value(c)).otherwise(0.0) for c in range(self.classes)]
        count = [self.seen(c).cast("double") for c in range(self.classes)]
        return sum(kept[1:], kept[0]) / F.nullif(sum(count[1:], count[0]), F.lit(0.0))


Metric = Callable[[Matrix], Column]


def _average(of_class: Callable[[Matrix, int], Column]) -> Metric:
    """The value of class 1 for two classes, else the mean over the classes that are seen."""
    return lambda m: of_class(m, 1) if m.classes == 2 else m.macro(lambda c: of_class(m, c))


#: Decision metrics; with more than two classes they are macro averages and specificity is undefined.
METRICS: dict[str, Metric] = {
    "accuracy": lambda m: ratio(m.hits(), m.total(), None),
    "sensitivity": _average(lambda m, c: ratio(m.at(c, c), m.support(c))),
    "specificity": lambda m: ratio(m.at(0, 0), m.support(0)) if m.classes == 2 else F.lit(None).cast("double"),
    "precision": _average(lambda m, c: ratio(m.at(c, c), m.predicted(c))),
    "f1": _average(lambda m, c: ratio(2 * m.at(c, c), m.support(c) + m.predicted(c))),
}


def _rng(*parts: object) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(p).encode()) for p in parts])


def _slices(n_replicates: int) -> list[tuple[int, int]]:
    return [(a, min(SLICE, n_replicates - a)) for a in range(0, n_replicates, SLICE)]


def _range_draws(seed: int):
    """One row per (group, slice) in, one per (group, slice, range) out: rows drawn from the range, replicate by replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, start, size, ranges, counts in batch[["g", "start", "size", "ranges", "counts"]].itertuples(index=False):
                order = np.argsort(ranges)
                names, n = np.asarray(ranges)[order], np.asarray(counts, dtype=np.int64)[order]
                drawn = _rng(seed, g, "ranges", start).multinomial(int(n.sum()), n / n.sum(), size=int(size))
                rows = [(g, int(start), int(r), drawn[:, i].astype(np.int64).tobytes()) for i, r in enumerate(names)]
                yield pd.DataFrame(rows, columns=["g", "start", "range", "draws"])

    return run


def _matrices(seed: int, classes: int, n_rules: int):
    """Patterns of a range and its draws to one confusion matrix per rule and replicate."""

    def run(key: tuple, patterns: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        g, start, part = key
        left = np.frombuffer(draws["draws"].iloc[0], np.int64).copy()
        patterns = patterns.sort_values(["hash", "label"])
        n = patterns["n"].to_numpy(np.int64)
        label = patterns["label"].to_numpy(np.int64)
        preds = np.array(patterns["preds"].tolist(), dtype=np.int64).reshape(len(n), n_rules)
        cells = label[:, None] * classes + preds
        rng, weight = _rng(seed, g, part, start), int(n.sum())
        sums = np.zeros((len(left), n_rules * classes * classes))
        width = max(1, BLOCK_COUNTS // len(left))
        for a in range(0, len(n), width):
            block = n[a : a + width]
            size = int(block.sum())
            inside = left if size == weight else rng.binomial(left, size / weight)
            drawn = rng.multinomial(inside, block / size).astype(np.float64)
            left, weight = left - inside, weight - size
            ones = np.zeros((len(block), n_rules * classes * classes))
            at = cells[a : a + width] + np.arange(n_rules) * classes * classes
            np.put_along_axis(ones, at, 1.0, axis=1)
            sums += drawn @ ones
        matrix = sums.astype(np.int64).reshape(-1, classes * classes)
        replicate = np.repeat(np.arange(len(sums)) + start, n_rules)
        return pd.DataFrame({"g": g, "replicate": replicate, "rule": np.tile(np.arange(n_rules), len(sums)), "cells": list(matrix)})

    return run


def confusion_replicates(
    df: DataFrame,
    rules: Mapping[str, Column],
    groups: Sequence[str] = (),
    classes: int = 2,
    n_replicates: int = 1000,
    seed: int = 42,
    label: str = "label",
) -> DataFrame:
    """(groups, rule, replicate, cells): bootstrap confusion matrices, row by row of the label, of all rules at once.

    `rules` names decision columns with classes 0 .. classes - 1.  Rows whose label or any decision is null or another
    class take no part.  Replicates with one class of labels only are left out.
    """
    groups, names = list(groups), list(rules)
    known = lambda c: c.cast("int").between(0, classes - 1)
    g = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("all")
    rows = df.select(g.alias("g"), F.col(label).cast("int").alias("label"), F.array(*[rules[r].cast("int") for r in names]).alias("preds"))
    rows = rows.filter(known(F.col("label")) & F.forall("preds", lambda p: F.coalesce(known(p), F.lit(False))))
    patterns = rows.groupBy("g", "label", "preds").agg(F.count(F.lit(1)).alias("n")).withColumn("hash", F.xxhash64("label", "preds"))
    many = patterns.groupBy("g").agg(F.least(F.ceil(F.count(F.lit(1)) / RANGE_PATTERNS), F.lit(MOST_RANGES)).alias("many"))
    ranged = patterns.join(many, "g").withColumn("range", F.pmod("hash", "many")).drop("many")
    totals = ranged.groupBy("g", "range").agg(F.sum("n").alias("n"))
    packed = totals.groupBy("g").agg(F.collect_list(F.struct("range", "n")).alias("b"))  # at most MOST_RANGES entries
    slices = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(n).alias("size")) for a, n in _slices(n_replicates)]))
    asked = packed.select("g", slices.alias("s"), F.col("b.range").alias("ranges"), F.col("b.n").alias("counts")).select("g", "s.*", "ranges", "counts")
    draws = asked.mapInPandas(_range_draws(seed), "g string, start int, range long, draws binary")
    starts = F.explode(F.array(*[F.lit(a) for a, _ in _slices(n_replicates)]))
    key = ["g", "start", "range"]
    met = ranged.withColumn("start", starts).groupBy(*key).cogroup(draws.groupBy(*key))
    parts = met.applyInPandas(_matrices(seed, classes, len(names)), "g string, replicate int, rule int, cells array<long>")
    summed = parts.groupBy("g", "replicate", "rule").agg(F.array(*[F.sum(F.col("cells")[i]) for i in range(classes * classes)]).alias("cells"))
    matrix = Matrix(F.col("cells"), classes)
    present = [(matrix.support(c) > 0).cast("int") for c in range(classes)]
    two = summed.filter(sum(present[1:], present[0]) > 1)
    named = two.select("g", F.array(*[F.lit(r) for r in names])[F.col("rule")].alias("rule"), "replicate", "cells")
    if not groups:
        return named.select("rule", "replicate", "cells")
    return named.withColumn("k", F.from_json("g", df.select(*groups).schema)).select("k.*", "rule", "replicate", "cells")


def metric_intervals(
    replicates: DataFrame, groups: Sequence[str] = (), classes: int = 2, metrics: Mapping[str, Metric] | None = None, ci: float = 95.0
) -> DataFrame:
    """(groups, rule, metric, mean, lower, upper, n_replicates) of any metrics of a confusion matrix; undefined values are left out."""
    metrics = METRICS if metrics is None else metrics
    matrix, tail = Matrix(F.col("cells"), classes), (100.0 - ci) / 200.0
    values = F.array(*[F.struct(F.lit(name).alias("metric"), of(matrix).cast("double").alias("value")) for name, of in metrics.items()])
    long = replicates.select(*groups, "rule", F.explode(values).alias("v")).select(*groups, "rule", "v.*").filter("value IS NOT NULL")
    return long.groupBy(*groups, "rule", "metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(tail)).alias("lower"),
        F.percentile("value", F.lit(1.0 - tail)).alias("upper"), F.count(F.lit(1)).alias("n_replicates"),
    )


def decision_metrics(
    df: DataFrame, rules: Mapping[str, Column], groups: Sequence[str] = (), classes: int = 2, label: str = "label", metrics: Mapping[str, Metric] | None = None
) -> DataFrame:
    """(groups, rule, metric, point): the metrics of all rows that take part in `confusion_replicates`."""
    metrics, groups = METRICS if metrics is None else metrics, list(groups)
    known = lambda c: F.coalesce(c.cast("int").between(0, classes - 1), F.lit(False))
    kept = df.filter(known(F.col(label)))
    for column in rules.values():
        kept = kept.filter(known(column))
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), c.cast("int").alias("pred")) for r, c in rules.items()])
    long = kept.select(*groups, F.col(label).cast("int").alias("label"), F.explode(pairs).alias("p"))
    code = F.col("label") * classes + F.col("p.pred")
    cells = long.groupBy(*groups, F.col("p.rule").alias("rule")).agg(
        F.array(*[F.sum((code == i).cast("long")) for i in range(classes * classes)]).alias("cells")
    )
    values = F.array(*[F.struct(F.lit(n).alias("metric"), of(Matrix(F.col("cells"), classes)).cast("double").alias("point")) for n, of in metrics.items()])
    return cells.select(*groups, "rule", F.explode(values).alias("v")).select(*groups, "rule", "v.*").filter("point IS NOT NULL")


def decision_intervals(
    df: DataFrame,
    rules: Mapping[str, Column],
    groups: Sequence[str] = (),
    classes: int = 2,
    n_replicates: int = 1000,
    seed: int = 42,
    ci: float = 95.0,
    label: str = "label",
    metrics: Mapping[str, Metric] | None = None,
) -> DataFrame:
    """(groups, rule, metric, point, mean, lower, upper, n_replicates); bounds are null where no replicate has two classes."""
    groups = list(groups)
    drawn = metric_intervals(confusion_replicates(df, rules, groups, classes, n_replicates, seed, label), groups, classes, metrics, ci)
    points = decision_metrics(df, rules, groups, classes, label, metrics)
    both = join_on(points, drawn, [*groups, "rule", "metric"], "left")
    return both.withColumn("n_replicates", F.coalesce("n_replicates", F.lit(0).cast("long")))
