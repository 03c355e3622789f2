"""Random forests whose trees grow in the tasks, on binned rows.

Spark's own fit passes over all rows for every few hundred nodes, and every pass leads each row through
each tree from its root.  Here the rows are binned once, one byte a feature, and sent to every group of
trees; a task grows its trees level by level and looks at the rows of open nodes only.  Bins, balanced
bootstrap, feature subsets, impurity, limits and pruning follow Spark's rules; the result is Spark's model.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import classification
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.session import ensure_checkpoint_dir

# Sizes of what a task holds.
TASK_BYTES = 150_000_000  # binned rows up to which every task holds all of them
BLOCK_VALUES = 1 << 20  # values, rows x features, that travel together
SUMMARY = 8192  # values that stand for those of a block
MAX_FEATURES = 64
STEP_ROWS = 1 << 16  # rows of one numpy step
SMALL_ROWS = 1 << 13  # rows up to which a node is split together with others
FRONTIER = 2048  # open nodes whose histograms a task holds
MAX_KINDS = 255  # pairs of label and weight
MAX_CLASSES = 100  # as Spark
EPSILON = 2.220446049250313e-16

NODES = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
    "leftChild int, rightChild int, featureIndex int, threshold double"
)


def summary(values: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weights; beyond `n` of them, the greatest of n ranges of equal weight."""
    distinct, place = np.unique(values, return_inverse=True)
    sums = np.bincount(place, weights=weights, minlength=len(distinct))
    if len(distinct) <= n:
        return distinct, sums
    ranges = ((np.cumsum(sums) - sums / 2) * (n / sums.sum())).astype(np.int64)
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    last = np.append(first[1:], len(distinct)) - 1
    return distinct[last], np.add.reduceat(sums, first)


def thresholds(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """Spark's splits of a feature: all midpoints of few values, midpoints at equal strides of weight of many."""
    values, weights = summary(values, weights, len(values))
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < max_bins:
        return middle
    counts = np.cumsum(weights)
    stride = counts[-1] / max_bins
    found, target = [], stride
    for i, (before, after) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)):
        if abs(before - target) < abs(after - target):
            found.append(i)
            target += stride
    return middle[found]


def poisson_steps() -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1): its distribution, and the value of each 16-bit number; 255 where later digits decide."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    low, high = (np.searchsorted(cdf, (np.arange(65536) + d) / 65536, side="right") for d in (0.0, 1.0 - 1e-9))
    return cdf, np.where(low == high, low, 255).astype(np.uint8)


def bootstrap(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a tree takes, and how often: Poisson(1) for each of n rows."""
    cdf, value = poisson_steps()
    rows, counts, end = np.empty(n, np.int32), np.empty(n, np.uint8), 0
    for start in range(0, n, STEP_ROWS):
        digits = rng.integers(0, 65536, min(STEP_ROWS, n - start), dtype=np.uint16)
        drawn = value[digits]
        undecided = np.flatnonzero(drawn == 255)
        drawn[undecided] = np.searchsorted(cdf, (digits[undecided] + rng.random(len(undecided))) / 65536, side="right")
        taken = np.flatnonzero(drawn)
        at, end = end, end + len(taken)
        rows[at:end], counts[at:end] = taken + start, drawn[taken]
    return rows[:end], counts[:end]


def gini(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(impurity, weight) of weights by class along the last axis."""
    total = stats.sum(axis=-1)
    share = stats / np.where(total > 0, total, 1.0)[..., None]
    return np.where(total > 0, 1.0 - np.square(share).sum(axis=-1), 0.0), total


def n_bins(n_splits: np.ndarray) -> int:
    return max(2, int(n_splits.max(initial=0)) + 1)


def code_type(n_splits: np.ndarray, n_kinds: int) -> type:
    return np.uint8 if n_bins(n_splits) * n_kinds <= 256 else np.uint16


class Tree:
    """Grows one tree.

    `codes[f]` holds bin * kinds + kind of every row, the kind being the number of its (label, weight); `classes[kind]` is
    its weight by class and `n_splits[f]` the number of thresholds of feature f.
    """

    def __init__(
        self, codes: np.ndarray, classes: np.ndarray, n_splits: np.ndarray, subset: int, min_rows: int, max_depth: int, min_gain: float = 0.0
    ):
        self.codes, self.flat, self.classes, self.n_splits = codes, codes.reshape(-1), classes, n_splits
        self.n_features, self.n_rows = codes.shape
        self.n_bins = n_bins(n_splits)
        self.subset, self.min_rows, self.max_depth, self.min_gain = subset, min_rows, max_depth, min_gain

    def grow(self, rng: np.random.Generator, draw: Callable = bootstrap) -> dict[str, np.ndarray]:
        """Nodes in the order of their making, for the rows and counts that `draw` takes."""
        large, small = [(*draw(self.n_rows, rng), 0, 0)], []
        whole = self._histograms(*large[0][:2], None, np.zeros((1, 1), np.int64))[0, 0].sum(axis=0)
        self.made, self.split, self.n_nodes, self.rng = [(whole[None, :], np.zeros(1, np.int32))], [], 1, rng
        if not self.max_depth:
            large.clear()
        while large:  # one by one
            for child in self._part(*large.pop()):
                if len(child[0]) > SMALL_ROWS:
                    large.append(child)
                else:
                    small.append((child[0].copy(), child[1].copy(), *child[2:]))
            child = None
        while small:  # many at a time
            now, small = small[:FRONTIER], small[FRONTIER:]
            rows, counts = (np.concatenate(x) for x in list(zip(*now, strict=True))[:2])
            node = np.repeat(np.arange(len(now), dtype=np.int16), [len(x[0]) for x in now])
            ids, depth = (np.array(x) for x in list(zip(*now, strict=True))[2:])
            fronts = [(rows, counts, node, ids, depth)]
            while fronts:
                fronts.extend(self._level(*fronts.pop()))
        return self._nodes()

    def _split(self, rows, counts, node, ids, depth) -> tuple[np.ndarray, ...]:
        """Decide the splits of the open nodes `ids` and make their children; `node` is the place in `ids` of each row's node.

        (places of the nodes that are split, features, last codes of the left sides, ids of the children, whether they go on)."""
        m, s, b, k = len(ids), self.subset, self.n_bins, len(self.classes)
        chosen = np.argsort(self.rng.random((m, self.n_features)), axis=1)[:, :s] if s < self.n_features else np.tile(np.arange(s), (m, 1))
        hist = self._histograms(rows, counts, node, chosen)
        left = np.cumsum(hist, axis=2)[:, :, :-1]
        whole = hist[:, 0].sum(axis=1)
        right = whole[:, None, None, :] - left
        (here, weight), (at_left, w_left), (at_right, w_right) = (gini(x @ self.classes) for x in (whole, left, right))
        weight = np.where(weight > 0, weight, 1.0)[:, None, None]
        gain = here[:, None, None] - at_left * (w_left / weight) - at_right * (w_right / weight)
        fits = (left.sum(axis=-1) >= self.min_rows) & (right.sum(axis=-1) >= self.min_rows) & (gain >= self.min_gain)
        fits &= np.arange(b - 1) < self.n_splits[chosen][:, :, None]
        gain = np.where(fits, gain, -np.inf).reshape(m, -1)
        best = gain.argmax(axis=1)
        best_gain = gain[np.arange(m), best]
        which = np.flatnonzero(best_gain > 0)
        place, at = np.divmod(best[which], b - 1)
        feature = chosen[which, place]
        children = np.stack([left[which, place, at], right[which, place, at]], axis=1).reshape(-1, k)
        below = np.repeat(depth[which] + 1, 2)
        new = self.n_nodes + np.arange(len(children))
        self.made.append((children, below))
        self.split.append((ids[which], feature, at, best_gain[which], new[::2]))
        self.n_nodes += len(children)
        impurity, _ = gini(children @ self.classes)
        goes_on = (impurity >= EPSILON) & (children.sum(axis=1) >= 2 * self.min_rows) & (below < self.max_depth)
        return which, feature, at * k + k - 1, new, goes_on

    def _part(self, rows, counts, node, depth) -> list[tuple]:
        """Split one node; its children that go on."""
        _, feature, last, new, goes_on = self._split(rows, counts, None, np.array([node]), np.array([depth]))
        if not goes_on.any():
            return []
        out = {side: (np.empty_like(rows), np.empty_like(counts)) for side in np.flatnonzero(goes_on)}
        ends = dict.fromkeys(out, 0)
        for i in range(0, len(rows), STEP_ROWS):
            r, c = rows[i : i + STEP_ROWS], counts[i : i + STEP_ROWS]
            right = self.codes[feature[0]].take(r) > last[0]
            for side, (to_rows, to_counts) in out.items():
                taken = np.flatnonzero(right if side else ~right)
                at, ends[side] = ends[side], ends[side] + len(taken)
                to_rows[at : ends[side]], to_counts[at : ends[side]] = r.take(taken), c.take(taken)
        return [(to_rows[: ends[side]], to_counts[: ends[side]], new[side], depth + 1) for side, (to_rows, to_counts) in out.items()]

    def _level(self, rows, counts, node, ids, depth) -> list[tuple]:
        """Split open nodes; the next ones."""
        which, feature, last, new, goes_on = self._split(rows, counts, node, ids, depth)
        next_ids = new[goes_on]
        if not len(next_ids):
            return []
        next_depth, m = np.repeat(depth[which] + 1, 2)[goes_on], len(ids)
        target = np.full((m, 2), -1, np.int16)  # up to 2 * FRONTIER
        target[which] = np.where(goes_on, np.cumsum(goes_on) - 1, -1).reshape(-1, 2)
        start, last_code = np.zeros(m, np.int64), np.zeros(m, self.codes.dtype)
        start[which], last_code[which] = feature * self.n_rows, last
        kept = 0
        for i in range(0, len(rows), STEP_ROWS):
            r, c, p = rows[i : i + STEP_ROWS], counts[i : i + STEP_ROWS], node[i : i + STEP_ROWS].astype(np.int64)
            goes_right = self.flat.take(r + start.take(p)) > last_code.take(p)
            to = target.take(2 * p + goes_right)
            stays = np.flatnonzero(to >= 0)
            end = kept + len(stays)
            rows[kept:end], counts[kept:end], node[kept:end] = r.take(stays), c.take(stays), to.take(stays)  # never beyond what was read
            kept = end
        rows, counts, node = rows[:kept], counts[:kept], node[:kept]
        if len(next_ids) <= FRONTIER:
            return [(rows, counts, node, next_ids, next_depth)]
        order = np.argsort(node.astype(np.uint16), kind="stable")  # a radix sort
        rows, counts, node = rows[order], counts[order], node[order]
        out = []
        for i in range(0, len(next_ids), FRONTIER // 2):
            a, z = np.searchsorted(node, [i, i + FRONTIER // 2])
            of = slice(i, i + FRONTIER // 2)
            out.append((rows[a:z], counts[a:z], node[a:z] - np.int16(i), next_ids[of], next_depth[of]))
        return out

    def _histograms(self, rows, counts, node, chosen) -> np.ndarray:
        """Counts by node, chosen feature, bin and kind; without `node` all rows are one node's."""
        (m, s), b, k = chosen.shape, self.n_bins, len(self.classes)
        size = m * b * k
        step = max(STEP_ROWS, size)
        out = np.zeros((s, size))
        start = np.ascontiguousarray(chosen.T) * self.n_rows
        for i in range(0, len(rows), step):
            r, c = rows[i : i + step].astype(np.int64), counts[i : i + step].astype(np.float64)
            if node is None:
                for j in range(s):
                    out[j] += np.bincount(self.codes[chosen[0, j]].take(r), c, size)
                continue
            p = node[i : i + step].astype(np.int64)
            cell = p * (b * k)
            for j in range(s):
                out[j] += np.bincount(self.flat.take(r + start[j].take(p)) + cell, c, size)
        return out.reshape(s, m, b, k).swapaxes(0, 1)

    def _nodes(self) -> dict[str, np.ndarray]:
        """Arrays of all nodes; leaves of one prediction below a node are merged into it, as Spark does."""
        counts, depth = (np.concatenate(x) for x in zip(*self.made, strict=True))
        n = len(counts)
        stats = counts @ self.classes
        prediction = stats.argmax(axis=1)
        feature, at, left = (np.full(n, -1, np.int64) for _ in range(3))
        gain = np.full(n, -1.0)
        if self.split:
            ids, feature_of, at_of, gain_of, first = (np.concatenate(x) for x in zip(*self.split, strict=True))
            feature[ids], at[ids], gain[ids], left[ids] = feature_of, at_of, gain_of, first
        dropped = np.zeros(n, bool)
        for level in range(depth.max(), -1, -1):
            inner = np.flatnonzero((depth == level) & (left >= 0))
            child = left[inner]
            same = (left[child] < 0) & (left[child + 1] < 0) & (prediction[child] == prediction[child + 1])
            dropped[child[same]] = dropped[child[same] + 1] = True
            feature[inner[same]] = at[inner[same]] = left[inner[same]] = -1
            gain[inner[same]] = -1.0
        kept = ~dropped
        number = np.cumsum(kept) - 1
        left = np.where(left >= 0, number[left], -1)
        impurity, _ = gini(stats)
        columns = dict(stats=stats, raw=counts.sum(axis=1), prediction=prediction, impurity=impurity, gain=gain, feature=feature, at=at, left=left)
        return {name: x[kept] for name, x in columns.items()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, weights) of about BLOCK_VALUES values each."""
    held, n = [], 0

    def joined():
        table = pa.Table.from_batches(held)
        label, weight = (table.column(c).to_numpy() for c in ("label", "weight"))
        lists = table.column("features").combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1), label, weight

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += len(batch.column("features").flatten())
        if n >= BLOCK_VALUES:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: its (label, weight) pairs (feature -1) and a summary of every feature."""
    for x, label, weight in _blocks(batches):
        pairs = np.unique(np.stack([label, weight], axis=1), axis=0)[: MAX_KINDS + 1]
        found = [(-1, pairs[:, 0], pairs[:, 1])] + [(f, *summary(x[:, f], weight, SUMMARY // x.shape[1])) for f in range(x.shape[1])]
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([f for f, _, _ in found], pa.int32()),
            "a": pa.array([a for _, a, _ in found], pa.list_(pa.float64())), "b": pa.array([b for _, _, b in found], pa.list_(pa.float64())),
        })


class RandomForestClassifier(classification.RandomForestClassifier):
    """Spark's random forest with another fit; what this one doesn't cover goes to Spark's."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        if not self._covered(dataset):
            return super()._fit(dataset)
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("features"), F.col(self.getLabelCol()).cast("double").alias("label"), weight.alias("weight")
        )
        n_rows, n_features = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
        if not 0 < n_rows * n_features <= TASK_BYTES or n_features > MAX_FEATURES:
            return super()._fit(dataset)
        found: dict[int, list] = {f: [] for f in range(-1, n_features)}
        for batch in rows.mapInArrow(_summaries, "feature int, a array<double>, b array<double>").toArrow().to_batches():
            for f, a, b in zip(*batch.columns, strict=True):
                found[f.as_py()].append((a.values.to_numpy(), b.values.to_numpy()))
        pairs = {p for a, b in found[-1] for p in zip(a.tolist(), b.tolist(), strict=True)}
        labels = {y for y, _ in pairs}
        plain = all(float(y).is_integer() and 0 <= y < MAX_CLASSES for y in labels) and all(w > 0 for _, w in pairs) and max(labels) > 0
        if not plain or len(pairs) > MAX_KINDS:
            return super()._fit(dataset)
        max_bins = min(self.getMaxBins(), n_rows)
        cuts = [thresholds(*(np.concatenate(x) for x in zip(*found[f], strict=True)), max_bins) for f in range(n_features)]
        n_classes = int(max(labels)) + 1
        width = np.dtype(code_type(np.array([len(c) for c in cuts]), len(pairs))).itemsize
        if n_rows * n_features * width > TASK_BYTES:
            return super()._fit(dataset)
        path = self._grown(rows, sorted(pairs), cuts, n_rows, n_classes)
        return RandomForestClassificationModel.load(path)

    def _covered(self, dataset: DataFrame) -> bool:
        """Parameters and columns of this fit: continuous features, bootstrap of whole size, sqrt or all of the features."""
        attributes = [dataset.schema[c].metadata.get("ml_attr", {}) for c in (self.getFeaturesCol(), self.getLabelCol())]
        return (
            self.getImpurity() == "gini" and self.getBootstrap() and self.getSubsamplingRate() == 1.0 and self.getNumTrees() > 1
            and self.getFeatureSubsetStrategy() in ("auto", "sqrt", "all") and self.getMinWeightFractionPerNode() == 0.0
            and self.getMaxBins() <= 256 and not set(attributes[0].get("attrs", {})) & {"nominal", "binary"} and not attributes[1].get("vals")
        )

    def _grown(self, rows: DataFrame, pairs: list[tuple], cuts: list[np.ndarray], n_rows: int, n_classes: int) -> str:
        """Grow all trees and write them as a stored model of Spark; its folder."""
        spark, n_features, n_trees = rows.sparkSession, len(cuts), self.getNumTrees()
        n_splits = np.array([len(c) for c in cuts])
        as_code = code_type(n_splits, len(pairs))
        kind_of = {p: i for i, p in enumerate(pairs)}
        classes = np.zeros((len(pairs), n_classes))
        for (y, w), i in kind_of.items():
            classes[i, int(y)] = w
        subset = n_features if self.getFeatureSubsetStrategy() == "all" else math.ceil(math.sqrt(n_features))
        limits = dict(subset=subset, min_rows=self.getMinInstancesPerNode(), max_depth=self.getMaxDepth(), min_gain=self.getMinInfoGain())
        seed = self.getSeed() & (2**64 - 1)
        n_groups = min(n_trees, max(2, spark.sparkContext.defaultParallelism))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for i, (x, label, weight) in enumerate(_blocks(batches)):
                distinct, place = np.unique(np.stack([label, weight], axis=1), axis=0, return_inverse=True)
                kinds = np.array([kind_of[tuple(p)] for p in distinct.tolist()])[place.reshape(-1)]
                codes = np.stack([np.searchsorted(cuts[f], x[:, f]) * len(kind_of) + kinds for f in range(n_features)])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "block": pa.array([i], pa.int32()),
                    "codes": pa.array([codes.astype(as_code).tobytes()], pa.binary()),
                })

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n, group = np.empty((n_features, n_rows), as_code), 0, None
            for batch in batches:
                for g, block in zip(batch.column("group"), batch.column("codes"), strict=True):
                    group, of = g.as_py(), np.frombuffer(block.as_buffer(), as_code).reshape(n_features, -1)
                    codes[:, n : n + of.shape[1]] = of
                    n += of.shape[1]
            if group is None:
                return
            if n != n_rows:
                raise RuntimeError(f"{n} rows came, {n_rows} were counted")
            pa.default_memory_pool().release_unused()
            tree = Tree(codes, classes, n_splits, **limits)
            for t in range(group, n_trees, n_groups):
                rng = np.random.default_rng([seed, t])
                yield _as_rows(t, tree.grow(rng), cuts)

        blocks = rows.mapInArrow(binned, "part int, block int, codes binary")
        sent = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).repartitionById(n_groups, "group")
        nodes = sent.sortWithinPartitions("part", "block").mapInArrow(grown, NODES)
        leaf = F.col("leftChild") < 0
        split = F.struct(
            "featureIndex", F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories"),
        )
        plain = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild"]
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4()}"
        nodes.select("treeID", F.struct(*plain, split.alias("split")).alias("nodeData")).write.parquet(f"{path}/data")
        self._write_metadata(spark, path, n_features, n_classes)
        return path

    def _write_metadata(self, spark, path: str, n_features: int, n_classes: int) -> None:
        tree_params = classification.DecisionTreeClassificationModel
        set_here, defaults = ({p.name: v for p, v in params.items()} for params in (self._paramMap, self._defaultParamMap))

        def described(kind: type, uid: str, leave_out: set[str], **more) -> str:
            own = ({k: v for k, v in params.items() if k not in leave_out} for params in (set_here, defaults))
            first = {"class": f"org.apache.spark.ml.classification.{kind.__name__}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
            return json.dumps(first | dict(zip(("paramMap", "defaultParamMap"), own, strict=True)) | more)

        forest_only = {"numTrees", "subsamplingRate", "featureSubsetStrategy", "bootstrap", "weightCol"}
        trees = [(t, described(tree_params, f"dtc_{uuid.uuid4().hex[:12]}", forest_only), 1.0) for t in range(self.getNumTrees())]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        sizes = dict(numFeatures=n_features, numClasses=n_classes, numTrees=self.getNumTrees())
        note = described(RandomForestClassificationModel, self.uid, set(), **sizes)
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{path}/metadata")


def _as_rows(t: int, nodes: dict[str, np.ndarray], cuts: list[np.ndarray]) -> pa.RecordBatch:
    left, n = nodes["left"], len(nodes["left"])
    cut = np.zeros(n)
    for f, c in enumerate(cuts):
        of = nodes["feature"] == f
        cut[of] = c[nodes["at"][of]]
    stats = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * nodes["stats"].shape[1], nodes["stats"].reshape(-1))
    return pa.RecordBatch.from_pydict({
        "treeID": pa.array(np.full(n, t, np.int32)), "id": pa.array(np.arange(n, dtype=np.int32)),
        "prediction": pa.array(nodes["prediction"].astype(np.float64)), "impurity": pa.array(nodes["impurity"]), "impurityStats": stats,
        "rawCount": pa.array(nodes["raw"].astype(np.int64)), "gain": pa.array(nodes["gain"]), "leftChild": pa.array(left.astype(np.int32)),
        "rightChild": pa.array(np.where(left >= 0, left + 1, -1).astype(np.int32)), "featureIndex": pa.array(nodes["feature"].astype(np.int32)),
        "threshold": pa.array(cut),
    })
