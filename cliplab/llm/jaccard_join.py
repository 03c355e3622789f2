"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links form.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold.
PartEnum: sets fall into size bands; in a band the threshold bounds the Hamming distance k of two
sets.  The shingle domain is split into n1 parts of n2 sub-parts each.  With
n1 = floor(k / (k2 + 1)) + 1 + spare, at least 1 + spare parts hold at most k2 differences, and leaving
out the k2 sub-parts where they lie makes both projections equal.  So each (part, n2 - k2 of its
sub-parts) gives one signature, and linking sets share 1 + spare of them.

How the work is dealt out:

* Equal sets are one node.  A batch of texts sends a signature once, whatever number of its texts
  carry it; the others are tied to the first by a private signature.  So no signature group is
  larger than the number of batches, and a hot group costs one row per batch.
* Signatures travel packed by bucket and node (5 and 6 bytes).  Cut short, they can only add
  candidates: every link is verified on whole sets.
* Nodes that share signatures, directly or through others, form a cluster; all links lie inside
  clusters.  Texts of clusters, one per node, meet in blocks of bounded size.
* A cluster of several blocks, mostly texts held together by passages that many share, is parted first:
  a set that links shares `percent` of its shingles with one other, so sets that share fewer with all
  others together have no link, and of the rest two linked ones have one of their rarest shingles in
  common (prefix filter).  Parts that are still too large go on in two rounds: the best-linked nodes against
  every block, then, in bounded chunks, every node that is still outside the part's largest group
  against every block.  All links are found up to connectivity; pairs already connected need no comparison.

Rows are told apart by id and text, so null and repeated ids do no harm.

Null and word-less texts have no shingles and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplab.llm.graph import components
from cliplab.llm.stored import private, quoted, sent_if_few, stored
from cliplab.llm.words import mix, signed, word_chunks
from cliplab.session import cut_lineage

LAST_ID = 2**63 - 1  # a null doc_id counts as the largest
NODE_BITS = 48
SIGNATURE_BITS = 40
BUCKET_ROWS = 1 << 19
BLOCK_NODES = 12288
BLOCK_SHINGLES = 1_000_000
HELD = 1 << 19  # values that a task sorts and packs at once
HUBS = 8
PACKED_COLUMNS = ["bucket", "nodes", "counts", "signatures"]
PACKED = "bucket long, nodes binary, counts binary, signatures binary"
WEAK = 0  # shingles of a projection that tell nothing
BROADCAST_ROWS = 250_000  # of a few whole numbers each: some 10 MB


class Bands:
    """Size bands and the PartEnum parameters of each, for a threshold in per cent."""

    def __init__(self, percent: int):
        self.percent = percent
        ratio = max(1.4, (100 / percent) ** 1.2)
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * ratio))))
        self.lows = np.array(lows, dtype=np.int64)

    def of(self, n: int) -> list[int]:
        """The band of a set of n shingles, and the next one if a partner may lie there."""
        i = int(np.searchsorted(self.lows, n, side="right")) - 1
        return [i, i + 1] if 100 * n >= self.percent * self.lows[i + 1] else [i]

    def parts(self, band: int) -> tuple[int, int, int, int]:
        """(n1, k2, n2, spare) of a band; n1 = 0 if only equal sets can reach the threshold.

        Sets of few shingles take few parts and leave out more of many sub-parts, so that their
        projections hold enough shingles to tell sets apart; large sets take many parts.
        """
        largest = int(self.lows[band + 1]) - 1
        k = 2 * largest * (100 - self.percent) // (100 + self.percent)
        if k < 1:
            return 0, 0, 0, 0
        if k <= 4:
            return 1, k, k + 3, 0
        if k <= 16:
            return k // 3 + 3, 2, 5, 2
        least = k // 2 + 1
        spare = 3 + least // (12 if self.percent >= 85 else 4)
        return least + spare, 1, 3, spare


def set_signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of one set of distinct shingle hashes."""
    out = []
    for band in bands.of(len(shingles)):
        n1, k2, n2, spare = bands.parts(band)
        if not n1:
            continue
        part = ((shingles >> np.uint64(32)) % np.uint64(n1)).astype(np.int64)
        cell = part * n2 + ((shingles & np.uint64(0xFFFFFFFF)) % np.uint64(n2)).astype(np.int64)
        spread = mix(shingles)
        low = np.bincount(cell, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), n1 * n2).astype(np.uint64)
        high = np.bincount(cell, (spread >> np.uint64(32)).astype(np.float64), n1 * n2).astype(np.uint64)
        sums = (low + (high << np.uint64(32))).reshape(n1, n2)
        filled = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        left_out = np.array(list(combinations(range(n2), k2)))
        rest = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums[:, left_out].sum(axis=2, dtype=np.uint64)
        weak = filled.sum(axis=1, keepdims=True) - filled[:, left_out].sum(axis=2) <= WEAK
        tag = np.arange(rest.size, dtype=np.uint64).reshape(rest.shape) + np.uint64(band << 40)
        values = mix(rest ^ mix(tag))
        out.append(values[~weak])
        # linking sets share projections of 1 + spare parts: with weak ones in fewer parts, another is
        # shared too; else they may share just 1 + spare weak ones
        if weak.any(axis=1).sum() > spare:
            out.append(_shared_weak(np.sort(values[weak]), 1 + spare))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shared_weak(items: np.ndarray, least: int) -> np.ndarray:
    """Signatures of which two lists of weak projections share one if they share `least` items.

    A projection without shingles, or with few, says next to nothing about a set.  In one fixed order
    of items, lists that share `least` of them share m of those in front, n - least + m each: each
    choice of m is one signature.
    """
    m = min(least, 4)
    front = items[: len(items) - least + m]
    return np.array([mix(np.sum(front[list(c)], keepdims=True, dtype=np.uint64))[0] for c in combinations(range(len(front)), m)], dtype=np.uint64)


def set_node(shingles: np.ndarray) -> int:
    total = int(np.sum(mix(shingles ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64))
    return int(mix(np.array([(total + len(shingles)) % 2**64], dtype=np.uint64))[0])


def text_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a batch."""
    for i, j, words in word_chunks(column, fold_case=True):
        values, at = words.shingles(n)
        for d in range(j - i):
            yield np.unique(values[at[d] : at[d + 1]])


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for s in text_sets(batch.column(1), n):
                sizes.append(len(s))
                nodes.append(set_node(s) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(signed(np.array(nodes, dtype=np.uint64))), pa.array(sizes, pa.int64())],
                ["doc_id", "text_hash", "node", "n_shingles"],
            )

    return run


def _short_bytes(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _whole_numbers(data: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(data) // size, 8), dtype=np.uint8)
    wide[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(-1, size)
    return wide.reshape(-1).view("<u8")


def _stars(signatures: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, least node), and the distinct (least node, other node) of shared signatures."""
    order = np.lexsort((nodes, signatures))
    signatures, nodes = signatures[order], nodes[order]
    head = np.ones(len(signatures), dtype=bool)
    head[1:] = signatures[1:] != signatures[:-1]
    centre = nodes[head][np.cumsum(head) - 1] if len(nodes) else nodes
    tied = centre != nodes
    a, b = centre[tied], nodes[tied]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.ones(len(a), dtype=bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return signatures[head], nodes[head], a[once], b[once]


def _packed_signatures(n: int, percent: int, buckets: int):
    def pack(found: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        sizes = [len(f) for f in found]
        short = np.array(owners, dtype=np.uint64) & np.uint64((1 << NODE_BITS) - 1)
        sig, node, a, b = _stars(np.concatenate(found), np.repeat(short, sizes))
        private_tie = mix(a ^ mix(b))
        return _packed(np.concatenate([sig, private_tie, private_tie]), np.concatenate([node, a, b]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            seen: set[int] = set()
            found, owners, held = [], [], 0
            for s in text_sets(batch.column(0), n):
                node = set_node(s) if len(s) else 0
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                found.append(set_signatures(s, bands))
                owners.append(node)
                held += len(found[-1])
                if held >= HELD:
                    yield pack(found, owners)
                    found, owners, held = [], [], 0
            if found:
                yield pack(found, owners)

    return run


def _packed(values: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: its nodes, how many values each has there, and the values cut short."""
    bucket = ((values >> np.uint64(SIGNATURE_BITS)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((nodes, bucket))
    rows: list[tuple[int, bytes, bytes, bytes]] = []
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for own in np.split(order, edges[1:]) if len(order) else ():
        named, counts = np.unique(nodes[own], return_counts=True)
        packed = _short_bytes(named, NODE_BITS // 8), counts.astype("<u4").tobytes(), _short_bytes(values[own], SIGNATURE_BITS // 8)
        rows.append((int(bucket[own[0]]), *packed))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], PACKED_COLUMNS)


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, nodes) of a bucket."""
    nodes = _whole_numbers(b"".join(group["nodes"]), NODE_BITS // 8)
    nodes = np.repeat(nodes, np.frombuffer(b"".join(group["counts"]), "<u4"))
    return _whole_numbers(b"".join(group["signatures"]), SIGNATURE_BITS // 8), nodes


def _bucket_edges(group: pd.DataFrame) -> pd.DataFrame:
    _, _, a, b = _stars(*_unpacked(group))
    return pd.DataFrame({"a": signed(a), "b": signed(b)})


def _packed_shingles(n: int, buckets: int):
    """Whole sets of texts (one per node) by bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column("node").to_numpy().astype(np.int64).view(np.uint64) & np.uint64((1 << NODE_BITS) - 1)
            first, sets, held = 0, [], 0
            for s in text_sets(batch.column("text"), n):
                sets.append(s)
                held += len(s)
                if held >= HELD or first + len(sets) == len(short):
                    owners = np.repeat(short[first : first + len(sets)], [len(x) for x in sets])
                    yield _packed(mix(np.concatenate(sets)), owners, buckets)
                    first, sets, held = first + len(sets), [], 0

    return run


def _shared_shingles(cells: int):
    """Of a bucket's shingles those that several nodes have, packed by cell of nodes, and how many have them (a power of two)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values, nodes = _unpacked(group)
        _, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(counts[codes] > 1)
        kept = kept[np.lexsort((nodes[kept], nodes[kept] % cells))]
        found, starts = np.unique(nodes[kept] % cells, return_index=True)
        power = np.ceil(np.log2(counts[codes[kept]])).astype(np.uint8)
        rows = []
        for cell, own, times in zip(found, np.split(kept, starts[1:]), np.split(power, starts[1:])):
            named, held = np.unique(nodes[own], return_counts=True)
            packed = _short_bytes(named, NODE_BITS // 8), held.astype("<u4").tobytes(), _short_bytes(values[own], SIGNATURE_BITS // 8)
            rows.append((int(cell), int(group["bucket"].iloc[0]), *packed, times.tobytes()))
        return pd.DataFrame(rows, columns=["cell", *PACKED_COLUMNS, "powers"])

    return run


def _rarest(percent: int):
    """The rarest of the shared shingles of a cell's nodes: as many as a linked set must have one of."""

    def run(group: pd.DataFrame, sized: pd.DataFrame) -> pd.DataFrame:
        value, owner = _unpacked(group)
        value, owner = value.astype(np.int64), owner.astype(np.int64)
        rarity = np.frombuffer(b"".join(group["powers"]), np.uint8)
        bucket = np.repeat(group["bucket"].to_numpy(np.int64), group["powers"].str.len().to_numpy(np.int64))
        sized = sized.sort_values("short")
        n = sized["n_shingles"].to_numpy(np.int64)[np.searchsorted(sized["short"].to_numpy(np.int64), owner)]
        order = np.lexsort((value, bucket, rarity, owner))
        _, start, found = np.unique(owner[order], return_index=True, return_counts=True)
        within = np.arange(len(order)) - np.repeat(start, found)
        least = -(-percent * n[order] // 100)  # shingles that a linked set has in common with this one
        # shingles that no other set has come before all of these
        front = order[within <= np.repeat(found, found) - least]
        return pd.DataFrame({"bucket": bucket[front], "value": value[front], "short": owner[front]})

    return run


def _parted(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, part) of the nodes that may link, from (node, n_shingles, text); links don't leave a part.

    Shared shingles go from their buckets to cells of nodes in one row for each pair of these; the size of a
    node comes to its cell once.
    """
    volume = texts.agg(F.sum("n_shingles")).first()[0]
    buckets = cells = 1 + volume // BUCKET_ROWS
    short = F.col("node").bitwiseAND(F.lit((1 << NODE_BITS) - 1))
    packed = texts.select("node", "text").mapInArrow(_packed_shingles(n, buckets), PACKED)
    shared = packed.groupBy("bucket").applyInPandas(_shared_shingles(cells), f"cell long, {PACKED}, powers binary")
    sized = texts.groupBy(short.alias("short")).agg(F.min("n_shingles").alias("n_shingles"))
    sized = sized.withColumn("cell", F.col("short") % F.lit(cells))
    met = shared.groupBy("cell").cogroup(sized.groupBy("cell"))
    front = cut_lineage(met.applyInPandas(_rarest(percent), "bucket long, value long, short long"))
    first = front.groupBy("bucket", "value").agg(F.min("short").alias("a"))
    edges = front.join(first, ["bucket", "value"]).filter("a <> short").select("a", F.col("short").alias("b"))
    parts = components(edges)
    return texts.select("node").join(parts.select(F.col("node").alias("short"), F.col("component").alias("part")), short == F.col("short")).drop("short")


class _Links:
    """Links of one block of sets, found by comparing one set with all others at a time."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        values, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flag = np.zeros(len(values), dtype=np.int64)
        self.percent = percent
        shared = np.bincount(self.codes)
        #: how much of a set others hold, on average: the order in which sets are tried
        self.centrality = np.add.reduceat(shared[self.codes], self.at[:-1]) / self.sizes

    def of(self, x: int) -> np.ndarray:
        own = self.codes[self.at[x] : self.at[x + 1]]
        self.flag[own] = 1
        both = np.add.reduceat(self.flag[self.codes], self.at[:-1])
        self.flag[own] = 0
        union = self.sizes + self.sizes[x] - both
        hits = np.flatnonzero(100 * both >= self.percent * union)
        return hits[hits != x]


def _by_rare_shingles(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Parts of a block, as ascending positions, that links cannot leave.

    A set of n shingles shares at least percent * n / 100 of them with any partner, so two linked sets
    have one in common among their n - that + 1 rarest.  A passage that many texts share is not rare.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((codes, np.bincount(codes)[codes], owner))
    within = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    front = order[within < np.repeat(sizes + (-percent * sizes) // 100 + 1, sizes)]
    _, _, a, b = _stars(codes[front].astype(np.uint64), owner[front].astype(np.uint64))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(y)] = find(x)
    label = np.array([find(x) for x in range(len(sets))])
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    return [p for p in parts if len(p) > 1]


def _joined(links: _Links, visitors: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of every set, and the number of links of those that were compared.

    With visitors, which come last, only these are compared; the others have met already.  Else sets of
    the group that leads for the moment wait: at the end those of one fixed group need no comparison, as
    all its pairs are connected and every set outside of it is compared with all others.
    """
    own, degree = np.arange(len(links.sizes)), np.zeros(len(links.sizes), dtype=np.int64)

    def compare(x: int) -> None:
        hits = links.of(x)
        degree[x] = len(hits)
        if len(hits):
            own[np.isin(own, own[np.append(hits, x)])] = own[x]

    if visitors:
        for x in range(len(own) - visitors, len(own)):
            compare(x)
        return own, degree
    waiting = []
    for x in np.argsort(-links.centrality, kind="stable"):
        count = np.bincount(own, minlength=len(own))
        if own[x] == count.argmax() and count.max() > 1:
            waiting.append(x)
        else:
            compare(x)
    main = np.flatnonzero(own == np.bincount(own).argmax())[0]
    for x in waiting:
        if own[x] != own[main]:
            compare(x)
    return own, degree


def _verify(n: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["guest", "node"])
        sets, nodes, guests = [], [], 0
        seen = set()
        column = pa.array(group["text"], pa.large_string())
        for s, node, guest in zip(text_sets(column, n), group["node"], group["guest"], strict=True):
            # another text under a repeated doc_id is not this node's; a guest may also be a member
            if (node, guest) in seen or not len(s) or set_node(s) != node % (1 << 64):
                continue
            seen.add((node, guest))
            sets.append(s)
            nodes.append(node)
            guests += guest
        label, degree = np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64)
        for part in _by_rare_shingles(sets, percent):
            visitors = int((part >= len(sets) - guests).sum())  # guests come last
            if guests and not visitors:
                continue  # members have met among themselves already
            own, degree[part] = _joined(_Links([sets[i] for i in part], percent), visitors)
            label[part] = part[own]
        least: dict[int, int] = {}
        for node, own in zip(nodes, label, strict=True):
            least[own] = min(node, least.get(own, node))
        rows = [(node, least[own], n) for node, own, n in zip(nodes, label, degree, strict=True) if least[own] != node or n]
        return pd.DataFrame(rows, columns=["node", "component", "degree"]).astype("int64")

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Add `blocks`, the number of blocks of a node's cluster, and the node's own `block`."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("v"))
    need = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("v") / BLOCK_SHINGLES))
    sized = members.join(sizes.select("cluster", need.cast("long").alias("blocks")), "cluster")
    return sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _meet(rows: DataFrame, keys: list[str], n: int, percent: int) -> DataFrame:
    return rows.select(*keys, "node", "text", "guest").groupBy(*keys).applyInPandas(
        _verify(n, percent), "node long, component long, degree long"
    )


def _guests(chosen: DataFrame) -> DataFrame:
    """Copies of chosen nodes for every block of their cluster."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return chosen.withColumns({"block": every, "guest": F.lit(1)})


def _across_blocks(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) for the clusters that are too large for one block."""
    links = cut_lineage(_meet(texts.withColumn("guest", F.lit(0)), ["cluster", "block"], n, percent))
    keys = ["cluster", "block", "chunk"]
    place = texts.select("node", "cluster", "blocks", "n_shingles")
    degrees = links.groupBy("node").agg(F.max("degree").alias("degree"))
    turn = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), F.desc("node")))
    hubs = place.join(degrees, "node").withColumn("turn", turn).filter(F.col("turn") <= HUBS).select("node")
    members = texts.withColumns({"guest": F.lit(0), "chunk": F.lit(0).cast("long")})
    first = members.unionByName(_guests(texts.join(hubs, "node")).withColumn("chunk", F.lit(0).cast("long")))
    links = cut_lineage(links.unionByName(_meet(first, keys, n, percent)))

    groups = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))
    labelled = place.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = labelled.groupBy("cluster", "component").count()
    largest = counts.groupBy("cluster").agg(F.max(F.struct("count", "component")).getField("component").alias("main"))
    outside = labelled.join(largest, "cluster").filter("component <> main")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    number = outside.groupBy("cluster").agg(need.cast("long").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks"))
    guests = _guests(texts.join(outside.select("node"), "node").join(number, "cluster").withColumn("chunk", chunk))
    again = texts.join(number, "cluster").withColumns(
        {"chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)), "guest": F.lit(0)}
    )
    links = links.unionByName(_meet(again.unionByName(guests), keys, n, percent))
    return components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))


def _labelled(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of `docs`: doc_id, doc_key, text_hash, n_shingles, node, component (null without shingles)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    digests = cut_lineage(
        rows.mapInArrow(_digests(shingle), "doc_id long, text_hash long, node long, n_shingles long").withColumn(
            "doc_key", F.coalesce("doc_id", F.lit(LAST_ID))
        )
    )
    volume = digests.agg(F.sum("n_shingles")).first()[0] or 0
    per_shingle = 0.3 if percent >= 85 else 1.0  # signatures per shingle, to size the buckets
    buckets = max(1, int(volume * per_shingle) // BUCKET_ROWS)
    packed = rows.select("text").mapInArrow(_packed_signatures(shingle, percent, buckets), PACKED)
    clusters = components(packed.groupBy("bucket").applyInPandas(_bucket_edges, "a long, b long"))

    # each node is spoken for by one row: that of its least id and, under a repeated id, its least text hash
    nodes = digests.filter("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct("doc_key", "text_hash")).alias("row"), F.min("n_shingles").alias("n_shingles")
    ).select("node", "n_shingles", "row.*")
    short = F.col("node").bitwiseAND(F.lit((1 << NODE_BITS) - 1))
    named = clusters.select(F.col("node").alias("short"), F.col("component").alias("cluster"))
    placed = nodes.join(named, short == F.col("short"))
    members = cut_lineage(_blocks(placed.select("doc_key", "text_hash", "node", "n_shingles", "cluster")))
    keyed = rows.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_key"), "text_hash", "text")
    met = keyed.join(sent_if_few(members, BROADCAST_ROWS), ["doc_key", "text_hash"])
    texts = stored(met.drop("doc_key", "text_hash"), "near-texts")
    if texts.count() > members.count():  # rows that repeat id and text are one
        texts = stored(texts.dropDuplicates(["node"]), "near-texts")

    together, large = texts.filter("blocks = 1"), texts.filter("blocks > 1")
    groups = _meet(together.withColumn("guest", F.lit(0)), ["cluster", "block"], shingle, percent).select("node", "component")
    if not large.isEmpty():
        parts = _parted(large, shingle, percent).withColumnRenamed("part", "cluster")
        smaller = cut_lineage(_blocks(large.select("node", "n_shingles").join(parts, "node")))
        again = stored(large.select("node", "text").join(smaller, "node"), "near-parts")
        groups = groups.unionByName(
            _meet(again.filter("blocks = 1").withColumn("guest", F.lit(0)), ["cluster", "block"], shingle, percent).select("node", "component")
        )
        larger = again.filter("blocks > 1")
        if not larger.isEmpty():
            groups = groups.unionByName(_across_blocks(larger, shingle, percent))
    labelled = digests.join(groups, "node", "left")
    return labelled.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))


def jaccard_groups(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Words are cut at ASCII white space, A-Z lower-cased; a text of fewer words than `shingle` has
    its whole sequence as its only shingle.  Texts link when
    100 * |intersection| >= percent * |union|; component_id is the least doc_id reachable by links.
    Null or empty texts: n_shingles 0, component_id their own doc_id.  A null doc_id counts as the
    largest id in a group, and is reported as null where it is alone.  Rows that repeat a doc_id are
    judged by their own text.  Other columns of `docs` are not looked at.  `percent` from 60 to 99.
    """
    labelled = cut_lineage(_labelled(docs, shingle, percent, id_col, text_col))
    least = labelled.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = labelled.join(least, "component", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def one_per_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` that stay when every group of near-duplicates keeps its least row.

    Columns are those of `docs`, whatever their names.  Rows are compared by doc_id (null last), then by a hash of
    the text.  Rows that repeat a doc_id with unlike texts are judged each; of rows equal in doc_id and text one
    stays, whichever Spark meets first.  Rows without words all stay.
    """
    key, text_hash = private(docs, "doc_key", "text_hash")
    judged = cut_lineage(_labelled(docs, shingle, percent, "doc_id", "text"))
    row = F.struct("doc_key", "text_hash")
    first = judged.filter("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("first"))
    other = judged.join(first, "component").filter(row != F.col("first")).select(F.col("doc_key").alias(key), F.col("text_hash").alias(text_hash)).distinct()
    keyed = docs.withColumns({key: F.coalesce("doc_id", F.lit(LAST_ID)), text_hash: F.xxhash64("text")})
    stay = keyed.join(sent_if_few(cut_lineage(other), BROADCAST_ROWS), [key, text_hash], "left_anti")
    repeated = judged.filter("component IS NOT NULL").groupBy("doc_key", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = cut_lineage(repeated.select(F.col("doc_key").alias(key), F.col("text_hash").alias(text_hash)))
    if not again.isEmpty():
        twice = stay.join(sent_if_few(again, BROADCAST_ROWS), [key, text_hash], "left_semi").dropDuplicates([key, text_hash])
        stay = stay.join(sent_if_few(again, BROADCAST_ROWS), [key, text_hash], "left_anti").unionByName(twice)
    return stay.select(*[F.col(quoted(c)) for c in docs.columns])
