"""Trie of conversation prefixes, measured by the Euler-tour technique.

A node is a distinct sequence of first turns.  Every node has two arcs, enter and exit; the tour is a
linked list of arcs: enter leads to the first child's enter (without children: to the own exit), exit to the
next sibling's enter (the last one's: to the parent's exit).  Once the arcs are ranked, all that is below a
node lies between its two arcs, so sums over subtrees are differences of prefix sums, however deep
or wide the tree is.

List ranking contracts: arcs are dealt to tasks, and what follows each other inside a task becomes one
segment.  The first deal goes by the least member, so arcs of one conversation and its like meet; later deals send a
segment to the home of its successor where a coin of both says so, which joins at least a quarter of
them on average.  When one task holds all that is left, ranks are handed back deal by deal.

Order inside a group is never made in a task of its own: rows are sorted by range, and what a task must know of
the tasks before it (one row per task) goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.llm.stored import sent_if_few
from cliplab.llm.words import mix, signed
from cliplab.session import cut_lineage

ARCS_PER_TASK = 1 << 17
SUM_BITS = 16
ENDS_PER_PIECE = 4096
HEAD_TURNS = 5  # turns that a conversation can take over from another


# ------------------------------------------------------------------ order by range


def placed(df: DataFrame, *order: str | Column, tasks: int | None = None) -> DataFrame:
    """`df` sorted by range, with `task` and `at`, the row's place inside its task.  Kept by a checkpoint."""
    spread = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    row = F.monotonically_increasing_id()
    ordered = spread.sortWithinPartitions(*order)
    return cut_lineage(ordered.withColumns({"task": F.shiftright(row, 33).cast("int"), "at": row.bitwiseAND(F.lit((1 << 33) - 1))}))


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """Add 0, 1, 2, ... along `order`, whose last part should tell equal rows apart."""
    rows = placed(df, *order)
    counts = sorted(rows.groupBy("task").count().collect())
    before = dict(zip([t for t, _ in counts], np.cumsum([0] + [n for _, n in counts]).tolist()))
    offsets = df.sparkSession.createDataFrame(list(before.items()), "task int, before long")
    return rows.join(F.broadcast(offsets), "task").withColumn(name, F.col("at") + F.col("before")).drop("task", "at", "before")


# ------------------------------------------------------------------ conversations


def _turn_digests(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, i, a, b, size): turns numbered inside their conversation, with 128 bits of role and text."""
    named = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    bits = [F.xxhash64(F.lit(seed), "role", F.char_length("role"), "text").alias(n) for seed, n in ((1, "a"), (2, "b"))]
    narrow = ordered.select("conv_id", *bits, F.char_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("along"))
    kept = cut_lineage(narrow)
    first = kept.groupBy("conv_id", F.shiftright("along", 33).alias("task")).agg(F.min("along").alias("first"), F.count(F.lit(1)).alias("n"))
    # a conversation lies in one task or in some that follow each other: few rows for each
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("conv_id", "task", "first", "before")
    joined = kept.withColumn("task", F.shiftright("along", 33)).join(starts, ["conv_id", "task"])
    return joined.select("conv_id", (F.col("along") - F.col("first") + F.col("before")).alias("i"), "a", "b", "size")


def rebuilt_turns(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations after some took over the first turns of another.

    Returns (conv_id, i, a, b, size, last) per turn and (conv_id, turns) per conversation: conversation c begins
    with the first h turns of c - c % 100, h = crc32(c) % 6, and goes on with its own after its first h.
    """
    own = digests.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head = digests.filter(F.col("i") < HEAD_TURNS).filter(F.col("conv_id") % 100 == 0).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("i", "a", "b", "size"))).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    plan = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100}).join(head, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<i:long,a:long,b:long,size:long>>")), F.lit(1), F.col("h"))
    plan = plan.withColumn("taken", taken).withColumn("turns", F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = cut_lineage(plan.select("conv_id", "h", "taken", "turns"))
    lent = plan.select("conv_id", "turns", F.explode("taken").alias("t")).select("conv_id", "turns", "t.*")
    moves = plan.select("conv_id", "turns", "h", (F.size("taken") - F.col("h")).alias("shift"))
    kept = digests.join(moves, "conv_id").filter("i >= h").withColumn("i", F.col("i") + F.col("shift"))
    both = lent.unionByName(kept.select("conv_id", "turns", "i", "a", "b", "size"))
    return both.select("conv_id", "i", "a", "b", "size", (F.col("i") == F.col("turns") - 1).alias("last")), plan.select("conv_id", "turns")


def _prefix_sums(carried: dict[int, tuple[int, int, int]] | None):
    """Sums of the turns' bits, salted by their places, along every conversation of a sorted task.

    Without `carried`: one row per task with its last conversation and the sums that it has there.
    With it: all rows, going on from what earlier tasks have of the task's first conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, a, b, task, whole = None, np.uint64(0), np.uint64(0), -1, True
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, place = batch.column("conv_id").to_numpy(), batch.column("i").to_numpy().astype(np.uint64)
            if conv is None:
                task = int(batch.column("task")[0].as_py())
                conv = int(ids[0])
                if carried and task in carried:
                    before, x, y = carried[task]
                    if before == conv:
                        a, b = np.uint64(x % 2**64), np.uint64(y % 2**64)
            edges = np.flatnonzero(np.diff(ids)) + 1
            starts = np.concatenate(([0], edges))
            lengths = np.diff(np.concatenate((starts, [len(ids)])))
            sums = []
            for name, salt, at_start in (("a", 0x9E3779B97F4A7C15, a), ("b", 0xC2B2AE3D27D4EB4F, b)):
                item = mix(batch.column(name).to_numpy().astype(np.int64).view(np.uint64) ^ mix(place * np.uint64(salt) + np.uint64(salt)))
                running = np.cumsum(item, dtype=np.uint64)
                base = np.repeat(running[starts] - item[starts], lengths)
                total = running - base
                if int(ids[0]) == conv:
                    total[: lengths[0]] += at_start
                sums.append((total, item))
            whole = whole and len(edges) == 0 and int(ids[0]) == conv
            conv, a, b = int(ids[-1]), sums[0][0][-1], sums[1][0][-1]
            if carried is not None:
                above = [np.where(place > 0, total - item, 0).astype(np.uint64) for total, item in sums]
                columns = [batch.column(c) for c in ("conv_id", "i", "size", "last")] + [pa.array(signed(s)) for s in (sums[0][0], sums[1][0], *above)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "i", "size", "last", "x", "y", "px", "py"])
        if carried is None and conv is not None:
            columns = [pa.array([v]) for v in (task, conv, int(signed(np.array([a]))[0]), int(signed(np.array([b]))[0]), whole)]
            yield pa.RecordBatch.from_arrays(columns, ["task", "conv_id", "x", "y", "whole"])

    return run


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, size, last, x, y, px, py): the 128-bit name of every prefix and of the prefix above it."""
    rows = placed(turns, "conv_id", "i")
    ends = rows.mapInArrow(_prefix_sums(None), "task long, conv_id long, x long, y long, whole boolean").collect()
    carried: dict[int, tuple[int, int, int]] = {}
    before: tuple[int, int, int] | None = None
    for end in sorted(ends):
        if before is not None:
            carried[end["task"]] = before
        x, y = end["x"], end["y"]
        if before is not None and end["whole"] and before[0] == end["conv_id"]:
            x, y = x + before[1], y + before[2]
        before = (end["conv_id"], x, y)
    named = rows.mapInArrow(_prefix_sums(carried), "conv_id long, i long, size long, last boolean, x long, y long, px long, py long")
    return named.withColumn("depth", F.col("i") + 1).drop("i")


# ------------------------------------------------------------------ list ranking


def _home(ids: np.ndarray, deal: int, tasks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) ^ mix(np.array([deal * 2 + 1], np.uint64))) % np.uint64(tasks)).astype(np.int64)


def _coin(ids: np.ndarray, deal: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) ^ mix(np.array([deal * 2 + 2], np.uint64))) >> np.uint64(40)) & np.uint64(1) == 1


def _dealt(deal: int, tasks: int):
    """Segments with the task they go to: their own home, or their successor's if the coins say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, after = batch.column("id").to_numpy(), batch.column("next").to_numpy()
            moves = (after >= 0) & _coin(own, deal) & ~_coin(after, deal)
            home = np.where(moves, _home(after, deal, tasks), _home(own, deal, tasks))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])

    return run


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments of a task: each gets the head of the longer segment it now belongs to, and the weight before it there.

    Heads also get that segment's weight and successor.
    """
    found = [batch for batch in batches if batch.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    own, after, weight = (table.column(c).to_numpy() for c in ("id", "next", "weight"))
    order = np.argsort(own)
    own, after, weight = own[order], after[order], weight[order]
    n = len(own)
    spot = np.minimum(np.searchsorted(own, after), n - 1)
    local = own[spot] == after
    before = np.full(n, -1)
    before[spot[local]] = np.flatnonzero(local)
    head, offset = np.where(before >= 0, before, np.arange(n)), np.where(before >= 0, weight[before], 0)
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        offset, head = offset + offset[head], further
    last = ~local  # the last piece of each segment: one per head
    total, follows = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    total[head[last]], follows[head[last]] = offset[last] + weight[last], after[last]
    columns = [own, own[head], offset, head == np.arange(n), total, follows]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "head", "offset", "leads", "total", "follows"])


SEGMENTS = "id long, head long, offset long, leads boolean, total long, follows long"


def list_ranks(links: DataFrame, near: str, per_task: int = ARCS_PER_TASK) -> DataFrame:
    """(id, next) of one linked list, next = -1 at its end -> (id, rank), rank 0 at its start.

    Rows that agree in column `near`, or lie close in it, begin in one task.
    """
    deals: list[DataFrame] = []
    left, rows = links.select("id", "next", F.lit(1).cast("long").alias("weight"), near), links.count()
    while rows:
        tasks = -(-rows // per_task)
        if not deals:
            spread = left.repartitionByRange(tasks, near, "id").drop(near)
        else:
            homes = left.mapInArrow(_dealt(len(deals), tasks), "id long, next long, weight long, home long")
            spread = homes.repartition(tasks, "home").drop("home")
        deals.append(cut_lineage(spread.mapInArrow(_join_segments, SEGMENTS)))
        left = deals[-1].filter("leads").select(F.col("id"), F.col("follows").alias("next"), F.col("total").alias("weight"))
        if tasks == 1:
            break
        rows = left.count()
    if not deals:
        return links.select("id", F.lit(0).cast("long").alias("rank"))
    ranks = deals[-1].select("id", F.col("offset").alias("rank"))
    for deal in reversed(deals[:-1]):
        heads = sent_if_few(cut_lineage(ranks.select(F.col("id").alias("head"), F.col("rank").alias("first"))))
        ranks = deal.join(heads, "head").select("id", (F.col("first") + F.col("offset")).alias("rank"))
    return ranks


def sums_before(rows: DataFrame, values: list[str], at: str = "rank") -> DataFrame:
    """Add `<value>_before`, the sum of all rows of lesser `at`, a dense number from 0; no window holds more than 2**16 rows.

    Three levels of blocks: enough for 2**48 rows.
    """
    level, out = [rows.withColumn("block", F.shiftright(at, SUM_BITS))], None
    for _ in range(2):
        sums = level[-1].groupBy("block").agg(*[F.sum(v).alias(v) for v in values])
        level.append(sums.withColumnRenamed("block", "sub").withColumn("block", F.shiftright("sub", SUM_BITS)))
    for depth in (2, 1, 0):
        order = "sub" if depth else at
        w = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        local = level[depth].withColumns({f"{v}_before": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
        if out is not None:
            more = out.select(F.col("sub").alias("block"), *[F.col(f"{v}_before").alias(f"__{v}") for v in values])
            local = local.join(more, "block").withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"__{v}") for v in values})
            local = local.drop(*[f"__{v}" for v in values])
        out = local
    return out.drop("block")


# ------------------------------------------------------------------ the trie


def _digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (x, y, depth, piece, ids) in order to one SHA-256 per node, without holding a node's ids."""
    now, digest = None, None

    def done(key, digest):
        columns = [pa.array([v]) for v in (*key, digest.hexdigest())]
        return pa.RecordBatch.from_arrays(columns, ["x", "y", "depth", "ends_sha256"])

    for batch in batches:
        for x, y, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "depth", "ids"))):
            if now != (x, y, depth):
                if digest is not None:
                    yield done(now, digest)
                now, digest = (x, y, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest is not None:
        yield done(now, digest)


def end_digests(ends: DataFrame) -> DataFrame:
    """(x, y, depth, conv_id) -> one SHA-256 per node of its conv_ids, ascending, comma-joined.

    Ids are joined in pieces of a fixed range first, so a node where many conversations end sends few rows; a digest
    itself can only be made in order, by one task that streams the pieces.
    """
    pieces = ends.groupBy("x", "y", "depth", F.floor(F.col("conv_id") / ENDS_PER_PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    dealt = pieces.repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "piece")
    return dealt.select("x", "y", "depth", "ids").mapInArrow(_digest_stream, "x long, y long, depth long, ends_sha256 string")


def _neighbours(nodes: DataFrame) -> DataFrame:
    """Nodes numbered with siblings side by side, and `after`, the number of the next sibling (null for the last one)."""
    rows = numbered(nodes, "depth", "px", "py", "conv_id", name="id")
    rows = cut_lineage(rows)
    follows = rows.select((F.col("id") - 1).alias("id"), F.struct("depth", "px", "py").alias("group"), F.lit(True).alias("any"))
    joined = rows.join(follows, "id", "left")
    same = F.coalesce(F.col("any") & (F.col("group") == F.struct("depth", "px", "py")), F.lit(False))
    return cut_lineage(joined.withColumn("after", F.when(same, F.col("id") + 1)).drop("group", "any"))


def prefix_nodes(named: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node from `prefixes` and (conv_id, turns) of all conversations; see `conversation_trie`."""
    node = ["x", "y", "depth"]
    named = cut_lineage(named)
    deep = named.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.min("px").alias("px"), F.min("py").alias("py")
    )
    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = top.select(*[zero.alias(n) for n in node], "conv_id", "n_convs", zero.alias("size"), zero.alias("px"), zero.alias("py"))
    nodes = _neighbours(deep.unionByName(top))

    # first and last children meet their parents: one row of each per parent, however many children there are
    count = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth"))
    children = count.agg(F.min("id").alias("child"), F.max("id").alias("youngest"), F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    enter, leave = (lambda i: F.col(i) * 2), (lambda i: F.col(i) * 2 + 1)
    down = nodes.select(enter("id").alias("id"), F.coalesce(enter("child"), leave("id")).alias("next"), "conv_id")
    aside = nodes.filter("after IS NOT NULL").select(leave("id").alias("id"), enter("after").alias("next"), "conv_id")
    up = nodes.filter("youngest IS NOT NULL").select(leave("youngest").alias("id"), leave("id").alias("next"), "conv_id")
    end = nodes.filter("depth = 0").select(leave("id").alias("id"), F.lit(-1).cast("long").alias("next"), "conv_id")
    tour = cut_lineage(reduce(DataFrame.unionByName, (down, aside, up, end)))
    ranks = list_ranks(tour, "conv_id")

    worth = nodes.select(
        enter("id").alias("id"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    )
    arcs = ranks.join(worth, "id", "left").fillna(0, ["leaves", "saved"])
    sums = sums_before(cut_lineage(arcs), ["leaves", "saved"])
    spans = sums.groupBy(F.shiftright("id", 1).alias("id")).agg(
        *[(F.max(f"{v}_before") - F.min(f"{v}_before")).alias(v) for v in ("leaves", "saved")]
    )
    out = nodes.join(spans, "id")

    ends = named.filter("last").select(*node, "conv_id").unionByName(conversations.filter("turns = 0").select(*[zero.alias(n) for n in node], "conv_id"))
    out = out.join(end_digests(ends), node, "left")
    # children of the root, often most nodes, need no join to know it
    root = nodes.filter("depth = 0").select("conv_id").scalar()
    parents = nodes.filter("depth > 0 AND n_children > 0").select(
        F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above")
    )
    near = out.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root))
    far = out.filter("depth > 1").join(parents, ["px", "py", "depth"]).withColumnRenamed("above", "parent_conv_id")
    both = near.unionByName(far.select(*near.columns))
    return both.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True
) -> DataFrame:
    """One row per distinct prefix of the conversations: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by `turn_col`, null first, equal ones by role and text; null role and text are empty.  With `rebuild`
    conversations first take over turns of others (`rebuilt_turns`).  Rows without conversation id take no part;
    repeated rows are turns of their own.  A conversation that is left without turns ends at the root.  An empty
    table has no nodes.  saved_tokens and n_leaves are summed over a node's subtree, itself included.
    Other columns are not looked at.  Prefixes are told apart by 128 bits.
    """
    digests = cut_lineage(_turn_digests(turns, conv_col, turn_col, role_col, text_col))
    if rebuild:
        kept, conversations = rebuilt_turns(digests)
    else:
        conversations = cut_lineage(digests.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")))
        kept = digests.join(conversations, "conv_id").withColumn("last", F.col("i") == F.col("turns") - 1).drop("turns")
    return prefix_nodes(prefixes(kept), conversations)
