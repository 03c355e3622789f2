"""Operator 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cliplab.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, rebuild=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "id": F.lit(1), "row": F.lit(2)}).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, rebuild=rebuild).collect()), key=str)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = c if c % 11 else 100 * c
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((conv, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "ü\U0001f642", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_talks_agree(spark, seed):
    rows = talks(seed, 130)
    assert trie(spark, rows) == brute(rows)


def test_one_deep_and_one_wide_tree_in_many_tasks(spark, monkeypatch):
    """A conversation of a third of all rows, a root with most children, small tasks that no step may rely on."""
    monkeypatch.setattr(prefix_trie, "ARCS_PER_TASK", 64)
    monkeypatch.setattr(prefix_trie.list_ranks, "__defaults__", (64,))
    monkeypatch.setattr(prefix_trie, "SUM_BITS", 4)
    monkeypatch.setattr(prefix_trie, "ENDS_PER_PIECE", 8)
    rows = [(3, t, "u", f"t{t % 5}") for t in range(300)] + [(7, t, "u", f"t{t % 5}") for t in range(250)]
    rows += [(1000 + c, 0, "u", f"only {c}") for c in range(250)] + [(5000 + c, t, "u", "same") for c in range(50) for t in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, rows) == brute(rows)
        assert trie(spark, rows, rebuild=False) == brute(rows, rebuild=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_cases(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "u", "x")]) == []
    # repeated rows, null turn first, a conversation that is left without turns (all own turns replaced, no other there)
    left = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(left, None, None, None), (left, 1, "u", "x"), (0, 1, "u", "y"), (0, 1, "u", "y"), (0, None, "b", "z" * 100_000), (None, 0, "u", "lost")]
    got = trie(spark, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] == hashlib.sha256(str(left).encode()).hexdigest() for r in got)


@pytest.mark.parametrize("n", [1, 2, 500, 3000])
def test_lists_of_any_order_are_ranked(spark, n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    after = {a: b for a, b in zip(order, order[1:])}
    links = spark.createDataFrame([(i, after.get(i, -1), i % 7) for i in range(n)], "id long, next long, place long").repartition(3)
    ranks = {r.id: r["rank"] for r in prefix_trie.list_ranks(links, "place", per_task=200).collect()}
    assert [ranks[i] for i in order] == list(range(n))


def test_sums_before_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SUM_BITS", 3)
    rows = spark.createDataFrame([(i, i * i % 13) for i in range(500)], "rank long, v long").repartition(4)
    got = {r["rank"]: r.v_before for r in prefix_trie.sums_before(rows, ["v"]).collect()}
    assert all(got[i] == sum(j * j % 13 for j in range(i)) for i in range(0, 500, 37))
