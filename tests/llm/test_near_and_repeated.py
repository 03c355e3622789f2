"""Operators 5 and 7 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliplab.llm import jaccard_join, repeated_windows
from cliplab.llm.graph import components
from cliplab.llm.words import Words, text_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(out, key=str)


def near_copies(seed, percent):
    """Texts around the threshold: copies of a few originals with a growing number of changed words."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for size in (1, 2, 4, 7, 12, 25, 60, 150, 400):
        for _ in range(2):
            base = [f"{size}v{rng.randrange(10**6)}" for _ in range(size)]
            for changes in (0, 0, 1, 2, 3, 5, 8, 12):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(size)] = f"z{rng.randrange(10**6)}"
                rows.append((doc, " ".join(copy)))
                doc += 1
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted([(r[0], r[1], r[2]) for r in df.select("doc_id", "n_shingles", "component_id").collect()], key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, n, percent):
    rows = near_copies(n, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jaccard_join.jaccard_groups(df, n, percent)) == brute_groups(rows, n, percent)


def test_many_blocks_give_the_same_groups(spark, monkeypatch):
    rows = near_copies(11, 80)
    rows += [(1000 + i, " ".join(f"b{j}" if j != i % 90 else f"c{i}" for j in range(90))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 4)
    assert result(jaccard_join.jaccard_groups(df, 5, 80)) == brute_groups(rows, 5, 80)


def stretches(seed, texts):
    """Overlapping excerpts of a few word sequences, and chains of edits."""
    rng = random.Random(seed)
    rows = []
    for _ in range(texts):
        start = rng.randrange(0, 60)
        rows.append((len(rows), " ".join(f"s{seed}w{i}" for i in range(start, start + rng.randrange(90, 130)))))
    chain = [f"c{seed}w{i}" for i in range(80)]
    for i in range(texts):
        chain[rng.randrange(80)] = f"e{seed}w{i}"
        rows.append((len(rows), " ".join(chain)))
    return rows


def verified(rows, guests=(), n=1, percent=80):
    """Components of one block, as the least position of each text's group; guests are positions too."""
    sets = [next(jaccard_join.text_sets(pa.array([t]), n)) for _, t in rows]
    nodes = [int(np.uint64(jaccard_join.set_node(s)).astype(np.int64)) for s in sets]
    group = pd.DataFrame({"node": nodes, "text": [t for _, t in rows], "guest": [int(i in guests) for i in range(len(rows))]})
    found = jaccard_join._verify(n, percent)(group)
    name = dict(zip(found["node"], found["component"], strict=True))
    names = [name.get(x, x) for x in nodes]
    return [names.index(x) for x in names]


def brute_components(rows, n=1, percent=80):
    return [c for _, _, c in sorted(brute_groups(rows, n, percent))]


def test_large_clusters_are_parted(spark, monkeypatch):
    """Texts held together by a common passage, with chains and copies among them, in blocks of a few texts."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(rng.choice([3, 8, 30, 60]))]
        rows.append((i, " ".join(passage + own)))
        if i % 4 == 0:
            rows.append((200 + i, " ".join(passage + own[:-1] + ["other"])))
    rows += [(400 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))) for i in range(20)]  # each links with its neighbours only
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jaccard_join.jaccard_groups(df, 5, 80)) == brute_groups(rows, 5, 80)


def test_rows_without_or_with_repeated_ids(spark):
    base = [f"w{i}" for i in range(50)]
    near = " ".join(base[:49] + ["z"])
    rows = [(None, " ".join(base))] * 30 + [(None, near)] * 3 + [(None, f"n{i} own words of this text only") for i in range(60)]
    rows += [(1, "one two three four five six"), (1, "another text under the same id"), (2, "one two three four five six"), (3, near), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(jaccard_join.jaccard_groups(df, 5, 80)) == brute_groups(rows, 5, 80)
    clash = df.withColumns({"doc_key": F.lit("k"), "text_hash": F.lit(1), "Node": F.lit(2), "component": F.lit(3), "a.b": F.lit(4)})
    kept = jaccard_join.one_per_group(clash)
    assert kept.columns == clash.columns and {r["doc_key"] for r in kept.collect()} == {"k"}
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    # the group of the hot text keeps its row with an id; every text that links with nothing stays once
    assert sorted(t for t in texts if t[0] is not None) == sorted([(1, rows[93][1]), (1, rows[94][1]), (3, near), (3, "")])
    assert sum(d is None for d, _ in texts) == 61


def test_excerpts_and_edit_chains_of_one_block():
    """The leading group changes while sets are compared; no link may be lost by it."""
    four = [(i, " ".join(f"w{j}" for j in range(a, b))) for i, (a, b) in enumerate(((59, 167), (78, 170), (47, 142), (49, 155)))]
    assert verified(four) == brute_components(four) == [0, 0, 0, 0]
    for seed in range(30):
        rows = stretches(seed, 12)
        assert verified(rows) == brute_components(rows), seed


def test_guests_that_link_with_each_other_all_meet_the_block():
    """Of two linked guests only the later one links with a member."""
    words = [f"w{i}" for i in range(200)]
    spans = [(0, 100), (10, 110), (20, 120)]
    ordered = 0
    for salt in range(12):
        rows = [(i, " ".join(f"{salt}{w}" for w in words[a:b])) for i, (a, b) in enumerate(spans)]
        nodes = [jaccard_join.set_node(next(jaccard_join.text_sets(pa.array([t]), 1))) for _, t in rows]
        far, near = (int(np.uint64(nodes[i]).astype(np.int64)) for i in (2, 1))
        ordered += far < near  # guests come in order of their nodes
        assert verified(rows, guests=(1, 2)) == brute_components(rows) == [0, 0, 0], salt
    assert ordered


def test_signatures_of_linking_sets_meet():
    """Whatever differences a pair at the threshold has, it shares a signature."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        for size in (5, 6, 9, 10, 14, 19, 22, 33, 47, 70, 120, 333, 900):
            for _ in range(12):
                base = rng.integers(0, 2**63, size).astype(np.uint64)
                # a pair of sizes a >= b with as many differences as the threshold allows
                drop = int(rng.integers(0, size))
                while drop and 100 * (size - drop) < percent * size:
                    drop -= 1
                extra = 0
                while 100 * (size - drop) >= percent * (size + extra + 1):
                    extra += 1
                other = np.concatenate([base[drop:], rng.integers(0, 2**63, extra).astype(np.uint64)])
                a, b = (set(jaccard_join.set_signatures(np.unique(s), bands).tolist()) for s in (base, other))
                assert a & b or np.array_equal(np.unique(base), np.unique(other)), (percent, size, drop, extra)


def test_groups_of_edge_cases(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert result(jaccard_join.jaccard_groups(edge, 5, 80)) == brute_groups(rows, 5, 80)
    assert jaccard_join.jaccard_groups(nothing, 3, 90).count() == 0
    kept = jaccard_join.one_per_group(edge, 5, 80)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, None, 8, 10, 11], key=str)
    assert jaccard_join.one_per_group(nothing).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, []
    for doc, text in order:
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), (doc, i))
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] != (doc, i):
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def repeats(df, width=20):
    return sorted([tuple(r) for r in repeated_windows.repeated_word_report(df, width).collect()], key=str)


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(15, 70))] for k in range(6)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice([rng.choice(passages), [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))], ["la"] * rng.randrange(40)])
        rows.append((doc, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert repeats(df) == brute_repeats(rows, 20)
    assert repeats(df, 5) == brute_repeats(rows, 5)


def test_repeated_words_of_edge_cases(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert repeats(edge) == brute_repeats(rows, 20)
    assert repeats(nothing) == []
    out = repeated_windows.without_repeated_words(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == "" and texts[4] is None and texts[3] == "new end" and texts[7] == "  \t\n "
    assert repeated_windows.without_repeated_words(nothing).count() == 0


def test_rolling_hash_stands_for_the_words():
    import pyarrow as pa

    texts = ["a b c a b c", "", None, "é\x85é\u00a0x b c", "b c a"]
    data, offsets = text_buffers(pa.array(texts))
    words = Words(data, offsets)
    spelled = [data[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends, strict=True)]
    assert spelled == [w for t in texts for w in WORD.findall(t or "")]
    by_hash = {}
    hashes, whole = words.windows(3), words.complete(3)
    for i in np.flatnonzero(whole):
        assert by_hash.setdefault(int(hashes[i]), spelled[i : i + 3]) == spelled[i : i + 3]
    assert len(by_hash) == 4  # abc, bca, cab, and the third text's


def test_repeated_windows_of_rows_without_ids(spark):
    """Passages are found among rows without id, with work that stays linear; ids come first."""
    passage = " ".join(f"q{i}" for i in range(30))
    rows = [(None, f"a{i} b{i} {passage} c{i}") for i in range(300)] + [(5, f"x {passage} y")]
    report = repeated_windows.repeated_word_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20).collect()
    assert sorted(r.n_removed for r in report) == [0] + [30] * 300
    assert next(r.n_removed for r in report if r.doc_id == 5) == 0
