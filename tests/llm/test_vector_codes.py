"""Operator 12 against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min((dist(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for c in cut:
                got.setdefault(nearest(p, c[p])[1], []).append(c[p])
            new.append([[sum(a) // len(a) for a in zip(*got[i])] if i in got else e for i, e in enumerate(books[p])])
        books = new
    out = []
    for (i, _, lab), c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{b:02x}" for _, b in best), sum(d for d, _ in best), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    flat = ",".join(str(x) for book in books for e in book for x in e)
    digest = __import__("hashlib").sha256(flat.encode()).hexdigest()
    return sorted(((i, code, e, total[lab], digest) for i, code, e, lab in out), key=str)


def report(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("mine"), "part": F.lit(1), "of": F.lit(0)}).repartition(3)
    return sorted((tuple(r) for r in vector_codes.code_report(df, parts, entries, rounds).collect()), key=str)


@pytest.mark.parametrize(("parts", "width", "entries", "rounds", "block"), [(2, 3, 5, 2, 8), (4, 1, 7, 3, 256), (3, 2, 64, 1, 4), (1, 4, 2, 0, 16)])
def test_random_vectors_agree(spark, monkeypatch, parts, width, entries, rounds, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(parts)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.1, parts * width)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(120)]
    assert report(spark, rows, parts, entries, rounds) == brute(rows, parts, entries, rounds)


def test_ties_copies_and_rows_that_take_no_part(spark):
    rows = [(i, [float(i % 4), 0.0, -0.001, float(i % 2)], i % 2) for i in range(40)]  # entries repeat: every tie goes to the lower index
    rows += [(1, [0.5, 0.5, 0.5, 0.5], None), (1, [0.25, 0.5, 0.5, 0.5], None), (None, [9.0, -9.0, 1e-9, -1e-9], 4)]
    out = [(100, None, 0), (101, [], 0), (102, [1.0, None, 0.0, 0.0], 0), (103, [math.nan, 0.0, 0.0, 0.0], 0), (104, [math.inf, 0.0, 0.0, 0.0], 0), (105, [-math.inf] * 4, 0)]
    assert report(spark, rows + out, 2, 8, 2) == brute(rows + out, 2, 8, 2)
    hot = [(i, [0.125] * 4, 1) for i in range(3000)] + [(5000 + i, [i / 100, 0.0, 0.0, -i / 50], 2) for i in range(60)]
    assert report(spark, hot, 2, 4, 2) == brute(hot, 2, 4, 2)


def test_empty_table_other_lengths_and_large_components(spark):
    assert report(spark, [], 2, 4, 2) == []
    assert [r[0] for r in report(spark, [(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, [2.0, 2.0], 0)], 2, 4, 2)] == [1, 3]
    uneven = [(i, [i / 7, 0.5, -i / 3], 0) for i in range(9)]  # filled up with zeros
    assert report(spark, uneven, 2, 4, 1) == brute([(i, [*v, 0.0], lab) for i, v, lab in uneven], 2, 4, 1)
    with pytest.raises(Exception, match="fit a long"):
        report(spark, [(1, [1e9, 0.0], 0)], 2, 4, 2)


@pytest.mark.parametrize(("width", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_curve_visits_neighbours(width, bits):
    side = 1 << bits
    points = np.array(list(itertools.product(range(side), repeat=width)), dtype=np.int64)
    fine = (1 << min(20, 60 // width)) // side  # the curve of the coarse grid is that of the fine one, seen from afar
    keys = vector_codes.hilbert_keys(points * fine, np.zeros(width, np.int64), np.full(width, (1 << min(20, 60 // width)) - 1))
    assert len(set(keys.tolist())) == len(points)
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_lose_no_entry():
    rng = np.random.default_rng(0)
    for _ in range(200):
        points, book = rng.integers(-20, 20, (9, 3)) // 4 + rng.integers(-9, 9, 3), rng.integers(-20, 20, (12, 3))
        among = vector_codes.shortlist(points.min(axis=0), points.max(axis=0), book)
        code, error = vector_codes.nearest_entries(points, book, among)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def test_blocks_prune(spark, monkeypatch):
    """Sorted along the curve, small blocks leave few entries to compare."""
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 4)], 0) for i in range(4000)]
    whole = vector_codes.integer_vectors(spark.createDataFrame(rows, SCHEMA), 2, "vec_id", "embedding", "label")
    books = vector_codes.first_codebooks(whole, 2, 64)
    blocks = vector_codes.hilbert_blocks(whole, 2).collect()
    assert sum(b.n for b in blocks) == 8000
    sizes = [len(vector_codes.shortlist(np.array(b.low), np.array(b.high), books[b.part])) for b in blocks]
    assert np.mean(sizes) < 24
