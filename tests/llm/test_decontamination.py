"""Operator 11 against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cliplab.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[key]
        out.append((doc, len(w), len(hit), sorted(str(i) for i in ids if i is not None), bool(hit)))
    return sorted(out, key=str)


def judged(spark, docs, items, width):
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "term": F.lit("x")}).repartition(3)
    right = spark.createDataFrame(items, ITEMS).withColumn("seq", F.lit(2))
    return sorted((tuple(r) for r in decontamination.contamination(left, right, width).collect()), key=str)


@pytest.mark.parametrize(("seed", "width", "kinds"), [(1, 4, 6), (2, 3, 3), (3, 10, 40), (4, 1, 5)])
def test_random_texts_agree(spark, seed, width, kinds):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"W{rng.randrange(kinds)}" for _ in range(n))
    items = [(i % 9, text(rng.choice([1, 2, width, 3 * width]))) for i in range(12)] + [(50, None), (51, " .,!"), (None, text(width))]
    docs = [(i % 30 if i % 7 else None, text(rng.choice([0, 1, 5, 40]))) for i in range(60)] + [(99, None), (98, "")]
    docs += [(200 + i, text(5) + ", " + items[i][1] + "; " + text(3)) for i in range(12)]
    assert judged(spark, docs, items, width) == brute(docs, items, width)


def test_spelling_repeats_and_very_long_texts(spark):
    passage = "Été ünï 12a the Quick-brown fox, jumps over\x7fa lazy dog \U0001f642x"
    long = " ".join(f"x{i % 977}y{i % 31}" for i in range(30_000))
    items = [(7, passage), (7, passage), (8, passage.upper()), (10, "one"), (3, "a " * 30), (4, long[:2000])]
    docs = [(1, passage.replace(" ", " \n ")), (1, passage), (2, "one two"), (3, "b " + "a " * 200), (4, long), (5, long), (6, "fox the"), (None, "ONE")]
    got = judged(spark, docs, items, 10)
    assert got == brute(docs, items, 10)
    assert any(row[3] == ["10"] and row[0] is None for row in got)


def test_empty_sides(spark):
    docs, items = [(1, "a b c")], [(1, "a b c")]
    assert judged(spark, [], items, 2) == []
    assert judged(spark, docs, [], 2) == [(1, 3, 0, [], False)]


def test_sides_too_large_to_be_sent(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(12)}" for _ in range(n))
    items, docs = [(i, text(8)) for i in range(6)], [(i, text(60)) for i in range(40)]
    monkeypatch.setattr(decontamination.sent_if_few, "__defaults__", (0, None))
    assert judged(spark, docs, items, 3) == brute(docs, items, 3)


def test_phrases_and_proximity_name_their_places(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "d q c q b q a"), (3, "a b"), (4, "a . . b, c; d e")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a b c d")], ITEMS)
    runs = sorted(tuple(r) for r in decontamination.phrase_matches(docs, items, 4).collect())
    assert runs == [(1, 5, 1, 0, 4), (4, 5, 0, 0, 4)]
    near = {r.doc_id for r in decontamination.proximity_matches(docs, items, width=4, reach=6).collect()}
    assert near == {1, 2, 4}
    assert {r.doc_id for r in decontamination.proximity_matches(docs, items, width=4, reach=3).collect()} == {1, 4}


def test_proximity_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(50))) for i in range(20)]
    item, reach = ["w1", "w2", "w3", "w1"], 4
    got = decontamination.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], ITEMS), 4, reach)
    counts = {t: sum(text.split().count(t) for _, text in docs) for t in set(item)}
    found = {(r.doc_id, r.pos) for r in got.collect()}
    rare = {t for t, n in counts.items() if n == min(counts.values())}
    every = {
        (doc, pos) for doc, text in docs for pos, w in enumerate(text.split())
        if w in rare and all(t in text.split()[max(0, pos - reach) : pos + reach + 1] for t in item)
    }
    assert found <= every and (len(rare) > 1 or found == every)


def test_index_holds_all_postings_of_the_vocabulary(spark, some):
    items = decontamination.read_items(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    index = decontamination.build_index(some, items.vocabulary)
    known = {r.word for r in items.vocabulary.collect()}
    texts = [words(r.text) for r in some.collect()]
    assert index.postings.count() == sum(w in known for t in texts for w in t)
    assert sorted(r.n_words for r in index.rows.collect()) == sorted(map(len, texts))
