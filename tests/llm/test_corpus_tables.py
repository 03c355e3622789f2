"""Operators 1, 6 and 9, the registered queries and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cliplab.llm import mixing, neighbours, queries, url_templates

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, todo, left = {}, set(names), share * sum(sizes.values())
    while todo:
        level = left / sum(weight[s] for s in todo)
        over = {s for s in todo if weight[s] * level > limit * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in todo}
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        todo -= over
    return target


def check_mix(docs, rows):
    got = mixing.mix_copies(docs).collect()
    sizes = {}
    for source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return want, taken


def test_mix_meets_targets_and_reruns_agree(some):
    want, taken = check_mix(some, [(r.source, r.text) for r in some.collect()])
    largest = some.select(F.max(mixing.word_count(F.col("text")))).first()[0]
    assert all(abs(taken[s] - want[s]) <= largest / 2 for s in want)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.02)
    again = mixing.mix_copies(some.repartition(3))
    assert mixing.mix_copies(some).exceptAll(again).count() == 0


def test_rates_solve_the_dual(some):
    """Newton's tilts agree with bisection, source by source."""
    sized = some.select("source", mixing.word_count(F.col("text")).alias("size"))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = mixing.tilts(counts, mixing.source_targets(totals, (3.0, 1.0, 2.0), 1.5, 2.0), 1.5, 2.0).collect()
    table = counts.toPandas()
    for s in solved:
        own = table[table["source"] == s.source]
        size, n = own["size"].to_numpy(float), own["n"].to_numpy(float)
        low, high = -1e4, 1e4
        for _ in range(200):
            tilt = (low + high) / 2
            got = (n * size * np.minimum(2, 1.5 * np.exp(np.minimum(tilt * size / s["mean"], 50)))).sum()
            low, high = (tilt, high) if got < s.target else (low, tilt)
        assert s.full or s.tilt == pytest.approx(tilt, abs=1e-6)


def test_mix_of_edge_cases(edge, nothing, spark):
    check_mix(edge, [(r.source, r.text) for r in edge.collect()])
    assert mixing.mix_copies(nothing).count() == 0
    assert mixing.mixed_documents(nothing).columns == nothing.columns
    hot = spark.createDataFrame([(i, "a b c d e", "hot") for i in range(3000)] + [(9000, "x " * 50, "b"), (9001, None, None)], "doc_id long, text string, source string")
    want, taken = check_mix(hot, [(r.source, r.text) for r in hot.collect()])
    assert abs(taken["hot"] - want["hot"]) <= 5
    assert mixing.mixed_documents(hot).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


# ------------------------------------------------------------------ urls


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), ("https://x.net/q", "x.net", "/q", "net/"),
        ("x://example.com/de/5", "example.com", "/de/5", "example.com/de/"), ("x://notexample.com/de/5", "notexample.com", "/de/5", None),
        ("x://org/fr/", "org", "/fr/", "org/fr/"), ("http://a.net", "a.net", "", None), ("http://a.net?b/c", "a.net", "", None),
        (None, "", "", None), ("no scheme/at all", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("", "", "", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    h, p = url_templates.url_parts(F.col("url"))
    row = spark.createDataFrame([(url,)], "url string").select(h.alias("h"), p.alias("p"), url_templates.rule_for(h, p, rules)[0].alias("r")).first()
    assert tuple(row) == (host, path, rule)


def test_templates_reject_impure_branches(spark):
    pages = [(i, f"http://h.com/spam/{i}") for i in range(60)] + [(100 + i, f"http://h.com/news/{i}.html") for i in range(60)]
    pages += [(200 + i, f"http://h.com/tag/t{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)] + [(999, None), (998, "http://g.com/new")]
    labels = [(i, True) for i in range(0, 60, 2)] + [(100 + i, False) for i in range(0, 60, 2)] + [(200 + i, False) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (1, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_templates.judge_urls(df, marks, {"g.com/": "block"}).collect()}
    assert len(got) == len(pages)
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[i].verdict for i in [*range(100, 160), *range(200, 260)]} == {"allow"}
    assert got[1].template == "/spam/#" and got[101].template == "/news/#.html" and got[200].template.startswith("/tag/*/")
    assert (got[998].verdict, got[998].rule, got[999].verdict, got[999].template) == ("block", "g.com/", "allow", "")
    unlabelled = url_templates.judge_urls(df, marks.limit(0), {}).collect()
    assert {r.verdict for r in unlabelled} == {"allow"} and len(unlabelled) == len(pages)
    assert url_templates.judge_urls(df.limit(0), marks, {}).count() == 0
    deep = spark.createDataFrame([(1, "http://d.com/" + "a/" * 500)], "page_id long, url string")
    assert url_templates.judge_urls(deep, marks, {}, max_depth=6).first().template == "/a/a/a/a/a/a/**"
    assert url_templates.judge_urls(deep, marks, {}).first().template == "/a" * 500


def test_the_query_tells_deep_branches_apart(spark, monkeypatch):
    pages = [(i, f"http://h.org/a/b/c/d/e/f/{'bad' if i % 4 == 0 else 'good'}/{i}") for i in range(160)]
    tables = {
        "pages": spark.createDataFrame(pages, "page_id long, url string"),
        "labels": spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(160)], "doc_id long, toxic int, quality int"),
    }
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: tables[name])
    got = {r.page_id: (r.template, r.verdict) for r in queries.QUERIES["op6_url_templates"](spark, "").collect()}
    assert set(got.values()) == {("/a/b/c/d/e/f/bad/#", "block"), ("/a/b/c/d/e/f/good/#", "allow")}
    assert all((got[i][1] == "block") == (i % 4 == 0) for i in got)


def test_branches_are_pooled_below_wildcards(spark):
    pages = [(i, f"http://h.com/user/n{chr(97 + i % 26)}{chr(97 + i // 26)}/{'spam' if i % 4 == 0 else 'posts'}/s{chr(97 + i % 23)}{chr(97 + i // 23)}") for i in range(200)]
    marks = [(i, i % 4 == 0) for i in range(0, 200, 2)]
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*marks, (0, False), (None, True)], "page_id long, bad boolean")
    got = {r.page_id: (r.template, r.verdict) for r in url_templates.judge_urls(df, labels, {}).collect()}
    assert set(got.values()) == {("/user/*/posts/*", "allow"), ("/user/*/spam/*", "block")}
    assert all((got[i][1] == "block") == (i % 4 == 0) for i in got)


def _templates(rows: list[tuple], many: int = 8, share: float = 0.3) -> dict:
    """Brute force, level by level: (host, segments, n, labelled, bad) -> template."""
    names = {(r[0], r[1]): () for r in rows}
    for level in range(max((len(r[1]) for r in rows), default=0)):
        nodes: dict = {}
        for host, segments, *counts in rows:
            if len(segments) > level:
                child = nodes.setdefault((host, names[host, segments]), {}).setdefault(segments[level], [0, 0, 0])
                child[:] = [a + b for a, b in zip(child, counts, strict=True)]
        spelled = dict(names)
        for host, segments, *_ in rows:
            if len(segments) <= level:
                continue
            children = nodes[host, names[host, segments]]
            n, labelled, bad = (sum(c[i] for c in children.values()) for i in range(3))
            _, own, wrong = children[segments[level]]
            name = "~"
            if len(children) >= many and len(children) >= share * n:
                name = "*"
            elif len(children) == 1:
                name = segments[level]
            elif 0 < own < labelled and 0 < bad < labelled:
                rate = bad / labelled
                gap = abs(wrong / own - (bad - wrong) / (labelled - own))
                name = segments[level] if gap > 1.96 * (rate * (1 - rate) * (1 / own + 1 / (labelled - own))) ** 0.5 else "~"
            spelled[host, segments] = (*names[host, segments], name)
        names = spelled
    return {k: "".join(f"/{n}" for n in v) for k, v in names.items()}


def test_templates_equal_a_tree_grown_level_by_level(spark):
    draw = random.Random(4)
    rows = {}
    for _ in range(400):
        wide = draw.choice([2, 3, 40])
        path = tuple(f"s{draw.randrange(wide)}" for _ in range(draw.randrange(7)))
        n = draw.randrange(1, 9)
        labelled = draw.randrange(n + 1)
        rows["h" + str(draw.randrange(3)), path] = (n, labelled, labelled if path[:1] == ("s1",) else draw.randrange(labelled + 1))
    table = [(host, path, *counts) for (host, path), counts in rows.items()]
    df = spark.createDataFrame([(h, list(p), *c) for h, p, *c in table], "host string, segments array<string>, n long, labelled long, bad long")
    got = {(r.host, tuple(r.segments)): r.template for r in url_templates.path_templates(df).collect()}
    assert got == _templates(table)


# ------------------------------------------------------------------ neighbours


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            other = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = other[:k]
    return out


def test_recall_of_nearest(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    want = brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()], 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([i in got[q] for q, best in want.items() for _, i in best]) >= 0.9
    for q, best in want.items():
        true = dict((i, s) for s, i in best)
        assert all(s == pytest.approx(true[i], rel=1e-12) for i, (_, s) in got[q].items() if i in true)
        ranked = sorted(got[q].items(), key=lambda x: x[1][0])
        assert [(s, i) for i, (_, s) in ranked] == sorted((s, i) for i, (_, s) in ranked)


def test_nearest_of_edge_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1)]
    rows += [(6, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (7, [2.0, 0.0, 1.0], 1), (40, [3.0, 0.0, 1.0], 1), (8, [0.5, 0.0], 1), (8, [0.25, 0.0], 1), (60, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    root2 = round(2**0.5, 6)
    assert got == [
        (0, 1, 20, 0.0), (0, 2, 8, 0.5), (0, 3, 1, root2), (20, 1, 0, 0.0), (20, 2, 8, 0.5), (20, 3, 1, root2), (40, 1, 7, 1.0),
    ]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    # one vector held by most rows: its cell is split, ties go to the smaller ids
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", 50)
    hot = spark.createDataFrame([(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.0]) for i in range(1, 601)], "vec_id long, embedding array<double>")
    first = neighbours.nearest(hot, F.col("vec_id") == 100, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in first] == [(1, 0.0), (2, 0.0), (4, 0.0), (5, 0.0), (7, 0.0)]


def test_perturbations_come_in_order_of_cost():
    inside = np.array([0.1, 0.45, 0.8])
    sets = neighbours.perturbations(inside, 27)
    cost = [sum(inside[m] ** 2 if step < 0 else (1 - inside[m]) ** 2 for m, step in s) for s in sets]
    assert sets[0] == [] and cost == sorted(cost) and len({tuple(sorted(s)) for s in sets}) == 27


# ------------------------------------------------------------------ queries and pipeline


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, edge):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_windows", "mix", "sentencepiece"]
    rows = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in rows.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in documents.select("doc_id").collect()} and len(ids) > 0.8 * documents.count()
    assert rows.filter("NOT round_trip").count() == 0
    docs = edge.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "sentencepiece" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_mixed_rows_without_or_with_repeated_ids(spark):
    rows = [(None, f"w{i} x y" + " z" * (i % 7), "a") for i in range(400)] + [(None, "same text of many", "b")] * 200
    rows += [(1, "one two", "a"), (1, "other words here", "a"), (1, "one two", None), (2, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs = docs.withColumns({"rows": F.lit("r"), "mix_n": F.lit("n"), "copies": F.lit(5), "Size": F.lit(6), "a.b": F.lit(7)})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    due = mixing.mix_copies(docs).groupBy("source").agg(F.sum("copies").alias("n"), F.sum("taken").alias("words"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(mixing.word_count(F.col("text"))).alias("words"))
    want = {r.source: (r.n, r.words) for r in due.collect() if r.n}
    assert {r.source: (r.n, r.words) for r in got.collect()} == want
    assert want["a"][1] > 400 and want["b"][0] >= 200
