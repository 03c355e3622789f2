from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.functions import pvalues
from cliplab.operators import significance as sg


def placements(y, p):
    pos, neg = p[y == 1], p[y == 0]
    psi = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    return psi.mean(axis=1), psi.mean(axis=0)


def brute_delong(y, a, b):
    va, vb = placements(y, a), placements(y, b)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    var = np.var(va[0] - vb[0], ddof=1) / n1 + np.var(va[1] - vb[1], ddof=1) / n0
    return va[0].mean(), vb[0].mean(), (va[0].mean() - vb[0].mean()) / math.sqrt(var)


@pytest.fixture(scope="module")
def models(spark):
    rng = np.random.default_rng(11)
    y = np.repeat([1, 0], 60)
    probs = {
        "A": np.round(np.clip(rng.normal(0.3 + 0.4 * y, 0.15), 0, 1), 2),
        "B": np.round(rng.random(120), 1),
        "C": np.where(rng.random(120) < 0.5, 0.0, rng.random(120)),  # half the items share one score
    }
    rows = [(m, f"i{k}", int(y[k]), float(p[k])) for m, p in probs.items() for k in range(120)]
    return y, probs, spark.createDataFrame(rows, "model string, frame_id string, label int, prob double")


def test_delong_against_brute_force(models):
    y, probs, df = models
    rows = {(r["model_a"], r["model_b"]): r for r in sg.delong_pairs(df).collect()}
    assert set(rows) == {("A", "B"), ("A", "C"), ("B", "C")}
    for (a, b), r in rows.items():
        auc_a, auc_b, z = brute_delong(y, probs[a], probs[b])
        assert r["auc_a"] == pytest.approx(auc_a) and r["auc_b"] == pytest.approx(auc_b)
        assert r["z"] == pytest.approx(z, rel=1e-9)
        assert r["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert rows[("A", "B")]["significant"] and rows[("A", "B")]["z"] > 0


def test_identical_models_are_not_different(models, spark):
    _, _, df = models
    a = df.filter("model = 'A'")
    both = a.unionByName(a.withColumn("model", F.lit("copy")))
    r = sg.delong_pairs(both).first()
    assert r["z"] == 0.0 and r["p_value"] == 1.0 and not r["significant"]


def test_mean_placements_equal_the_auc(models):
    y, probs, df = models
    v = sg.placement_values(df, ["model"])
    means = v.groupBy("model").agg(
        (F.sum(F.col("pos") * F.col("v10")) / F.sum("pos")).alias("a"), (F.sum(F.col("neg") * F.col("v01")) / F.sum("neg")).alias("b")
    )
    for r in means.collect():
        want = placements(y, probs[r["model"]])[0].mean()
        assert r["a"] == pytest.approx(want) and r["b"] == pytest.approx(want)


def tail(spark, fn, rows):
    """Values of a column function over rows of numbers, in order."""
    schema = ", ".join(f"c{i} double" for i in range(len(rows[0])))
    df = spark.createDataFrame([(float(k), *map(float, r)) for k, r in enumerate(rows)], f"k double, {schema}")
    return [r[0] for r in df.orderBy("k").select(fn(*[F.col(f"c{i}") for i in range(len(rows[0]))])).collect()]


def test_tails(spark):
    assert tail(spark, pvalues.normal_p, [(1.959963984540054,)]) == [pytest.approx(0.05)]
    points = [(5.991464547107979, 2), (3.841458820694124, 1), (18.307038053275146, 10), (7.814727903251179, 3)]
    assert tail(spark, pvalues.chi2_p, points) == pytest.approx([0.05] * 4)
    assert tail(spark, pvalues.chi2_p, [(0, 4), (0, 5), (-1e-15, 1)]) == pytest.approx([1.0] * 3)
    # published studentized range points at infinite degrees of freedom
    ranges = [(2.772, 2), (3.314, 3), (3.858, 5), (4.474, 10)]
    assert tail(spark, pvalues.studentized_range_p, ranges) == pytest.approx([0.05] * 4, abs=2e-4)
    assert tail(spark, pvalues.studentized_range_p, [(0, 3), (40, 3)]) == pytest.approx([1.0, 0.0], abs=1e-12)
    # two normals: the range is sqrt(2) times a half normal
    for q in (0.3, 1.0, 4.0):
        assert tail(spark, pvalues.studentized_range_p, [(q, 2)])[0] == pytest.approx(math.erfc(q / 2), abs=1e-13)


def test_erfc_to_the_last_digits(spark):
    xs = [0.0, 1e-9, 0.01, 0.3, 0.49999, 0.5, 0.7, 1.0, 2.5, 6.2, 6.3, 9.0, 20.0, 26.0, -0.2, -3.0, -30.0]
    assert tail(spark, pvalues.erfc, [(x,) for x in xs]) == pytest.approx([math.erfc(x) for x in xs], rel=1e-12)


def test_null_statistics_have_no_p(spark):
    df = spark.createDataFrame([(None, 2.0)], "x double, k double")
    for fn in (pvalues.chi2_p, pvalues.studentized_range_p):
        assert df.select(fn(F.col("x"), F.col("k"))).first()[0] is None
        assert df.select(fn(F.col("k"), F.col("x"))).first()[0] is None
    assert df.select(pvalues.normal_p(F.col("x"))).first()[0] is None


def test_exact_signed_rank_by_enumeration(spark):
    cases, want = [(0, 5)], [0.0625]
    for n in (3, 5, 8):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(0, n * (n + 1) // 4 + 1):
            cases.append((w, n))
            want.append(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))
    assert tail(spark, pvalues.signed_rank_exact, cases) == pytest.approx(want)


def test_signed_rank_beyond_the_exact_range(spark):
    """Near the limit the normal approximation (without continuity correction) is close; ties and zeros always take it."""
    exact, rough = (tail(spark, lambda w, n, lim=lim: pvalues.signed_rank_pvalue(w, n, F.lit(0.0), F.lit(0), lim), [(500, 50)])[0] for lim in (50, 49))
    assert exact == pytest.approx(rough, abs=5e-3) and exact != rough
    tied = tail(spark, lambda w, n, t: pvalues.signed_rank_pvalue(w, n, t, F.lit(0)), [(2, 5, 6), (0, 0, 0)])
    z = (2 - 7.5) / math.sqrt(5 * 6 * 11 / 24 - 6 / 48)
    assert tied == pytest.approx([math.erfc(-z / math.sqrt(2)), 1.0])


@pytest.fixture(scope="module")
def folds(spark):
    table = {"a": [0.9, 0.8, 0.85, 0.95, 0.7], "b": [0.6, 0.8, 0.5, 0.7, 0.65], "c": [0.61, 0.62, 0.5, 0.71, 0.4]}
    rows = [("e", m, i, v) for m, vs in table.items() for i, v in enumerate(vs)] + [("e", "short", 0, 0.3)]
    return spark.createDataFrame(rows, "experiment string, model string, fold int, value double")


def test_incomplete_models_are_dropped(folds):
    kept = sg.complete_models(folds, 5)
    assert {r["model"] for r in kept.select("model").distinct().collect()} == {"a", "b", "c"}
    assert sg.complete_models(folds.filter("model in ('a', 'short')"), 5).count() == 0


def test_friedman_with_ties(folds):
    r = sg.friedman(sg.complete_models(folds, 5)).first()
    ranks = np.array([[1, 3, 2], [1.5, 1.5, 3], [1, 2.5, 2.5], [1, 3, 2], [1, 2, 3]])
    n, k = 5, 3
    raw = 12 / (n * k * (k + 1)) * (ranks.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)
    want = raw / (1 - 2 * (2**3 - 2) / (n * k * (k * k - 1)))
    assert r["statistic"] == pytest.approx(want)
    assert r["p_value"] == pytest.approx(math.exp(-want / 2))


def test_wilcoxon(folds):
    rows = {(r["model_a"], r["model_b"]): r for r in sg.wilcoxon_pairs(sg.complete_models(folds, 5)).collect()}
    ac = rows[("a", "c")]
    assert ac["n"] == 5 and ac["statistic"] == 0.0
    assert all(r["p_holm"] >= r["p_bh"] >= r["p_value"] - 1e-12 for r in rows.values())
    same = folds.filter("model = 'a'")
    r = sg.wilcoxon_pairs(same.unionByName(same.withColumn("model", F.lit("z")))).first()
    assert r["p_value"] == 1.0


def test_nemenyi_and_interval(folds, spark):
    rows = sg.nemenyi(sg.complete_models(folds, 5)).collect()
    assert len(rows) == 3 and all(0 <= r["p_value"] <= 1 for r in rows)
    r = sg.normal_interval(folds.filter("model = 'a'"), ["model"]).first()
    x = np.array([0.9, 0.8, 0.85, 0.95, 0.7])
    assert r["upper"] - r["mean"] == pytest.approx(1.959963984540054 * x.std(ddof=1) / math.sqrt(5))


def test_delong_sends_few_scores_to_every_task(models, monkeypatch):
    """Items stay where they are; with more scores than that the results are the same."""
    _, _, df = models
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    sent = sg.delong_pairs(df)
    assert "strategy=broadcast" in joins(sent)
    monkeypatch.setattr(sg, "SENT_SCORES", 0)
    shuffled = sg.delong_pairs(df)
    assert "strategy=broadcast" not in joins(shuffled)
    near = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert near(sent) == near(shuffled)
