"""Queries for DeLong and rank tests (D8, F4, H20-H25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplab.operators import clips, curves, significance
from cliplab.plans.evaluation import auroc_sql
from cliplab.plans.quality_queries import _rounded
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql


def placement_sql(src: str, groups: str) -> str:
    return f"""SELECT {groups}, score, pos, neg, (cn - 0.5::DOUBLE * neg) / tn AS v10, (tp - cp + 0.5::DOUBLE * pos) / tp AS v01 FROM (
      SELECT {groups}, score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY {groups}) AS tp, sum(neg) OVER (PARTITION BY {groups}) AS tn
      FROM (SELECT {groups}, prob AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {groups}, prob) WINDOW w AS (PARTITION BY {groups} ORDER BY score))"""


@query(
    "h20_placement_values",
    sql("predictions", f"SELECT model, score, pos::BIGINT AS pos, neg::BIGINT AS neg, round(v10, 9) AS v10, round(v01, 9) AS v01 FROM ({placement_sql('predictions', 'model')})"),
)
def h20(v: Views) -> DataFrame:
    out = significance.placement_values(v.predictions(), ["model"])
    return out.select("model", "score", "pos", "neg", F.round("v10", 9).alias("v10"), F.round("v01", 9).alias("v01"))


def delong_sql(src: str, item: str, digits: int = 6) -> str:
    """All pairs with AUCs and z."""
    return f"""WITH_PLACED v AS (SELECT p.{item} AS item, p.model, p.label, CASE WHEN p.label = 1 THEN v10 ELSE v01 END AS x FROM {src} p JOIN placed q ON p.model = q.model AND p.prob = q.score),
      moments AS (SELECT a.model AS model_a, b.model AS model_b, a.label, count(*) AS n, avg(a.x) AS ma, avg(b.x) AS mb, var_samp(a.x) + var_samp(b.x) - 2 * covar_samp(a.x, b.x) AS s
                  FROM v a JOIN v b ON a.item = b.item AND a.model < b.model GROUP BY 1, 2, 3)
      SELECT p.model_a, p.model_b, round(p.ma, 9) AS auc_a, round(p.mb, 9) AS auc_b, p.n AS n_pos, q.n AS n_neg, round((p.ma - p.mb) / sqrt(p.s / p.n + q.s / q.n), {digits}) AS z
      FROM moments p JOIN moments q ON p.model_a = q.model_a AND p.model_b = q.model_b WHERE p.label = 1 AND q.label = 0"""


def _delong_oracle(src: str, item: str, *ctes: str, digits: int = 6) -> str:
    body = delong_sql(src, item, digits)
    head, _, tail = body.partition("SELECT p.model_a")
    return sql("predictions", "SELECT p.model_a" + tail, *ctes, f"placed AS ({placement_sql(src, 'model')})", head.replace("WITH_PLACED", "").strip())


def _pairs(df: DataFrame, *more: Column | str) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("auc_a", "auc_b")]
    return df.select("model_a", "model_b", *rounded, "n_pos", "n_neg", F.round("z", 6).alias("z"), *more)


@query("h21_delong_frames", _delong_oracle("predictions", "frame_id"))
def h21(v: Views) -> DataFrame:
    return _pairs(significance.delong_pairs(v.predictions()))


_CLIPS = """cp AS (SELECT model, clip_key, round_even(avg(label), 0)::INTEGER AS label, round(avg(prob), 12) AS prob FROM predictions GROUP BY 1, 2)"""


def _clip_scores(v: Views) -> DataFrame:
    p = v.predictions()
    return p.groupBy("model", "clip_key").agg(clips.half_even(F.avg("label")).alias("label"), clips.steady(F.avg("prob")).alias("prob"))


@query("h22_delong_clips", _delong_oracle("cp", "clip_key", _CLIPS))
def h22(v: Views) -> DataFrame:
    return _pairs(significance.delong_pairs(_clip_scores(v), item="clip_key"))


def area_sql(z: str, steps: int = 1000) -> str:
    """Integral of the standard normal density from 0 to z by Simpson's rule."""
    weight = f"(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    height = f"exp(-0.5 * (({z}) * i / {steps}.0::DOUBLE) ** 2)"
    return f"(list_sum(list_transform(range({steps + 1}), lambda i: {weight} * {height})) * ({z}) / ({3 * steps} * sqrt(2 * pi())))"


@query(
    "h22_delong_matrix_p",
    f"""SELECT model_a, model_b, auc_a, auc_b, n_pos, n_neg, round(z, 6) AS z, round(p, 9) AS p_value, p < 0.05 AS significant
        FROM (SELECT *, 1 - 2 * {area_sql('abs(z)')} AS p FROM ({_delong_oracle("cp", "clip_key", _CLIPS, digits=15)}))""",
)
def h22p(v: Views) -> DataFrame:
    """Pairs with p and the significance flag."""
    tests = significance.delong_pairs(_clip_scores(v), item="clip_key")
    return _pairs(tests, F.round("p_value", 9).alias("p_value"), "significant")


@query(
    "d08_model_pairs",
    sql("predictions", """SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_items FROM predictions a JOIN predictions b ON a.frame_id = b.frame_id AND a.model < b.model GROUP BY 1, 2"""),
)
def d08(v: Views) -> DataFrame:
    pairs = significance.delong_pairs(v.predictions())
    return pairs.select("model_a", "model_b", (F.col("n_pos") + F.col("n_neg")).alias("n_items"))


# ---------------------------------------------------------------- rank tests

_SCORES = f"scores AS (SELECT split AS experiment, model, fold, round(auroc, 4) AS value FROM ({auroc_sql('predictions', 'split, model, fold')}))"
_RANKS = """ranks AS (SELECT *, rank() OVER (PARTITION BY experiment, fold ORDER BY value DESC) + (count(*) OVER (PARTITION BY experiment, fold, value) - 1) / 2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY experiment, fold, value) AS t FROM scores)"""


def _scores(v: Views) -> DataFrame:
    area = curves.auroc(v.predictions(), ["split", "model", "fold"])
    return area.select(F.col("split").alias("experiment"), "model", "fold", F.round("auroc", 4).alias("value"))


@query("f04_mean_ranks", sql("predictions", "SELECT experiment, model, round(avg(r), 9) AS mean_rank FROM ranks GROUP BY 1, 2", _SCORES, _RANKS))
def f04(v: Views) -> DataFrame:
    return _rounded(significance.mean_ranks(significance.fold_ranks(_scores(v))), 9)


@query(
    "h23_friedman",
    sql("predictions", """SELECT experiment, k AS n_treatments, n AS n_blocks, round((12.0::DOUBLE / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS statistic FROM (
        SELECT experiment, count(*) AS k, sum(rs * rs) AS ss FROM (SELECT experiment, model, sum(r) AS rs FROM ranks GROUP BY 1, 2) GROUP BY 1) a
        JOIN (SELECT experiment AS e, sum(t * t - 1)::DOUBLE AS ties, count(DISTINCT fold) AS n FROM ranks GROUP BY 1) b ON a.experiment = b.e""", _SCORES, _RANKS),
)
def h23(v: Views) -> DataFrame:
    return _rounded(significance.friedman(_scores(v)).drop("p_value"))


@query(
    "h23_friedman_p",
    sql("predictions", """SELECT experiment, round(exp(-statistic / 2), 6) AS p_value FROM (SELECT experiment, (12.0::DOUBLE / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS statistic FROM (
        SELECT experiment, count(*) AS k, sum(rs * rs) AS ss FROM (SELECT experiment, model, sum(r) AS rs FROM ranks GROUP BY 1, 2) GROUP BY 1) a
        JOIN (SELECT experiment AS e, sum(t * t - 1)::DOUBLE AS ties, count(DISTINCT fold) AS n FROM ranks GROUP BY 1) b ON a.experiment = b.e)""", _SCORES, _RANKS),
)
def h23p(v: Views) -> DataFrame:
    """Three models give two degrees of freedom, for which the tail is exp(-x/2)."""
    return _rounded(significance.friedman(_scores(v)).select("experiment", "p_value"))


@query(
    "h24_nemenyi",
    sql("predictions", """SELECT a.experiment, a.model AS model_a, b.model AS model_b, round(a.m, 6) AS mean_rank_a, round(b.m, 6) AS mean_rank_b, round(abs(a.m - b.m) / sqrt(3 * 4 / (6.0::DOUBLE * a.n)), 6) AS z
        FROM mr a JOIN mr b ON a.experiment = b.experiment AND a.model < b.model""", _SCORES, _RANKS,
        "mr AS (SELECT experiment, model, avg(r) AS m, count(DISTINCT fold) AS n FROM ranks GROUP BY 1, 2)"),
)
def h24(v: Views) -> DataFrame:
    return _rounded(significance.nemenyi(_scores(v)).drop("p_value"))


_Q = "sqrt(2) * z"


@query(
    "h24_nemenyi_p",
    sql("predictions", f"""SELECT experiment, model_a, model_b, round(1 - 3 * list_sum(list_transform(range(481), lambda j:
            exp(-0.5 * (j / 20.0::DOUBLE - 9) ** 2) / sqrt(2 * pi()) * ({area_sql('j / 20.0::DOUBLE - 9', 200)} - {area_sql(f'j / 20.0::DOUBLE - 9 - {_Q}', 200)}) ** 2)) / 20, 6) AS p_value
        FROM (SELECT a.experiment, a.model AS model_a, b.model AS model_b, abs(a.m - b.m) / sqrt(3 * 4 / (6.0::DOUBLE * a.n)) AS z FROM mr a JOIN mr b ON a.experiment = b.experiment AND a.model < b.model)""",
        _SCORES, _RANKS, "mr AS (SELECT experiment, model, avg(r) AS m, count(DISTINCT fold) AS n FROM ranks GROUP BY 1, 2)"),
)
def h24p(v: Views) -> DataFrame:
    """The studentised range of three normals; mean ranks of three models differ by at most two."""
    return _rounded(significance.nemenyi(_scores(v)).select("experiment", "model_a", "model_b", "p_value"))


@query(
    "h25_wilcoxon",
    sql("predictions", """SELECT a.experiment, a.model_a, a.model_b, count(*) FILTER (d <> 0) AS n,
        round(least(coalesce(sum(CASE WHEN d > 0 THEN r END), 0), coalesce(sum(CASE WHEN d < 0 THEN r END), 0)), 6) AS statistic FROM (
          SELECT *, rank() OVER (PARTITION BY experiment, model_a, model_b, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY experiment, model_a, model_b, abs(d)) - 1) / 2.0::DOUBLE AS r FROM (
            SELECT a.experiment, a.model AS model_a, b.model AS model_b, a.value - b.value AS d FROM scores a JOIN scores b ON a.experiment = b.experiment AND a.fold = b.fold AND a.model < b.model)) a GROUP BY 1, 2, 3""", _SCORES),
)
def h25(v: Views) -> DataFrame:
    out = significance.wilcoxon_pairs(_scores(v))
    return out.select("experiment", "model_a", "model_b", F.col("n").cast("bigint").alias("n"), F.round("statistic", 6).alias("statistic"))


_DIFFERENCES = """diffs AS (SELECT a.experiment, a.model AS model_a, b.model AS model_b, a.value - b.value AS d, abs(a.value - b.value) <= 1e-8 + 1e-5 * abs(b.value) AS near
       FROM scores a JOIN scores b ON a.experiment = b.experiment AND a.fold = b.fold AND a.model < b.model),
     ordered AS (SELECT *, count(*) OVER (PARTITION BY experiment, model_a, model_b, abs(d)) AS t, rank() OVER (PARTITION BY experiment, model_a, model_b, d <> 0 ORDER BY abs(d)) AS lowest FROM diffs),
     sums AS (SELECT experiment, model_a, model_b, bool_and(near) AS near, count(*) FILTER (d = 0) AS zeros, count(*) FILTER (d <> 0) AS n, coalesce(sum(t * t - 1) FILTER (d <> 0), 0) AS ties,
       least(coalesce(sum(lowest + (t - 1) / 2.0::DOUBLE) FILTER (d > 0), 0), coalesce(sum(lowest + (t - 1) / 2.0::DOUBLE) FILTER (d < 0), 0)) AS w FROM ordered GROUP BY 1, 2, 3)"""
_SUBSET = "list_sum(list_transform(range(n), lambda b: CASE WHEN (s >> b) % 2 = 1 THEN b + 1 ELSE 0 END))"
_VARIANCE = "(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE)"


@query(
    "h25_wilcoxon_p",
    sql("predictions", f"""SELECT experiment, model_a, model_b, n, round(w, 6) AS statistic, round(p, 9) AS p_value,
          round(least(1.0::DOUBLE, max((m - i + 1) * p) OVER (PARTITION BY experiment ORDER BY i)), 9) AS p_holm,
          round(least(1.0::DOUBLE, min(m / i::DOUBLE * p) OVER (PARTITION BY experiment ORDER BY i DESC)), 9) AS p_bh
        FROM (SELECT *, count(*) OVER (PARTITION BY experiment) AS m, row_number() OVER (PARTITION BY experiment ORDER BY p, model_a, model_b) AS i FROM (
          SELECT *, CASE WHEN near OR n = 0 THEN 1.0::DOUBLE
              WHEN ties = 0 AND zeros = 0 THEN least(1.0::DOUBLE, 2 * list_sum(list_transform(range(1 << n), lambda s: CASE WHEN {_SUBSET} <= w THEN 1 ELSE 0 END)) / (1 << n)::DOUBLE)
              WHEN {_VARIANCE} <= 0 THEN 1.0::DOUBLE
              ELSE 1 - 2 * {area_sql(f'abs(w - n * (n + 1) / 4.0::DOUBLE) / sqrt({_VARIANCE})')} END AS p FROM sums))""", _SCORES, _DIFFERENCES),
)
def h25p(v: Views) -> DataFrame:
    """Exact p, by all subsets of the ranks in SQL, with Holm and Benjamini-Hochberg adjustment."""
    out = significance.wilcoxon_pairs(_scores(v)).withColumn("n", F.col("n").cast("bigint"))
    return _rounded(out, 9).withColumn("statistic", F.round("statistic", 6))
