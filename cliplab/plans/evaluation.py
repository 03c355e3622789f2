"""Queries for clip rules, metrics, curves and thresholds (F1-F2, H1-H19, H26-H33, U2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.operators import clips, curves, metrics, report, resample
from cliplab.operators.bootstrap import metrics_with_ci
from cliplab.operators.ranking import join_on
from cliplab.operators.significance import normal_interval
from cliplab.plans.quality_queries import _rounded
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql

ORDER = ["frame_number", "frame_id"]


# ----------------------------------------------------------------- SQL pieces


def auroc_sql(src: str, groups: str, score: str = "prob") -> str:
    """Rank-sum AUROC per group."""
    return f"""SELECT {groups}, CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) END AS auroc FROM (
      SELECT {groups}, sum(CASE WHEN label = 1 THEN r END) AS rs, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM (
        SELECT {groups}, label, rank() OVER (PARTITION BY {groups} ORDER BY {score}) + (count(*) OVER (PARTITION BY {groups}, {score}) - 1) / 2.0::DOUBLE AS r FROM {src})
      GROUP BY {groups})"""


CELLS = """sum((label = 1 AND pred = 1)::INTEGER)::BIGINT AS tp, sum((label = 0 AND pred = 1)::INTEGER)::BIGINT AS fp,
   sum((label = 1 AND pred = 0)::INTEGER)::BIGINT AS fn, sum((label = 0 AND pred = 0)::INTEGER)::BIGINT AS tn"""
RATES = """round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision",
   round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity,
   round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
   round((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2, 6) AS balanced_accuracy"""


def metrics_sql(src: str, groups: str, score: str = "prob", extra: str = "") -> str:
    """Cells, rates and AUROC of a table (groups, label, pred, score)."""
    on = " AND ".join(f"c.{g.strip()} = a.{g.strip()}" for g in groups.split(","))
    cols = ", ".join(f"c.{g.strip()}" for g in groups.split(","))
    return f"""SELECT {cols}, tp, fp, fn, tn, {RATES}, round(auroc, 6) AS auroc{extra}
      FROM (SELECT {groups}, {CELLS}, count(*) AS n_rows FROM {src} GROUP BY {groups}) c JOIN ({auroc_sql(src, groups, score)}) a ON {on}"""


# ------------------------------------------------------------------ smoothing

_RANKED = """r AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_number, frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n,
     label, score_a AS p, (score_a >= 0.5)::INTEGER AS pred FROM frames)"""
_MOVING = """ma AS (SELECT a.video_id, a.i, a.n, CASE WHEN a.n <= 1 THEN any_value(a.p) ELSE sum(b.p) / greatest(1, a.n // 5) END AS smoothed FROM r a JOIN r b ON a.video_id = b.video_id
     AND b.i BETWEEN a.i - greatest(1, a.n // 5) // 2 AND a.i + (greatest(1, a.n // 5) - 1) // 2 GROUP BY a.video_id, a.i, a.n)"""
_GAUSS = """kern AS (SELECT n, x, exp(-0.5::DOUBLE * ((x - (n - 1) / 2.0::DOUBLE) / greatest(1.0::DOUBLE, n / 6.0::DOUBLE)) ** 2) AS k FROM (SELECT n, unnest(range(0, n)) AS x FROM (SELECT DISTINCT n FROM r))),
     kn AS (SELECT n, x, k / sum(k) OVER (PARTITION BY n) AS k FROM kern),
     ga AS (SELECT a.video_id, a.i, a.n, CASE WHEN a.n <= 1 THEN any_value(a.p) ELSE sum(b.p * kn.k) END AS smoothed FROM r a JOIN r b ON a.video_id = b.video_id
            JOIN kn ON kn.n = a.n AND kn.x = (a.n - 1) // 2 + a.i - b.i GROUP BY a.video_id, a.i, a.n)"""


@query("f01_moving_average", sql("frames", "SELECT video_id, i AS position, n AS n_frames, round(smoothed, 9) AS smoothed FROM ma", _RANKED, _MOVING))
def f01(v: Views) -> DataFrame:
    out = clips.smoothed_frames(v.frames(), ["video_id"], ORDER, "moving_avg", "score_a")
    return out.withColumn("smoothed", F.round("smoothed", 9))


@query("f01_moving_average_long_clips", sql("frames", "SELECT video_id, i AS position, n AS n_frames, round(smoothed, 9) AS smoothed FROM ma", _RANKED, _MOVING))
def f01_long(v: Views) -> DataFrame:
    """Every clip above 16 frames through the running-sum path for long clips."""
    out = clips.smoothed_frames(v.frames(), ["video_id"], ORDER, "moving_avg", "score_a", array_limit=16)
    return out.withColumn("smoothed", F.round("smoothed", 9))


@query("f02_gaussian_smoothing", sql("frames", "SELECT video_id, i AS position, n AS n_frames, round(smoothed, 9) AS smoothed FROM ga", _RANKED, _GAUSS))
def f02(v: Views) -> DataFrame:
    out = clips.smoothed_frames(v.frames(), ["video_id"], ORDER, "gaussian", "score_a")
    return out.withColumn("smoothed", F.round("smoothed", 9))


@query("f02_gaussian_long_clips", sql("frames", "SELECT video_id, i AS position, n AS n_frames, round(smoothed, 9) AS smoothed FROM ga", _RANKED, _GAUSS))
def f02_long(v: Views) -> DataFrame:
    """Every clip above 16 frames through the sine / cosine running sums for long clips."""
    out = clips.smoothed_frames(v.frames(), ["video_id"], ORDER, "gaussian", "score_a", array_limit=16)
    return out.withColumn("smoothed", F.round("smoothed", 9))


# --------------------------------------------------------------- clip rules

_CLIP_BASE = """base AS (SELECT video_id, count(*) AS n_frames, round_even(avg(label), 0)::INTEGER AS label, round(avg(p), 12) AS mean_prob, round(avg(pred), 12) AS vote_share,
     CASE WHEN sum(abs(p - 0.5) * 2) > 1e-9 THEN round(sum(p * abs(p - 0.5) * 2) / sum(abs(p - 0.5) * 2), 12) ELSE round(avg(p), 12) END AS conf_score FROM r GROUP BY 1)"""


def _topk_cte(src: str, name: str) -> str:
    per = ", ".join(
        f"round(sum(CASE WHEN rn <= greatest(1, ceil(n * {q}::DOUBLE)) THEN smoothed END) / max(greatest(1, ceil(n * {q}::DOUBLE))), 12) AS t{i}"
        for i, q in enumerate(clips.TOPK_RATIOS)
    )
    return f"{name} AS (SELECT video_id, {per} FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY smoothed DESC) AS rn FROM {src}) GROUP BY 1)"


def _decisions_sql() -> str:
    rows = ["SELECT 'majority_vote' AS method, video_id, label, mean_prob AS score, (round_even(vote_share, 0) = 1)::INTEGER AS pred, n_frames FROM base"]
    for t in clips.DECISION_THRESHOLDS:
        rows.append(f"SELECT 'mean_prob-{t}', video_id, label, mean_prob, (mean_prob >= {t}::DOUBLE)::INTEGER, n_frames FROM base")
        rows.append(f"SELECT 'threshold_ratio-{t}', video_id, label, mean_prob, (vote_share >= {t}::DOUBLE)::INTEGER, n_frames FROM base")
        rows.append(f"SELECT 'conf_weighted-{t}', video_id, label, conf_score, (conf_score >= {t}::DOUBLE)::INTEGER, n_frames FROM base")
    for i, q in enumerate(clips.TOPK_RATIOS):
        for base, cte in (("moving_avg_topk", "mk"), ("gaussian_topk", "gk")):
            rows.append(f"SELECT '{base}-{q}', b.video_id, label, t{i}, (t{i} >= 0.5)::INTEGER, n_frames FROM base b JOIN {cte} k ON b.video_id = k.video_id")
    return "decisions AS (" + "\n UNION ALL ".join(rows) + ")"


_DECISIONS = (_RANKED, _MOVING, _GAUSS, _CLIP_BASE, _topk_cte("ma", "mk"), _topk_cte("ga", "gk"), _decisions_sql())


def _frame_votes(v: Views) -> DataFrame:
    return v.frames().withColumn("pred", (F.col("score_a") >= 0.5).cast("int"))


def _decided(v: Views, methods=None) -> DataFrame:
    return clips.decide(_frame_votes(v), ["video_id"], methods, ORDER, prob="score_a")


def _rule_query(name: str, base: str, methods: list[str]) -> None:
    body = f"SELECT method, video_id, label, round(score, 9) AS score, pred, n_frames FROM decisions WHERE starts_with(method, '{base}')"

    @query(name, sql("frames", body, *_DECISIONS))
    def plan(v: Views) -> DataFrame:
        return _decided(v, methods).withColumn("score", F.round("score", 9))


_rule_query("h13_majority_vote", "majority_vote", ["majority_vote"])
_rule_query("h14_mean_prob", "mean_prob", [f"mean_prob-{t}" for t in clips.DECISION_THRESHOLDS])
_rule_query("h15_threshold_ratio", "threshold_ratio", [f"threshold_ratio-{t}" for t in clips.DECISION_THRESHOLDS])
_rule_query("h16_conf_weighted", "conf_weighted", [f"conf_weighted-{t}" for t in clips.DECISION_THRESHOLDS])
_rule_query("h17_moving_avg_topk", "moving_avg_topk", [f"moving_avg_topk-{r}" for r in clips.TOPK_RATIOS])
_rule_query("h18_gaussian_topk", "gaussian_topk", [f"gaussian_topk-{r}" for r in clips.TOPK_RATIOS])


@query(
    "h19_compare_methods",
    sql("frames", f"""SELECT method, f1, auroc, sensitivity, specificity, "precision", sensitivity AS recall, n_rows AS n_clips
        FROM ({metrics_sql('decisions', 'method', 'score', ', n_rows')})""", *_DECISIONS),
)
def h19(v: Views) -> DataFrame:
    """All 22 rules scored in one grouped pass."""
    table = metrics.binary_metrics(_decided(v), ["method"], score="score")
    n_clips = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = table.withColumns({"n_clips": n_clips, "recall": F.col("sensitivity")})
    return _rounded(out.select("method", "f1", "auroc", "sensitivity", "specificity", "precision", "recall", "n_clips"))


@query(
    "h19_ranked_methods",
    sql("frames", f"""SELECT row_number() OVER (ORDER BY round(f1, 9) DESC, method)::INTEGER AS rank, method, round(f1, 6) AS f1, auroc, sensitivity, specificity,
        "precision", sensitivity AS recall, n_rows AS n_clips, true AS f1_covered, true AS auroc_covered, true AS f1_width_agrees
        FROM (SELECT * REPLACE (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1) FROM ({metrics_sql('decisions', 'method', 'score', ', n_rows')}))""", *_DECISIONS),
)
def h19_ranked(v: Views) -> DataFrame:
    """The ranked table with intervals of 10,000 shared draws.

    Bounds hold the point value; the width of F1's interval is that of its delta-method error, within 20 %.
    """
    frames = _frame_votes(v)
    table = report.compare_methods(frames, ["video_id"], order=ORDER, prob="score_a")
    tp, errors = F.col("tp").cast("double"), (F.col("fp") + F.col("fn")).cast("double")
    # F1 does not change with the number of clips, so its cells may be taken as independent counts
    error = 1.96 * F.sqrt(4 * tp * errors * (tp + errors)) / F.pow(2 * tp + errors, 2)
    off = F.abs((F.col("f1_upper") - F.col("f1_lower")) / 2 - error)
    return _rounded(table.select(
        "rank", "method", "f1", "auroc", "sensitivity", "specificity", "precision", "recall", "n_clips",
        F.col("f1").between(F.col("f1_lower"), F.col("f1_upper")).alias("f1_covered"),
        F.col("auroc").between(F.col("auroc_lower") - 0.0005, F.col("auroc_upper") + 0.0005).alias("auroc_covered"),
        (off <= 0.2 * error).alias("f1_width_agrees"),
    ))


@query("h19_compare_methods_ci")
def h19_ci(v: Views) -> DataFrame:
    """Bounds of F1 and AUROC for all 22 rules (random draws: checked in the tests)."""
    table = report.compare_methods(_frame_votes(v), ["video_id"], order=ORDER, prob="score_a")
    return table.select("method", "f1_lower", "f1_upper", "auroc_lower", "auroc_upper")


_CLIP_PRED = """clip_pred AS (SELECT model, clip_key, label, prob, (prob >= 0.5)::INTEGER AS pred FROM (
     SELECT model, clip_key, round_even(avg(label), 0)::INTEGER AS label, round(avg(prob), 12) AS prob FROM predictions GROUP BY 1, 2))"""


@query("h14_mean_prob_metrics", sql("predictions", metrics_sql("clip_pred", "model"), _CLIP_PRED))
def flagship(v: Views) -> DataFrame:
    """Frames -> clips by mean probability >= 0.5 -> cells, rates and AUROC per model."""
    scored = v.predictions().groupBy("model", "clip_key").agg(
        clips.half_even(F.avg("label")).alias("label"), clips.steady(F.avg("prob")).alias("prob")
    )
    return _rounded(metrics.binary_metrics(metrics.at_threshold(scored, 0.5), ["model"]))


# ------------------------------------------------------------------- metrics

_PRED = "p AS (SELECT *, (prob >= 0.5)::INTEGER AS pred FROM predictions)"


@query(
    "h01_confusion_matrix",
    sql("predictions", """SELECT g.model, g.label, g.pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / coalesce(nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.model, g.label), 0), 1)::DOUBLE, 6) AS row_share
        FROM (SELECT DISTINCT model, a.label, b.pred FROM predictions, (VALUES (0), (1), (2)) a(label), (VALUES (0), (1), (2)) b(pred)) g
        LEFT JOIN (SELECT model, label, pred, count(*) AS n FROM p GROUP BY 1, 2, 3) c ON g.model = c.model AND g.label = c.label AND g.pred = c.pred""", _PRED),
)
def h01(v: Views) -> DataFrame:
    p = metrics.at_threshold(v.predictions(), 0.5)
    return _rounded(metrics.confusion_matrix(p, [0, 1, 2], ["model"]))


@query("h02_binary_metrics", sql("predictions", metrics_sql("p", "model, fold"), _PRED))
def h02(v: Views) -> DataFrame:
    return _rounded(metrics.binary_metrics(metrics.at_threshold(v.predictions(), 0.5), ["model", "fold"]))


_CLASSES = "k AS (SELECT l_linenumber % 3 AS label, (l_quantity * 7 + l_partkey)::BIGINT % 3 AS pred, l_returnflag AS model FROM lineitem)"
_REPORT = """SELECT c.model, c.class_id, round(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(hits / nullif(support, 0)::DOUBLE, 0), 6) AS recall,
     round(coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0), 6) AS f1, support, predicted FROM (
       SELECT model, c AS class_id, sum((label = c)::INTEGER)::BIGINT AS support, sum((pred = c)::INTEGER)::BIGINT AS predicted, sum((label = c AND pred = c)::INTEGER)::BIGINT AS hits
       FROM k, (VALUES (0), (1), (2)) t(c) GROUP BY 1, 2) c"""


def _class_rows(v: Views) -> DataFrame:
    return v.table("lineitem").select(
        (F.col("l_linenumber") % 3).alias("label"),
        ((F.col("l_quantity") * 7 + F.col("l_partkey")).cast("bigint") % 3).cast("int").alias("pred"),
        F.col("l_returnflag").alias("model"),
    )


@query("h03_class_report", f"WITH {_CLASSES} {_REPORT}")
def h03(v: Views) -> DataFrame:
    return _rounded(metrics.class_report(_class_rows(v), [0, 1, 2], ["model"]))


@query(
    "h03_macro_metrics",
    f"""WITH {_CLASSES}, rep AS ({_REPORT.replace(', 6)', ', 12)')})
        SELECT model, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS balanced_accuracy, sum(support)::BIGINT AS support FROM rep GROUP BY 1""",
)
def h03b(v: Views) -> DataFrame:
    return _rounded(metrics.macro_metrics(metrics.class_report(_class_rows(v), [0, 1, 2], ["model"]), ["model"]))


@query("h04_auroc", sql("predictions", f"SELECT model, fold, round(auroc, 9) AS auroc FROM ({auroc_sql('predictions', 'model, fold')})"))
def h04(v: Views) -> DataFrame:
    return _rounded(curves.auroc(v.predictions(), ["model", "fold"]), 9)


_MULTI = """m AS (SELECT vec_id, vec_id % 4 AS grp, CASE vec_id % 4 WHEN 0 THEN label % 5 WHEN 1 THEN (label % 3) * 2 WHEN 2 THEN 1 + (label % 2) * 2 ELSE 3 END AS label,
       list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS probs FROM embeddings)"""


@query(
    "h05_auroc_multiclass",
    f"""WITH {_MULTI}, present AS (SELECT grp, count(DISTINCT label) AS n_classes FROM m GROUP BY 1),
        long AS (SELECT vec_id, m.grp, label AS y, c.class_id, probs[c.class_id + 1] AS p FROM m JOIN (SELECT DISTINCT grp, label AS class_id FROM m) c ON m.grp = c.grp),
        scaled AS (SELECT grp, class_id, (y = class_id)::INTEGER AS label, p / CASE WHEN sum(p) OVER (PARTITION BY vec_id) <= 0 THEN 1 ELSE sum(p) OVER (PARTITION BY vec_id) END AS prob FROM long),
        a AS ({auroc_sql('scaled', 'grp, class_id')})
        SELECT p.grp, any_value(n_classes)::INTEGER AS n_classes, round(CASE WHEN any_value(n_classes) > 2 THEN avg(auroc) WHEN any_value(n_classes) = 2 THEN arg_max(auroc, class_id) END, 6) AS auroc
        FROM present p LEFT JOIN a ON p.grp = a.grp GROUP BY 1""",
)
def h05(v: Views) -> DataFrame:
    g = F.col("vec_id") % 4
    label = (
        F.when(g == 0, F.col("label") % 5).when(g == 1, (F.col("label") % 3) * 2).when(g == 2, 1 + (F.col("label") % 2) * 2).otherwise(3)
    )
    probs = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = v.table("embeddings").select(g.alias("grp"), label.alias("label"), probs.alias("probs"))
    return _rounded(curves.auroc_multiclass(rows, ["grp"]))


@query(
    "h06_roc_points",
    sql("predictions", """SELECT model, threshold, tp, fp, round(tp / p::DOUBLE, 6) AS tpr, round(fp / n::DOUBLE, 6) AS fpr FROM (
        SELECT model, prob AS threshold, (sum(sum(label)) OVER w)::BIGINT AS tp, (sum(sum(1 - label)) OVER w)::BIGINT AS fp,
               sum(sum(label)) OVER (PARTITION BY model) AS p, sum(sum(1 - label)) OVER (PARTITION BY model) AS n
        FROM predictions GROUP BY model, prob WINDOW w AS (PARTITION BY model ORDER BY prob DESC))"""),
)
def h06(v: Views) -> DataFrame:
    return curves.roc_points(v.predictions(), ["model"]).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


@query(
    "h06_nearest_roc_point",
    sql("predictions", """SELECT model, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(threshold - 0.333::DOUBLE), threshold DESC) AS rn FROM (
          SELECT model, prob AS threshold, (sum(sum(label)) OVER w) / sum(sum(label)) OVER (PARTITION BY model)::DOUBLE AS tpr,
                 (sum(sum(1 - label)) OVER w) / sum(sum(1 - label)) OVER (PARTITION BY model)::DOUBLE AS fpr
          FROM predictions GROUP BY model, prob WINDOW w AS (PARTITION BY model ORDER BY prob DESC))) WHERE rn = 1"""),
)
def h06b(v: Views) -> DataFrame:
    return _rounded(curves.nearest_roc_point(curves.roc_points(v.predictions(), ["model"]), ["model"], 0.333))


def sweep_sql(src: str, groups: str, grid: list[float]) -> str:
    values = ", ".join(f"({t!r}::DOUBLE)" for t in grid)
    return f"""SELECT {groups}, t AS threshold, {CELLS} FROM (SELECT {groups}, t, label, (prob >= t)::INTEGER AS pred FROM {src}, (VALUES {values}) g(t)) GROUP BY {groups}, t"""


@query(
    "h07_threshold_sweep",
    sql("predictions", f"""SELECT c.model, round(threshold, 6) AS threshold, tp, fp, fn, tn, {RATES}, round(auroc, 6) AS auroc
        FROM ({sweep_sql('predictions', 'model', curves.sweep_grid())}) c JOIN ({auroc_sql('predictions', 'model')}) a ON c.model = a.model"""),
)
def h07(v: Views) -> DataFrame:
    return _rounded(metrics.sweep_thresholds(v.predictions(), ["model"]))


_SWEEP_MF = f"sweep AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM ({sweep_sql('predictions', 'model, fold', curves.sweep_grid())}))"
_BEST_MF = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY f1 DESC, threshold) AS rn FROM sweep) WHERE rn = 1)"


@query(
    "h08_best_threshold",
    sql("predictions", "SELECT model, fold, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best", _SWEEP_MF, _BEST_MF),
)
def h08(v: Views) -> DataFrame:
    sweep = metrics.sweep_thresholds(v.predictions(), ["model", "fold"], with_auroc=False)
    return _rounded(metrics.best_threshold(sweep, ["model", "fold"]).select("model", "fold", "threshold", "f1"))


@query(
    "h08_tuned_threshold",
    sql("predictions", f"""SELECT model, round(threshold, 9) AS threshold, round(s, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, threshold) AS rn FROM (
          SELECT *, (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2 AS s FROM ({sweep_sql('predictions', 'model', curves.linspace(0.05, 0.95, 50))}))) WHERE rn = 1"""),
)
def h08b(v: Views) -> DataFrame:
    out = metrics.tune_threshold(v.predictions(), ["model"], metric="balanced_accuracy")
    return out.select("model", F.round("threshold", 9).alias("threshold"), F.round("score", 6).alias("score"))


@query(
    "h12_clip_metrics",
    sql("predictions", metrics_sql("c12", "model"), """c12 AS (SELECT *, (prob >= 0.45)::INTEGER AS pred FROM (
        SELECT model, clip_key, max(label) AS label, round(avg(prob), 12) AS prob FROM predictions GROUP BY 1, 2))"""),
)
def h12(v: Views) -> DataFrame:
    """Clip label = maximum, clip score = mean, decided at 0.45."""
    scored = clips.clip_scores(v.predictions(), ["model", "clip_key"], lambda c: clips.steady(F.avg(c)))
    return _rounded(metrics.binary_metrics(metrics.at_threshold(scored, 0.45), ["model"]))


@query(
    "u02_custom_clip_aggregate",
    sql("predictions", metrics_sql("c", "model"), """c AS (SELECT *, (prob >= 0.9)::INTEGER AS pred FROM (
        SELECT model, clip_key, max(label) AS label, max(prob) AS prob FROM predictions GROUP BY 1, 2))"""),
)
def u02(v: Views) -> DataFrame:
    """A caller's clip aggregate (maximum) as a column expression."""
    scored = clips.clip_scores(v.predictions(), ["model", "clip_key"], F.max)
    return _rounded(metrics.binary_metrics(metrics.at_threshold(scored, 0.9), ["model"]))


_HELD = """clip_scores AS (SELECT p.model, p.fold, p.clip_key, round(avg(prob), 12) AS prob FROM predictions p GROUP BY 1, 2, 3),
  clip_labels AS (SELECT clip_key, (avg(label) > 0.5)::INTEGER AS label FROM frames GROUP BY 1),
  held AS (SELECT s.model, s.fold, s.prob, l.label, (s.prob >= round(b.threshold, 6))::INTEGER AS pred FROM clip_scores s JOIN clip_labels l ON s.clip_key = l.clip_key
           JOIN best b ON s.model = b.model AND s.fold = b.fold)"""


def _fold_thresholds(v: Views) -> DataFrame:
    sweep = metrics.sweep_thresholds(v.predictions(), ["model", "fold"], with_auroc=False)
    return metrics.best_threshold(sweep, ["model", "fold"]).select("model", "fold", "threshold")


_HELD_SQL = metrics_sql("held", "model, fold", extra=", n_rows")


@query(
    "h26_heldout_fold_metrics",
    sql("predictions", f'SELECT model, fold, auroc, accuracy, f1, "precision", sensitivity, specificity, n_rows AS n_clips FROM ({_HELD_SQL})', _SWEEP_MF, _BEST_MF, _HELD),
)
def h26(v: Views) -> DataFrame:
    return _rounded(report.heldout_clip_metrics(v.predictions(), v.frames(), _fold_thresholds(v)))


@query(
    "h26_heldout_summary",
    sql("predictions", f"""SELECT model, metric, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, count(*) AS n_folds FROM (
        SELECT model, unnest(['auroc', 'accuracy', 'f1', 'specificity']) AS metric, unnest([auroc, accuracy, f1, specificity]) AS x FROM ({_HELD_SQL.replace(', 6)', ', 12)')})) GROUP BY 1, 2""", _SWEEP_MF, _BEST_MF, _HELD),
)
def h26b(v: Views) -> DataFrame:
    folds = report.heldout_clip_metrics(v.predictions(), v.frames(), _fold_thresholds(v))
    table = report.cv_summary(folds, ["model"], ["auroc", "accuracy", "f1", "specificity"])
    return _rounded(table.select("model", "metric", "mean", "std", "n_folds"))


@query("h27_best_fold_clip_ci")
def h27(v: Views) -> DataFrame:
    """Bootstrap intervals of clip metrics of the fold with the best AUROC (random draws)."""
    p = v.predictions()
    folds = join_on(curves.auroc(p, ["model", "fold"]), _fold_thresholds(v), ["model", "fold"])
    return report.best_fold_clip_ci(p, v.frames(), folds)


@query(
    "f08_best_fold",
    sql("predictions", f"""SELECT a.model, a.fold, round(auroc, 9) AS auroc, round(threshold, 6) AS threshold FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY coalesce(auroc, -1) DESC, fold) AS rn FROM ({auroc_sql('predictions', 'model, fold')})) a
        JOIN best b ON a.model = b.model AND a.fold = b.fold WHERE a.rn = 1""", _SWEEP_MF, _BEST_MF),
)
def f08(v: Views) -> DataFrame:
    folds = join_on(curves.auroc(v.predictions(), ["model", "fold"]), _fold_thresholds(v), ["model", "fold"])
    best = report.best_fold(folds)
    return best.select("model", "fold", F.round("auroc", 9).alias("auroc"), "threshold")


@query(
    "h28_fold_validation",
    sql("predictions", f"""SELECT m.model, m.fold, f1 AS val_f1, "precision" AS val_precision, sensitivity AS val_recall, auroc AS val_auroc, round(b.threshold, 6) AS optimal_threshold,
        round(b.f1b, 6) AS tuned_f1, round(coalesce(b.tp / nullif(b.tp + b.fp, 0)::DOUBLE, 0), 6) AS tuned_precision, round(coalesce(b.tp / nullif(b.tp + b.fn, 0)::DOUBLE, 0), 6) AS tuned_recall
        FROM ({metrics_sql('p', 'model, fold')}) m JOIN (SELECT model, fold, threshold, f1 AS f1b, tp, fp, fn FROM best) b ON m.model = b.model AND m.fold = b.fold""", _PRED, _SWEEP_MF, _BEST_MF),
)
def h28(v: Views) -> DataFrame:
    return _rounded(metrics.fold_validation(v.predictions()))


@query(
    "h29_clip_threshold",
    sql("predictions", f"""SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn FROM (
        SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM ({sweep_sql('vc', 'model', curves.sweep_grid())}))) WHERE rn = 1""",
        "vc AS (SELECT model, round(avg(prob), 12) AS prob, round_even(avg(label), 0)::INTEGER AS label FROM predictions WHERE split = 'val' GROUP BY model, clip_key)"),
)
def h29(v: Views) -> DataFrame:
    val = v.predictions().filter(F.col("split") == "val")
    scored = val.groupBy("model", "clip_key").agg(clips.steady(F.avg("prob")).alias("prob"), clips.half_even(F.avg("label")).alias("label"))
    best = metrics.best_threshold(metrics.sweep_thresholds(scored, ["model"], with_auroc=False), ["model"])
    return _rounded(best.select("model", "threshold", "f1"))


@query(
    "h30_f1_fixed_and_tuned",
    sql("predictions", """SELECT f.model, round(f.f1, 6) AS f1_at_05, round(t.f1, 6) AS f1_tuned FROM
        (SELECT model, 2 * sum((label = 1 AND prob >= 0.5)::INTEGER) / (sum((prob >= 0.5)::INTEGER) + sum(label))::DOUBLE AS f1 FROM predictions GROUP BY 1) f JOIN
        (SELECT model, 2 * sum((label = 1 AND prob >= 0.35)::INTEGER) / (sum((prob >= 0.35)::INTEGER) + sum(label))::DOUBLE AS f1 FROM predictions GROUP BY 1) t ON f.model = t.model"""),
)
def h30(v: Views) -> DataFrame:
    """Both thresholds in one pass over the rows."""
    cells = curves.threshold_cells(v.predictions(), ["model"], [0.35, 0.5]).withColumns(metrics.cell_metrics())
    at = lambda t: F.max(F.when(F.col("threshold") == t, F.col("f1")))
    return _rounded(cells.groupBy("model").agg(at(0.5).alias("f1_at_05"), at(0.35).alias("f1_tuned")))


@query(
    "h33_all_models",
    sql("predictions", metrics_sql("e", "display_name, level"), """e AS (
        SELECT CASE model WHEN 'forest-allBackbone' THEN 'forest' WHEN 'linear-freezeBackbone' THEN 'linear' ELSE model END AS display_name, 'frame' AS level, label, prob, (prob >= 0.5)::INTEGER AS pred FROM predictions
        UNION ALL SELECT CASE model WHEN 'forest-allBackbone' THEN 'forest' WHEN 'linear-freezeBackbone' THEN 'linear' ELSE model END, 'clip', label, prob, (prob >= 0.5)::INTEGER FROM (
          SELECT model, round_even(avg(label), 0)::INTEGER AS label, round(avg(prob), 12) AS prob FROM predictions GROUP BY model, clip_key))"""),
)
def h33(v: Views) -> DataFrame:
    """Frame and clip level of every model as groups of one plan."""
    p = v.predictions()
    clip = p.groupBy("model", "clip_key").agg(clips.half_even(F.avg("label")).alias("label"), clips.steady(F.avg("prob")).alias("prob"))
    both = p.select("model", F.lit("frame").alias("level"), "label", "prob").unionByName(
        clip.select("model", F.lit("clip").alias("level"), "label", "prob")
    )
    named = report.named_models(metrics.at_threshold(both, 0.5))
    return _rounded(metrics.binary_metrics(named, ["display_name", "level"]))


# ----------------------------------------------------------------- bootstrap


@query("h09_bootstrap_ci")
def h09(v: Views) -> DataFrame:
    """Frame-level intervals of all six metrics per model (random draws: checked in the tests)."""
    return metrics_with_ci(metrics.at_threshold(v.predictions(), 0.5), ["model"])


@query("h10_bootstrap_clip_ci")
def h10(v: Views) -> DataFrame:
    """Clip-level intervals: clip label = maximum, score = mean, threshold 0.5."""
    scored = clips.clip_scores(v.predictions(), ["model", "clip_key"], lambda c: clips.steady(F.avg(c)))
    return metrics_with_ci(metrics.at_threshold(scored, 0.5), ["model"], 10_000)


@query(
    "h11_intervals_against_theory",
    sql("predictions", """SELECT model, metric, round(point, 6) AS point, true AS covered, true AS width_agrees FROM (
        SELECT model, unnest(['accuracy', 'sensitivity', 'specificity', 'precision']) AS metric,
               unnest([(tp + tn) / n, tp / (tp + fn), tn / (tn + fp), tp / (tp + fp)]) AS point FROM (
          SELECT model, count(*)::DOUBLE AS n, sum((label = 1 AND pred = 1)::INTEGER)::DOUBLE AS tp, sum((label = 0 AND pred = 0)::INTEGER)::DOUBLE AS tn,
                 sum((label = 0 AND pred = 1)::INTEGER)::DOUBLE AS fp, sum((label = 1 AND pred = 0)::INTEGER)::DOUBLE AS fn FROM p GROUP BY 1))""", _PRED),
)
def h11(v: Views) -> DataFrame:
    """Bootstrap intervals hold the point value, and their width is that of the binomial error (within 15 %)."""
    decided = metrics.at_threshold(v.predictions(), 0.5)
    ci = metrics_with_ci(decided, ["model"], 2000)
    cells = metrics.binary_metrics(decided, ["model"], score=None)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    trials = {"accuracy": tp + fp + fn + tn, "sensitivity": tp + fn, "specificity": tn + fp, "precision": tp + fp}
    point = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point"), n.alias("n")) for m, n in trials.items()])
    points = cells.select("model", F.explode(point).alias("p")).select("model", "p.*")
    both = join_on(points, ci, ["model", "metric"])
    theory = 1.96 * F.sqrt(F.col("point") * (1 - F.col("point")) / F.col("n"))
    # interval ends are rounded to three digits
    off = F.abs((F.col("upper") - F.col("lower")) / 2 - theory)
    return both.select(
        "model", "metric", F.round("point", 6).alias("point"),
        F.col("point").between(F.col("lower") - 0.0005, F.col("upper") + 0.0005).alias("covered"),
        (off <= 0.15 * theory + 0.0005).alias("width_agrees"),
    )


_CLASSES = 4
_MULTI_PRED = """mc AS (SELECT vec_id % 3 AS grp, label % 4 AS label,
     list_position(list_slice(embedding, 1, 4), list_max(list_slice(embedding, 1, 4))) - 1 AS by_first,
     list_position(list_slice(embedding, 5, 8), list_max(list_slice(embedding, 5, 8))) - 1 AS by_second FROM embeddings),
   rl AS (SELECT grp, 'first' AS rule, label, by_first AS pred FROM mc UNION ALL SELECT grp, 'second', label, by_second FROM mc),
   cl AS (SELECT grp, rule, c, sum((label = c)::INTEGER) AS support, sum((pred = c)::INTEGER) AS predicted, sum((label = c AND pred = c)::INTEGER) AS hits
          FROM rl, range(4) AS r(c) GROUP BY ALL),
   mm AS (SELECT grp, rule, sum(hits) / sum(support)::DOUBLE AS accuracy, avg(coalesce(hits / nullif(support, 0)::DOUBLE, 0)) AS sensitivity,
          avg(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0)) AS "precision", avg(coalesce(2 * hits / nullif(support + predicted, 0)::DOUBLE, 0)) AS f1,
          sum(abs(support - predicted)) / 2.0::DOUBLE / sum(support) AS shifted FROM cl WHERE support + predicted > 0 GROUP BY ALL)"""


@query(
    "u03_callers_metric",
    f"""WITH {_MULTI_PRED} SELECT grp, rule, metric, round(point, 6) AS point, 1000::BIGINT AS n_replicates, true AS ordered, true AS near_point
        FROM mm UNPIVOT (point FOR metric IN (accuracy, sensitivity, "precision", f1, shifted))""",
)
def u03(v: Views) -> DataFrame:
    """Intervals of multiclass decisions by two rules: macro averages, and a metric that only this query knows.

    `shifted` is the share of rows by which the predicted class sizes differ from the true ones.  Its bootstrap mean lies
    above its point value, being a distance; the others lie within half a width of it.
    """
    largest = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    rows = v.table("embeddings").select(
        (F.col("vec_id") % 3).alias("grp"), (F.col("label") % 4).alias("label"),
        largest(F.slice("embedding", 1, 4)).alias("by_first"), largest(F.slice("embedding", 5, 4)).alias("by_second"),
    )

    def shifted(m: resample.Matrix):
        apart = [F.abs(m.support(c) - m.predicted(c)) for c in range(m.classes)]
        return sum(apart[1:], apart[0]) / 2.0 / m.total()

    rules = {"first": F.col("by_first"), "second": F.col("by_second")}
    table = resample.decision_intervals(rows, rules, ["grp"], _CLASSES, metrics=resample.METRICS | {"shifted": shifted})
    half = (F.col("upper") - F.col("lower")) / 2
    near = F.when(F.col("metric") == "shifted", F.col("mean") >= F.col("point") - half).otherwise(F.abs(F.col("mean") - F.col("point")) <= half / 2)
    ordered = (F.col("lower") < F.col("mean")) & (F.col("mean") < F.col("upper"))
    return table.select("grp", "rule", "metric", F.round("point", 6).alias("point"), "n_replicates", ordered.alias("ordered"), near.alias("near_point"))


@query(
    "h31_normal_interval",
    sql("predictions", """SELECT model, round(avg(x), 6) AS mean, round(avg(x) - 1.959963984540054::DOUBLE * stddev_samp(x) / sqrt(count(x)), 6) AS lower,
        round(avg(x) + 1.959963984540054::DOUBLE * stddev_samp(x) / sqrt(count(x)), 6) AS upper FROM (
        SELECT model, patient_id, avg(prob) AS x FROM predictions GROUP BY 1, 2) GROUP BY 1"""),
)
def h31(v: Views) -> DataFrame:
    per_patient = v.predictions().groupBy("model", "patient_id").agg(F.avg("prob").alias("value"))
    return _rounded(normal_interval(per_patient, ["model"]))

