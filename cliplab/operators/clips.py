"""Frame-to-clip aggregation: labels, scores and the 22 decision rules.

Mean-type rules need one grouped pass.  The smoothed top-k rules need the frame
order.  Clips up to `array_limit` frames are convolved as arrays, longer ones
through running sums, with the same result: as arrays too up to `array_frames`,
and row by row beyond (such a clip may hold any share of the data).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplab.operators.ranking import group_rank, join_on, modal_value, range_buckets, running_totals

# Decision thresholds and top-k ratios of the rule set.
DECISION_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
TOPK_RATIOS = (0.2, 0.3, 0.5)
METHOD_BASES = ("majority_vote", "mean_prob", "threshold_ratio", "conf_weighted", "moving_avg_topk", "gaussian_topk")

LABEL_RULES = ("round_mean", "max", "mode")

ARRAY_LIMIT = 512  # longer clips are smoothed by running sums
ARRAY_FRAMES = 4096  # and beyond this length row by row


def all_methods() -> list[str]:
    by_threshold = [f"{base}-{t}" for base in METHOD_BASES[1:4] for t in DECISION_THRESHOLDS]
    by_ratio = [f"{base}-{r}" for base in METHOD_BASES[4:] for r in TOPK_RATIOS]
    return ["majority_vote", *by_threshold, *by_ratio]


def parse_method(method: str) -> tuple[str, float]:
    base, _, param = method.partition("-")
    if base not in METHOD_BASES:
        raise ValueError(f"unknown method {method!r}; bases are {METHOD_BASES}")
    return base, float(param) if param else 0.5


def steady(score: Column) -> Column:
    """Drop float noise of summation order, so that a score on a threshold stays on it."""
    return F.round(score, 12)


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def clip_label(df: DataFrame, keys: Sequence[str], rule: str = "round_mean", label: str = "label") -> DataFrame:
    """(keys, label) by one of three rules: half-even rounded mean, maximum, mode (lowest on ties)."""
    if rule == "mode":
        return modal_value(df, keys, label, "label")
    if rule == "max":
        return df.groupBy(*keys).agg(F.max(label).cast("int").alias("label"))
    if rule == "round_mean":
        return df.groupBy(*keys).agg(half_even(F.avg(label)).alias("label"))
    raise ValueError(f"unknown label rule {rule!r}; choose one of {LABEL_RULES}")


def clip_summary_scores(
    df: DataFrame, keys: Sequence[str], label: str = "label", prob: str = "prob", pred: str = "pred"
) -> DataFrame:
    """One grouped pass: n_frames, label, mean probability, vote share, confidence-weighted score."""
    p = F.col(prob)
    weight = F.abs(p - 0.5) * 2.0
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_frames"),
            half_even(F.avg(label)).alias("label"),
            steady(F.avg(p)).alias("mean_prob"),
            steady(F.avg(F.col(pred))).alias("vote_share"),
            F.sum(p * weight).alias("__pw"),
            F.sum(weight).alias("__w"),
        )
        .withColumn(
            "conf_score",
            F.when(F.col("__w") > 1e-9, steady(F.col("__pw") / F.col("__w"))).otherwise(F.col("mean_prob")),
        )
        .drop("__pw", "__w")
    )


def clip_scores(df: DataFrame, keys: Sequence[str], aggregate, label: str = "label", prob: str = "prob") -> DataFrame:
    """Clip label = max label, clip score from a caller-supplied aggregate (Column -> Column)."""
    return df.groupBy(*keys).agg(F.max(label).cast("int").alias("label"), aggregate(F.col(prob)).alias("prob"))


# ---------------------------------------------------------------- smoothing


def _window_width(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 5)).cast("bigint")


def _moving_average(p: np.ndarray, limit: int) -> np.ndarray:
    """Moving average of one clip; beyond `limit` frames as differences of running sums."""
    n = len(p)
    width = max(1, n // 5)
    if n <= 1:
        return p
    right = (width - 1) // 2
    if n <= limit:
        return np.convolve(p, np.ones(width))[right : right + n] / width
    sums = np.concatenate([[0.0], np.cumsum(p)])
    i = np.arange(n)
    return (sums[np.minimum(n, i + right + 1)] - sums[np.maximum(0, i - width // 2)]) / width


@lru_cache(maxsize=256)
def _kernel(n: int) -> np.ndarray:
    """Normalised, centred at (n-1)/2, sigma = max(1, n/6)."""
    kernel = np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2.0) / max(1.0, n / 6.0)) ** 2)
    return kernel / kernel.sum()


def _gaussian(p: np.ndarray, limit: int) -> np.ndarray:
    """Truncated Gaussian convolution of one clip; beyond `limit` frames by sine / cosine running sums."""
    n, mid = len(p), (len(p) - 1) // 2
    if n <= 1:
        return p
    if n <= limit:
        return np.convolve(p, _kernel(n))[mid : mid + n]
    turn, weights, norm = _waves(n)
    sums = np.cumsum(p * turn, axis=1)
    j = np.arange(n)
    # see _gaussian_rows: the sums up to position j are all that one frame needs
    i = np.where(j >= mid, j - mid, j - mid + n)
    windowed = np.where(j >= mid, sums, sums[:, -1:] - sums)
    out = np.empty(n)
    # exp(-i x) moves the sums to the centre of the kernel
    centre = np.exp(np.outer(np.arange(HARMONICS + 1), -2j * math.pi / PERIOD * (i + mid - (n - 1) / 2.0) / max(1.0, n / 6.0)))
    out[i] = (weights[:, None] * (windowed * centre).real).sum(axis=0) / norm
    return out


@lru_cache(maxsize=16)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(exp(i m x) for every harmonic m and position, weight of each harmonic, sum of the kernel)."""
    m = np.arange(HARMONICS + 1)
    step = 2.0 * math.pi / PERIOD / max(1.0, n / 6.0)
    weights = np.exp(-2.0 * (math.pi * m / PERIOD) ** 2) * np.where(m == 0, 1.0, 2.0)
    norm = (weights[:, None] * np.cos(np.outer(m, step * (np.arange(n) - (n - 1) / 2.0)))).sum()
    return np.exp(1j * np.outer(m, step * np.arange(n))), weights, float(norm)


SMOOTHERS = {"moving_avg": _moving_average, "gaussian": _gaussian}


def _or_null(x: np.ndarray, holes: bool) -> np.ndarray | list[float | None]:
    """A null probability comes as NaN; what it spoils is null again."""
    return [None if math.isnan(v) else v for v in x.tolist()] if holes else x


def _smoothed(kind: str, limit: int):
    """Column function (probabilities, has nulls) -> smoothed probabilities, clip by clip."""
    smooth = SMOOTHERS[kind]

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, holes: pd.Series) -> pd.Series:
        return pd.Series([_or_null(smooth(np.asarray(v, dtype=float), limit), h) for v, h in zip(values, holes, strict=True)], dtype=object)

    return run


def _smoothed_topk(kind: str, limit: int, ratios: Sequence[float]):
    """Column function (probabilities, has nulls) -> mean of the ceil(n*ratio) largest smoothed values, one per ratio."""
    smooth = SMOOTHERS[kind]

    def means(v: np.ndarray, holes: bool) -> np.ndarray | list[float | None]:
        top = np.sort(smooth(np.asarray(v, dtype=float), limit))[::-1]
        if holes:  # nulls come last
            top = np.concatenate([top[~np.isnan(top)], top[np.isnan(top)]])
        sums = np.cumsum(top)
        k = [max(1, math.ceil(len(top) * float(r))) for r in ratios]
        return _or_null(np.array([sums[i - 1] / i for i in k]), holes)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, holes: pd.Series) -> pd.Series:
        return pd.Series([means(v, h) for v, h in zip(values, holes, strict=True)], dtype=object)

    return run


def _as_arrays(df: DataFrame, keys: Sequence[str], order: Sequence[str], prob: str) -> DataFrame:
    """Ordered probabilities `__v` of each clip up to ARRAY_FRAMES frames, and whether one is null."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(prob).cast("double").alias("__p"))))
    arrays = df.groupBy(*keys).agg(packed.alias("__s")).select(
        *keys, F.col("__s.__p").alias("__v"), F.size("__s").cast("bigint").alias("__n")
    )
    return arrays.withColumn("__holes", F.exists("__v", lambda p: p.isNull()))


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], prob: str, span: int) -> DataFrame:
    """Rows of long clips with 0-based position `__i` and clip length `__n`."""
    bucketed = df.withColumn("__b", F.floor(F.col(order[0]) / F.lit(span)))
    ranked = group_rank(bucketed, keys, ["__b"], [F.col(c) for c in order], "__r")
    return ranked.select(
        *keys, (F.col("__r") - 1).alias("__i"), F.col("__r_total").alias("__n"), F.col(prob).cast("double").alias("__p")
    )


POSITION_SPAN = 65536


def _position_sums(ranked: DataFrame, keys: Sequence[str], terms: dict[str, Column]) -> DataFrame:
    bucketed = ranked.withColumn("__pb", F.floor(F.col("__i") / F.lit(POSITION_SPAN)))
    return running_totals(bucketed, keys, ["__pb"], [F.col("__i")], terms)


def _between(sums: DataFrame, keys: Sequence[str], names: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    """Add per row the sum of each term over positions [lo, hi] of its clip (two equi-joins)."""
    base = sums.select(*keys, "__i", "__n", lo.alias("__lo"), hi.alias("__hi"))

    def edge(at: str, tag: str) -> DataFrame:
        return sums.select(*keys, F.col("__i").alias(at), *[F.col(n).alias(f"{n}{tag}") for n in names])

    upper = base.join(edge("__hi", "_u"), [*keys, "__hi"], "left")
    both = upper.withColumn("__lo1", F.col("__lo") - 1).join(edge("__lo1", "_d"), [*keys, "__lo1"], "left")
    return both.select(
        *keys, "__i", "__n", *[(F.col(f"{n}_u") - F.coalesce(F.col(f"{n}_d"), F.lit(0.0))).alias(n) for n in names]
    )


def _moving_average_rows(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = _position_sums(ranked, keys, {"s": F.col("__p")})
    width = _window_width(F.col("__n"))
    lo = F.greatest(F.lit(0), F.col("__i") - F.floor(width / 2))
    hi = F.least(F.col("__n") - 1, F.col("__i") + F.floor((width - 1) / 2))
    out = _between(sums, keys, ["s"], lo, hi)
    return out.select(*keys, "__i", "__n", (F.col("s") / _window_width(F.col("__n"))).alias("smoothed"))


# Poisson summation of the Gaussian with period PERIOD sigmas: on |x| <= 3 sigmas (all a
# length-n kernel can reach) the aliases are below exp(-40), and HARMONICS terms leave an
# error below 1e-16, so the truncated convolution is a sum of windowed sine/cosine sums.
PERIOD = 12.0
HARMONICS = 18


def _gaussian_rows(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row by row, without a join: the kernel is as long as the clip, so the window of frame i is all up to j = i + mid,
    or all beyond j = i + mid - n.  Every j serves one i."""
    n = F.col("__n")
    sigma = F.greatest(F.lit(1.0), n / 6.0)

    def angle(m: int, x: Column) -> Column:
        return F.lit(2.0 * math.pi * m / PERIOD) * x / sigma

    j = F.col("__i").cast("double")
    terms = {"c0": F.col("__p")}
    for m in range(1, HARMONICS + 1):
        terms[f"c{m}"] = F.col("__p") * F.cos(angle(m, j))
        terms[f"s{m}"] = F.col("__p") * F.sin(angle(m, j))
    sums = _position_sums(ranked, keys, terms)
    mid = F.floor((n - 1) / 2)
    low = F.col("__i") >= mid
    windowed = sums.select(
        *keys, "__n", F.when(low, F.col("__i") - mid).otherwise(F.col("__i") - mid + n).alias("__i"),
        *[F.when(low, F.col(t)).otherwise(F.col(f"{t}_total") - F.col(t)).alias(t) for t in terms],
    )

    # kernel argument of (i, j): (mid + i - j) - (n-1)/2
    centre = F.col("__i") + mid - (n - 1) / 2.0
    weights = [math.exp(-2.0 * (math.pi * m / PERIOD) ** 2) for m in range(HARMONICS + 1)]
    value = F.col("c0") * F.lit(weights[0])
    norm = n * F.lit(weights[0])
    for m in range(1, HARMONICS + 1):
        value = value + F.lit(2.0 * weights[m]) * (
            F.cos(angle(m, centre)) * F.col(f"c{m}") + F.sin(angle(m, centre)) * F.col(f"s{m}")
        )
        half = angle(m, F.lit(0.5))
        dirichlet = F.when(F.abs(F.sin(half)) < 1e-12, n * F.cos(half * (n - 1))).otherwise(
            F.sin(half * n) / F.sin(half)
        )
        norm = norm + F.lit(2.0 * weights[m]) * dirichlet
    return windowed.select(*keys, "__i", "__n", (value / norm).alias("smoothed"))


def _topk_mean_rows(rows: DataFrame, keys: Sequence[str], ratios: Sequence[float], value: str, name: str) -> DataFrame:
    """Mean of the ceil(n*ratio) largest values per clip, ranked range by range."""
    bucketed = range_buckets(rows, [*keys, value, "__i"], "__vb")
    ranked = group_rank(bucketed, keys, ["__vb"], [F.col(value).desc(), F.col("__i")], "__vr", bucket_desc=True)

    def mean_at(ratio: float) -> Column:
        k = F.greatest(F.lit(1), F.ceil(F.col("__vr_total") * F.lit(float(ratio))))
        return steady(F.avg(F.when(F.col("__vr") <= k, F.col(value)))).alias(f"{name}-{ratio}")

    return ranked.groupBy(*keys).agg(*[mean_at(r) for r in ratios])


CLIP = "__clip"


def _by_clip(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys as one struct: it is never null itself, and equal where its fields are, nulls included."""
    return df.withColumn(CLIP, F.struct(*keys))


def _spread_clip(df: DataFrame) -> DataFrame:
    return df.select(f"{CLIP}.*", *[f"`{c}`" for c in df.columns if c != CLIP])


def split_by_length(df: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of clips up to `limit` frames, rows of longer clips or None if there are none)."""
    long_keys = df.groupBy(CLIP).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(CLIP)
    if long_keys.isEmpty():
        return df, None
    return df.join(long_keys, CLIP, "left_anti"), df.join(long_keys, CLIP, "left_semi")


def smoothed_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kind: str,
    prob: str = "prob",
    array_limit: int = ARRAY_LIMIT,
    order_span: int = 4096,
    array_frames: int = ARRAY_FRAMES,
) -> DataFrame:
    """(keys, position, n_frames, smoothed) for kind 'moving_avg' or 'gaussian'.

    `order` sorts the frames of a clip; its first column must be numeric, and
    `order_span` of its values form one work unit of a clip beyond `array_frames`.
    """
    short, long = split_by_length(_by_clip(df, keys), max(array_limit, array_frames))
    keys = [CLIP]
    packed = _as_arrays(short, keys, order, prob).withColumn("__v", _smoothed(kind, array_limit)("__v", "__holes"))
    out = packed.select(*keys, "__n", F.posexplode("__v").alias("__i", "smoothed")).select(
        *keys, F.col("__i").cast("bigint").alias("position"), F.col("__n").alias("n_frames"), "smoothed"
    )
    if long is None:
        return _spread_clip(out)
    ranked = _ranked(long, keys, order, prob, order_span)
    rows = _moving_average_rows(ranked, keys) if kind == "moving_avg" else _gaussian_rows(ranked, keys)
    rows = rows.select(*keys, F.col("__i").alias("position"), F.col("__n").alias("n_frames"), "smoothed")
    return _spread_clip(out.unionByName(rows))


def smoothed_topk(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ratios: Sequence[float] = TOPK_RATIOS,
    prob: str = "prob",
    array_limit: int = ARRAY_LIMIT,
    order_span: int = 4096,
    array_frames: int = ARRAY_FRAMES,
) -> DataFrame:
    """(keys, moving_avg_topk-<r>..., gaussian_topk-<r>...) per clip."""
    short, long = split_by_length(_by_clip(df, keys), max(array_limit, array_frames))
    keys = [CLIP]
    packed = _as_arrays(short, keys, order, prob)
    means = packed.withColumns({kind: _smoothed_topk(kind, array_limit, ratios)("__v", "__holes") for kind in SMOOTHERS})
    out = means.select(
        *keys, *[steady(F.col(kind)[i]).alias(f"{kind}_topk-{r}") for kind in SMOOTHERS for i, r in enumerate(ratios)]
    )
    if long is None:
        return _spread_clip(out)
    ranked = _ranked(long, keys, order, prob, order_span)
    ma = _topk_mean_rows(_moving_average_rows(ranked, keys), keys, ratios, "smoothed", "moving_avg_topk")
    ga = _topk_mean_rows(_gaussian_rows(ranked, keys), keys, ratios, "smoothed", "gaussian_topk")
    return _spread_clip(out.unionByName(join_on(ma, ga, keys)))


def topk_mean(
    df: DataFrame, keys: Sequence[str], ratio: float, prob: str = "prob", name: str = "topk_mean"
) -> DataFrame:
    """Mean of the k = max(1, ceil(n * ratio)) highest probabilities per clip.

    Equal probabilities are combined first, so the ranking works on distinct scores.
    """
    hist = df.groupBy(*keys, F.col(prob).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    hist = range_buckets(hist, [*keys, "__v"])
    cum = running_totals(hist, keys, ["__b"], [F.col("__v").desc()], {"__r": F.col("__c")}, bucket_desc=True)
    k = F.greatest(F.lit(1), F.ceil(F.col("__r_total") * F.lit(float(ratio))))
    taken = F.greatest(F.lit(0), F.least(F.col("__c"), k - (F.col("__r") - F.col("__c"))))
    return cum.groupBy(*keys).agg(
        F.max("__r_total").alias("n_frames"),
        F.max(k).alias("k"),
        steady(F.sum(taken * F.col("__v")) / F.sum(taken)).alias(name),
    )


# ---------------------------------------------------------------- decisions


def clip_decisions(
    df: DataFrame,
    keys: Sequence[str],
    methods: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    label: str = "label",
    prob: str = "prob",
    pred: str = "pred",
    array_limit: int = ARRAY_LIMIT,
) -> DataFrame:
    """(keys, label, n_frames, rules, scores), one row per clip.

    rules: (method, score, pred) of every rule, in the order of `methods`; scores: (kind, score) of the distinct
    scores that the rules decide on (see `score_kind`).  Top-k rules always decide at 0.5; their parameter is the
    share of frames.
    """
    methods = list(methods) if methods is not None else all_methods()
    parsed = [(m, *parse_method(m)) for m in methods]
    clips = clip_summary_scores(df, keys, label, prob, pred)
    ratios = sorted({p for _, b, p in parsed if b.endswith("_topk")})
    if ratios:
        if not order:
            raise ValueError("top-k rules need the frame order")
        clips = join_on(clips, smoothed_topk(df, keys, order, ratios, prob, array_limit), keys)

    def row(method: str, base: str, param: float) -> Column:
        score = F.col(f"`{score_kind(method)}`")
        if base == "majority_vote":
            positive = half_even(F.col("vote_share")) == 1
        elif base == "threshold_ratio":
            positive = F.col("vote_share") >= param
        else:
            positive = score >= (0.5 if base.endswith("_topk") else param)
        return F.struct(F.lit(method).alias("method"), score.alias("score"), positive.cast("int").alias("pred"))

    kinds = list(dict.fromkeys(score_kind(m) for m in methods))
    scores = [F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("score")) for k in kinds]
    return clips.select(*keys, "label", "n_frames", F.array(*[row(*p) for p in parsed]).alias("rules"), F.array(*scores).alias("scores"))


def score_kind(method: str) -> str:
    """The score that a rule decides on; many rules share one."""
    base, param = parse_method(method)
    if base.endswith("_topk"):
        return f"{base}-{param}"
    return "conf_score" if base == "conf_weighted" else "mean_prob"


def decide(
    df: DataFrame,
    keys: Sequence[str],
    methods: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    label: str = "label",
    prob: str = "prob",
    pred: str = "pred",
    array_limit: int = ARRAY_LIMIT,
) -> DataFrame:
    """Long table (method, keys, label, score, pred, n_frames): one row per rule and clip; see `clip_decisions`."""
    clips = clip_decisions(df, keys, methods, order, label, prob, pred, array_limit)
    long = clips.select(*keys, "label", "n_frames", F.explode("rules").alias("__m"))
    return long.select("__m.method", *keys, "label", "__m.score", "__m.pred", "n_frames")


def multiclass_clips(df: DataFrame, keys: Sequence[str], label: str = "label", probs: str = "probs") -> DataFrame:
    """Mean probability vector per clip -> argmax (lowest class on ties) beside the modal label."""
    long = df.select(*keys, F.posexplode(probs).alias("class_id", "__p"))
    means = long.groupBy(*keys, "class_id").agg(steady(F.avg("__p")).alias("mean_prob"))
    picked = means.groupBy(*keys).agg(
        F.max_by("class_id", F.struct(F.col("mean_prob"), -F.col("class_id"))).alias("pred"),
        F.max("mean_prob").alias("top_prob"),
    )
    return join_on(picked, modal_value(df, keys, label, "label"), keys)
