"""Queries for splits, folds and subsets (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.functions import parse
from cliplab.operators import splits
from cliplab.operators.ranking import join_by_entity
from cliplab.plans.quality_queries import RATIO_BIN
from cliplab.plans.registry import query
from cliplab.plans.views import Views, sql


def quota_sql(counts: str) -> tuple[str, ...]:
    """Common table expressions for split quotas (0.70 / 0.15 / 0.15, rare below 8) over counts(stratum, n)."""
    return (
        f"""rare AS (SELECT stratum, n, true AS rare,
              CASE WHEN n >= 3 THEN greatest(0, va - greatest(0, 1 - (n - te - va))) ELSE 0 END AS n_val, CASE WHEN n >= 3 THEN te ELSE 1 END AS n_test
            FROM (SELECT *, greatest(1, round_even(n * 0.15::DOUBLE, 0))::BIGINT AS te, greatest(1, round_even(n * 0.15::DOUBLE, 0))::BIGINT AS va FROM {counts} WHERE n < 8))""",
        f"""common AS (SELECT *, ceil(sum(n) OVER () * 0.3::DOUBLE - 1e-9::DOUBLE)::BIGINT AS hold_total, n * ceil(sum(n) OVER () * 0.3::DOUBLE - 1e-9::DOUBLE) / sum(n) OVER ()::DOUBLE AS x FROM {counts} WHERE n >= 8)""",
        """held AS (SELECT *, f + (row_number() OVER (ORDER BY round(x - f, 9) DESC, stratum) <= hold_total - sum(f) OVER ())::INTEGER AS hold
            FROM (SELECT *, floor(x + 1e-9::DOUBLE)::BIGINT AS f FROM common))""",
        """tested AS (SELECT *, f2 + (row_number() OVER (ORDER BY round(x2 - f2, 9) DESC, stratum) <= test_total - sum(f2) OVER ())::INTEGER AS n_test
            FROM (SELECT *, floor(x2 + 1e-9::DOUBLE)::BIGINT AS f2 FROM (SELECT *, ceil(hold_total * 0.5::DOUBLE - 1e-9::DOUBLE)::BIGINT AS test_total,
                    hold * ceil(hold_total * 0.5::DOUBLE - 1e-9::DOUBLE) / hold_total::DOUBLE AS x2 FROM held)))""",
        """quotas AS (SELECT stratum, n, rare, n - n_val - n_test AS n_train, n_val, n_test FROM (
              SELECT stratum, n, rare, n_val, n_test FROM rare UNION ALL SELECT stratum, n, false, hold - n_test, n_test FROM tested))""",
    )


def split_sql(ids: str, key: str) -> tuple[str, ...]:
    """Quotas and a split per id over ids(key, stratum)."""
    return (
        f"counts AS (SELECT stratum, count(*) AS n FROM {ids} GROUP BY 1)",
        *quota_sql("counts"),
        f"""assigned AS (SELECT r.{key}, r.stratum, q.rare, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '42', {key})), {key}) AS rn FROM {ids}) r JOIN quotas q ON r.stratum = q.stratum)""",
    )


_RATIO_STRATA = f"strata AS (SELECT patient_id, {RATIO_BIN} AS stratum FROM frames GROUP BY 1)"
_FINE_STRATA = """strata AS (SELECT 'vid_' || c_custkey AS patient_id, 'n' || c_nationkey || '_' || CASE WHEN c_custkey % 37 = 0 THEN 'rare' || c_custkey % 5 ELSE c_mktsegment END AS stratum FROM customer)"""


def _fine_strata(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    tail = F.when(k % 37 == 0, F.concat(F.lit("rare"), (k % 5).cast("string"))).otherwise(F.col("c_mktsegment"))
    return v.table("customer").select(
        F.concat(F.lit("vid_"), k.cast("string")).alias("patient_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("_"), tail).alias("stratum"),
    )


@query(
    "g01_split_quotas",
    f"WITH {_FINE_STRATA}, counts AS (SELECT stratum, count(*) AS n FROM strata GROUP BY 1), " + ",\n".join(quota_sql("counts")) + " SELECT * FROM quotas",
)
def g01(v: Views) -> DataFrame:
    counts = _fine_strata(v).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return splits.split_quotas(counts, 0.70, 0.15, 0.15)


@query(
    "g01_split_with_rare_strata",
    f"WITH {_FINE_STRATA}, " + ",\n".join(split_sql("strata", "patient_id")) + " SELECT patient_id, stratum, rare, split FROM assigned",
)
def g01b(v: Views) -> DataFrame:
    return splits.split_ids(_fine_strata(v), "patient_id").select("patient_id", "stratum", "rare", "split")


@query(
    "g02_patient_split",
    sql("frames", "SELECT f.frame_id, f.patient_id, a.split FROM frames f JOIN assigned a ON f.patient_id = a.patient_id", _RATIO_STRATA, *split_sql("strata", "patient_id")),
)
def g02(v: Views) -> DataFrame:
    return splits.assign_train_val_test_split(v.frames().drop("split")).select("frame_id", "patient_id", "split")


@query(
    "g02_split_info",
    sql("frames", """SELECT a.split, s.n_patients, s.n_frames, f.label, count(*) AS n_label_frames FROM frames f JOIN assigned a ON f.patient_id = a.patient_id
        JOIN (SELECT a.split, count(DISTINCT f.patient_id) AS n_patients, count(*) AS n_frames FROM frames f JOIN assigned a ON f.patient_id = a.patient_id GROUP BY 1) s ON a.split = s.split
        GROUP BY ALL""", _RATIO_STRATA, *split_sql("strata", "patient_id")),
)
def g02b(v: Views) -> DataFrame:
    return splits.split_info(splits.assign_train_val_test_split(v.frames().drop("split")))


@query(
    "d05_split_map_join",
    sql("frames", "SELECT f.frame_id, f.segment_number, s.split FROM frames f LEFT JOIN (SELECT DISTINCT patient_id, split FROM frames WHERE label = 1) s ON f.patient_id = s.patient_id"),
)
def d05(v: Views) -> DataFrame:
    f = v.frames()
    split_map = f.filter(F.col("label") == 1).select("patient_id", "split").distinct()
    return join_by_entity(f.drop("split"), split_map, ["patient_id"]).select("frame_id", "segment_number", "split")


def fold_sql(strata: str, src: str, k: int = 5) -> tuple[str, ...]:
    return (
        f"""sizes AS (SELECT s.patient_id, stratum, n FROM {strata} s JOIN (SELECT patient_id, count(*) AS n FROM {src} GROUP BY 1) c ON s.patient_id = c.patient_id)""",
        f"""dealt AS (SELECT patient_id, stratum, n AS n_frames,
              ((CASE WHEN (r // {k}) % 2 = 0 THEN r % {k} ELSE {k - 1} - r % {k} END) + (dense_rank() OVER (ORDER BY stratum) - 1)) % {k} AS fold
            FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, md5(concat_ws('|', '42', patient_id)), patient_id) - 1 AS r FROM sizes))""",
    )


_MODAL_STRATA = "strata AS (SELECT patient_id, (avg(label) > 0.5)::INTEGER::VARCHAR AS stratum FROM frames GROUP BY 1)"


@query(
    "g03_cv_folds",
    sql("frames", "SELECT patient_id, stratum, n_frames, fold::INTEGER AS fold FROM dealt", _MODAL_STRATA, *fold_sql("strata", "frames")),
)
def g03(v: Views) -> DataFrame:
    f = v.frames()
    return splits.patient_folds(f, splits.modal_label(f), 5)


@query(
    "g04_val_split",
    sql("frames", """SELECT frame_id, CASE WHEN rn <= n_val THEN 'val' ELSE 'train' END AS role FROM frames f JOIN (
          SELECT patient_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '42', patient_id)), patient_id) AS rn FROM strata) s ON f.patient_id = s.patient_id
        JOIN q ON q.stratum = s.stratum""", _MODAL_STRATA,
        """q AS (SELECT stratum, fl + (row_number() OVER (ORDER BY round(x - fl, 9) DESC, stratum) <= target - sum(fl) OVER ())::INTEGER AS n_val FROM (
             SELECT *, floor(x + 1e-9::DOUBLE)::BIGINT AS fl FROM (SELECT stratum, ceil(sum(n) OVER () * 0.15::DOUBLE - 1e-9::DOUBLE)::BIGINT AS target,
               n * ceil(sum(n) OVER () * 0.15::DOUBLE - 1e-9::DOUBLE) / sum(n) OVER ()::DOUBLE AS x FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY 1))))"""),
)
def g04(v: Views) -> DataFrame:
    return splits.assign_val_split(v.frames(), 0.15).select("frame_id", "role")


_CLIP_STRATA = (
    """clips AS (SELECT clip_key, (avg(label) > 0.5)::INTEGER AS label, count(*) AS n_frames FROM frames GROUP BY 1)""",
    """cuts AS (SELECT label, CASE WHEN q33 = q66 THEN q66 - 1 ELSE q33 END AS q33, q66 FROM (
         SELECT label, quantile_cont(n_frames, 1.0::DOUBLE / 3) AS q33, quantile_cont(n_frames, 2.0::DOUBLE / 3) AS q66 FROM clips GROUP BY 1))""",
    """binned AS (SELECT c.*, c.label || '_' || CASE WHEN n_frames <= q33 THEN 'few' WHEN n_frames <= q66 THEN 'medium' ELSE 'many' END AS stratum FROM clips c JOIN cuts ON c.label = cuts.label)""",
    """q AS (SELECT stratum, fl + (row_number() OVER (ORDER BY round(x - fl, 9) DESC, stratum) <= target - sum(fl) OVER ())::INTEGER AS quota FROM (
         SELECT *, floor(x + 1e-9::DOUBLE)::BIGINT AS fl FROM (SELECT stratum, greatest(1, round_even(sum(n) OVER () * 0.2::DOUBLE, 0))::BIGINT AS target,
           n / sum(n) OVER ()::DOUBLE * greatest(1, round_even(sum(n) OVER () * 0.2::DOUBLE, 0)) AS x FROM (SELECT stratum, count(*) AS n FROM binned GROUP BY 1))))""",
    """chosen AS (SELECT clip_key FROM (SELECT clip_key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '42', clip_key)), clip_key) AS rn FROM binned) b
         JOIN q ON b.stratum = q.stratum WHERE rn <= quota)""",
)


@query(
    "g05_clip_strata",
    sql("frames", "SELECT clip_key, label, n_frames, stratum FROM binned", *_CLIP_STRATA),
)
def g05a(v: Views) -> DataFrame:
    return splits.clip_strata(v.frames())


@query("g05_sample_train", sql("frames", "SELECT frame_id FROM frames WHERE clip_key IN (SELECT clip_key FROM chosen)", *_CLIP_STRATA))
def g05(v: Views) -> DataFrame:
    return splits.sample_train(v.frames(), 0.2).select("frame_id")


@query(
    "g06_row_level_split",
    sql("causes", "SELECT doc_id, stratum, split FROM assigned",
        r"""ids AS (SELECT doc_id, CASE WHEN label = 1 THEN 'informative' WHEN trim(coalesce(cause, '')) = '' THEN 'non_informative__none'
              ELSE 'non_informative__' || regexp_replace(trim(cause), '\s+', '_', 'g') END AS stratum FROM causes)""", *split_sql("ids", "doc_id")),
)
def g06(v: Views) -> DataFrame:
    ids = v.causes().select("doc_id", parse.cause_stratum(F.col("label"), F.col("cause")).alias("stratum"))
    return splits.split_ids(ids, "doc_id").select("doc_id", "stratum", "split")


@query(
    "g07_fold_table",
    sql("frames", """SELECT i::INTEGER AS cv_fold, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS role, count(*) AS n, sum(label)::BIGINT AS n_pos FROM frames JOIN dealt ON frames.patient_id = dealt.patient_id, range(5) t(i)
        WHERE split <> 'test' GROUP BY 1, 2""".replace("fold = i", "dealt.fold = i"),
        "pool AS (SELECT * FROM frames WHERE split <> 'test')",
        "strata AS (SELECT patient_id, (avg(label) > 0.5)::INTEGER::VARCHAR AS stratum FROM pool GROUP BY 1)", *fold_sql("strata", "pool")),
)
def g07(v: Views) -> DataFrame:
    pool = splits.train_pool(v.frames().drop("fold"), use_full_trainset=True)
    folds = splits.fold_table(splits.assign_cv_folds(pool, 5), 5)
    return folds.groupBy("cv_fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))


@query(
    "g07_train_val_roles",
    sql("frames", "SELECT split AS role, count(*) AS n FROM frames WHERE split IN ('train', 'val') GROUP BY 1"),
)
def g07b(v: Views) -> DataFrame:
    return splits.train_val_roles(v.frames()).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u01_custom_stratum",
    sql("frames", "SELECT patient_id, (count(DISTINCT clip_key) > 8)::VARCHAR AS stratum FROM frames GROUP BY 1"),
)
def u01(v: Views) -> DataFrame:
    """A caller's stratum as one aggregate expression per patient."""
    return splits.strata_by(v.frames(), lambda: F.count_distinct("clip_key") > 8)
