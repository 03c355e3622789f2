"""The registered queries: names, plans and a few SQL comparisons at the smallest scale."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

FAMILIES = {
    "a": range(1, 10), "k": range(1, 5), "b": range(1, 20), "c": range(1, 11), "d": range(1, 12), "e": range(1, 37),
    "f": range(1, 12), "s": range(1, 4), "g": range(1, 15), "h": range(1, 34), "i": range(1, 10), "j": range(1, 3),
}


def test_every_family_member_has_a_query():
    have = {m.group(0) for n in entry.queries() if (m := re.match(r"[a-z]\d\d", n))}
    want = {f"{f}{i:02d}" for f, ids in FAMILIES.items() for i in ids}
    assert want - have == set()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120


@needs_data
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "auroc" in df.columns


@needs_data
@pytest.mark.parametrize("name", ["h07_threshold_sweep", "h21_delong_frames", "g02_patient_split", "f02_gaussian_long_clips", "d10_frames_in_windows"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in rel.description], rel.fetchall())


@needs_data
def test_plans_prune_columns_and_have_no_row_udf(spark):
    plan = entry.queries()["h04_auroc"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "lineitem" in line or "ReadSchema" in line]
    assert any("ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_quantity:double" in s or "l_quantity" in s for s in scan)
    assert not any("l_shipdate" in s or "l_discount" in s for s in scan)
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
