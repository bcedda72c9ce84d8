"""Every registered query runs at the smallest scale; those with SQL must agree with it there."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sigspark.plans.tables import NAMES

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
SLOW = {"evaluate_with_refits", "cross_dataset", "within_dataset", "source_widening", "learning_curve", "receiver_check", "held_out_identification", "dataset_identification",
        "shortcut_baseline", "model_gbm_out_of_fold", "metadata_only"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def test_names():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.count() == 1 and "auc" in df.columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns, want = [c[0] for c in cur.description], cur.fetchall()
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted([plain(r[c]) for c in order] for r in df.collect())
    assert got == sorted([plain(r[columns.index(c)]) for c in order] for r in want)
