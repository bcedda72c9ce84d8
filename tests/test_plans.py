"""The plans queries are meant to have: pruned scans, no Cartesian product, no single-task window over fact rows."""
import re

import pytest
from pyspark.sql import functions as F

from sigspark.plans import evaluation, experiments, registry

QUERIES = registry.queries()


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["group_auc_bootstrap", "time_blocks", "kofn_onsets", "interval_overlap", "knn_one_class", "index_problems", "emitters", "content_duplicates", "spec_problems"])
def test_no_cartesian_product(spark, sf, name):
    assert "CartesianProduct" not in plan(spark, sf, name)


def test_scans_read_only_what_is_asked(spark, sf):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, sf, "time_blocks"))
    assert read and all(set(c.split(":")[0] for c in r.split(",")) <= {"user_id", "ts", "event_id"} for r in read)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, sf, "gapfree_runs"))
    assert all(set(c.split(":")[0] for c in r.split(",")) <= {"l_orderkey", "l_linenumber"} for r in read)


def test_filters_reach_the_scan(spark, sf):
    assert "GreaterThan(value,20.0)" in plan(spark, sf, "first_loud_rows")


def test_top_n_is_pruned_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "capped_sample")


@pytest.mark.parametrize("name", ["time_blocks", "kofn_onsets", "interval_union_occupancy", "running_quota", "gapfree_runs"])
def test_windows_are_not_single_tasks(spark, sf, name):
    assert "SinglePartition" not in plan(spark, sf, name)


def _grouped(spark):
    rows = [(g, g % 2 == 0, float((g * 7 + i * 3) % 11 + (g % 2 == 0) * 2)) for g in range(24) for i in range(20)]
    return spark.createDataFrame(rows, "unit long, y boolean, level double")


def test_a_shortcut_baseline_carries_no_other_column(spark):
    rows = _grouped(spark)
    read = rows.withColumn("wide", F.raise_error(F.lit("a column that no step needs was read")).cast("string"))
    found = [experiments.shortcut_baseline(r, ["level"], "y", "unit", 3, 50).first() for r in (rows, read)]
    assert found[0] == found[1] and found[0].n_pos + found[0].n_neg == 480


def test_an_external_evaluation_places_the_groups_once(spark, monkeypatch):
    rows, made = _grouped(spark), []
    ci = evaluation.auc_interval(rows, "unit", "y", "level", 60).first()
    p = evaluation.auc_permutation(rows, "unit", "y", "level", 70).first()
    for name in ("pure_numbered_groups", "placed_counts"):
        step = getattr(evaluation.R, name, None) or (lambda *_: None)
        monkeypatch.setattr(evaluation.R, name, lambda *a, step=step, name=name: made.append(name) or step(*a), raising=False)
    both = evaluation.external(rows, "unit", "y", "level", 70, 60).first()
    assert sorted(made) == ["placed_counts", "pure_numbered_groups"]
    assert both.asDict() == {**ci.asDict(), **{c: p[c] for c in ("p_value", "null_median", "null_95th")}}
