import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import splits


def dealt_one_by_one(sizes, k):
    load, out = [0] * k, []
    for s in sizes:
        f = min(range(k), key=lambda i: (load[i], i))
        out.append(f)
        load[f] += s
    return out


def test_dealing_by_size_class_equals_dealing_one_by_one():
    rng = random.Random(0)
    for _ in range(300):
        k = rng.randint(2, 7)
        sizes = sorted((rng.choice([1, 1, 1, 2, 3, 5, 8, 40, 41, 300]) for _ in range(rng.randint(1, 120))), reverse=True)
        classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        got, segments = [], splits._deal(classes, k)
        for size, many in classes:
            own = [(at, cycle) for s, at, cycle, _ in segments if s == size]
            for p in range(many):
                at, cycle = [x for x in own if x[0] <= p][-1]
                got.append(cycle[(p - at) % len(cycle)])
        assert got == dealt_one_by_one(sizes, k)


@pytest.fixture
def captures(spark):
    rows = [(f"d/c{g}_{i}", f"d/g{g}", g < 6) for g in range(10) for i in range(3)]
    return spark.createDataFrame(rows, "capture_id string, group_id string, label_uas_present boolean")


def test_group_kfold_keeps_groups_and_balances(captures):
    folds = splits.group_kfold(captures, 2, "label_uas_present")
    a = splits.assign(captures, folds)
    assert splits.leakage_problems(captures, a).count() == 0
    per = a.join(captures, "capture_id").where("label_uas_present").groupBy("partition").count().collect()
    assert sorted(r["count"] for r in per) == [9, 9]


def test_null_labels_are_their_own_value(spark):
    d = spark.createDataFrame([("a", True), ("a", None), ("b", None), ("c", False)], "group_id string, y boolean")
    got = {r["stratum"]: r["n_groups"] for r in splits.feasibility(d, "y").collect()}
    assert got == {"None|true": 1, "false": 1}


def test_leakage_is_reported(spark, captures):
    a = spark.createDataFrame([("d/c0_0", "x"), ("d/c0_1", "y"), ("d/zzz", "x")], "capture_id string, partition string")
    got = {(r["rule"], r["entity_id"], r["detail"]) for r in splits.leakage_problems(captures, a).collect()}
    assert got == {("group spans partitions", "d/g0", "x,y"), ("unknown capture", "d/zzz", "")}


def test_digest_depends_on_content_only(spark, captures):
    a = splits.assign(captures, splits.group_kfold(captures, 2, "label_uas_present"))
    b = a.orderBy(F.desc("capture_id")).repartition(3)
    assert splits.block_digest(a).collect() == splits.block_digest(b).collect()
    c = a.withColumn("partition", F.when(F.col("capture_id") == "d/c0_0", "other").otherwise(F.col("partition")))
    assert splits.block_digest(c).first()["assignment_sha256"] != splits.block_digest(a).first()["assignment_sha256"]


def test_registry_ids_never_change_meaning(spark, captures, tmp_path):
    reg = splits.SplitRegistry(spark, str(tmp_path))
    a = splits.assign(captures, splits.group_kfold(captures, 2, "label_uas_present"))
    first = reg.save("d/kfold", "experiment", "k=2", captures, a, seed=0)
    assert reg.save("d/kfold", "experiment", "k=2", captures, a, seed=0)["assignment_sha256"] == first["assignment_sha256"]
    assert first["counts"]["fold0"] == {"true": 9, "false": 6}
    assert reg.load("d/kfold").count() == 30
    other = a.withColumn("partition", F.lit("test"))
    with pytest.raises(ValueError, match="different assignment"):
        reg.save("d/kfold", "experiment", "k=2", captures, other)
    leaky = a.withColumn("partition", F.col("capture_id"))
    with pytest.raises(ValueError, match="spans"):
        reg.save("d/leaky", "experiment", "bad", captures, leaky)
    reg.retire("d/kfold", "wrong groups")
    with pytest.raises(ValueError, match="never reused"):
        reg.save("d/kfold", "experiment", "k=2", captures, a)
    with pytest.raises(KeyError):
        reg.load("d/kfold")


def test_default_plan(spark, captures):
    groups = captures.select("group_id").distinct().withColumn("status", F.lit("VERIFIED"))
    none = captures.withColumn("official_split", F.lit(None).cast("string"))
    assert splits.default_plan(none, groups) == [{"strategy": "group-kfold", "k": 4}]
    unknown = groups.withColumn("status", F.lit("UNKNOWN"))
    given = captures.withColumn("official_split", F.lit("train"))
    assert splits.default_plan(given, unknown) == [{"strategy": "official"}, {"strategy": "evaluation-only"}]
    assert splits.official(none.withColumn("official_split", F.lit(""))).count() == 0


def test_stratified_kfold_deals_evenly(spark):
    d = spark.range(103).select("id", (F.col("id") % 2).alias("s"))
    n = splits.stratified_kfold(d, "id", ["s"], 5).groupBy("s", "fold").count().collect()
    assert all(10 <= r["count"] <= 11 for r in n)


def test_training_draws_leave_the_held_out_unit_out(spark):
    from sigspark.operators.sampling import training_draws
    u = spark.range(8).select(F.col("id").cast("string").alias("unit"))
    out = training_draws(u, u, "unit", 3, 4).toPandas()
    assert (out["held_out"] != out["unit"]).all()
    assert (out.groupby(["held_out", "draw"]).size() == 3).all() and len(out) == 8 * 4 * 3
    assert not out.duplicated().any()


def test_training_draws_are_independent(spark):
    """Each set is drawn anew: k = 1 is not the start of k = 2, held-out units do not share their draws, all units come up."""
    from sigspark.operators.sampling import training_draws
    u = spark.range(40).select("id")
    one, two = (training_draws(u, u, "id", k, 50, 7).toPandas() for k in (1, 2))
    pairs = two.groupby(["held_out", "draw"])["id"].agg(set)
    nested = [r.id in pairs[(r.held_out, r.draw)] for r in one.itertuples()]
    assert 0.02 < sum(nested) / len(nested) < 0.09                                   # 2 of 39 by chance
    for frame, k in ((one, 1), (two, 2)):
        per_draw = frame.groupby("draw")["id"].nunique()
        assert per_draw.min() > 15                                                  # shared draws would show two or three
        seen = frame.groupby("id").size()
        assert len(seen) == 40 and seen.min() > 25 * k and seen.max() < 85 * k
    assert training_draws(u.where("id < 3"), u.where("id < 4"), "id", 3, 2).select("held_out").distinct().collect() == [(3,)]
    assert training_draws(u.where("id < 3"), u.limit(0), "id", 2, 2).count() == 0
    with pytest.raises(ValueError):
        training_draws(u, u, "id", 0, 2)
