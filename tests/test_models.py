"""Fits and experiments read, carry and make only what they need."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from sigspark.operators import models
from sigspark.plans import experiments, model_queries


def counting(spark):
    """(accumulator, column maker): how often a column that is dear to make is made."""
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return float(v)
    return seen, lambda c: F.udf(counted, "double").asNondeterministic()(c)


@pytest.mark.parametrize("kind", ["tree", "linear", "gbm"])
def test_a_fit_reads_its_rows_once(spark, kind):
    seen, dear = counting(spark)
    rows = spark.range(400).select((F.col("id") % 2 == 0).alias("y"), dear(F.col("id") % 20).alias("x"))
    models.fit(kind, rows, ["x"], "y", **({"rounds": 2} if kind == "gbm" else {}))
    assert seen.value == 400


def detections(spark):
    seen, dear = counting(spark)
    r = spark.range(480).select(F.col("id").alias("row_id"), (F.col("id") % 24).alias("unit"), (F.col("id") % 2 == 0).alias("y"), F.when(F.floor(F.col("id") / 24) % 2 == 0, "r1").otherwise("r2").alias("rx"),
                                (F.col("id") % 4 * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("w"), F.concat(F.lit("c"), (F.col("id") % 24 % 3).cast("string")).alias("model"))
    return seen, r.withColumn("other", dear("row_id"))


def test_columns_that_no_step_reads_are_not_carried_along(spark):
    seen, rows = detections(spark)
    assert experiments.receiver_check(rows, ["w"], "unit", "rx", F.col("row_id") >= 0, "tree", 3, 20).count() == 1
    out = experiments.cross(rows.where("unit < 12"), rows.where("unit >= 12"), ["x"], "y", "unit", "tree", n_permutations=20, n_bootstrap=20)
    assert out["result"].first()["auc"] == 1 and seen.value == 0
    assert out["scores"].count() == 240 and "other" in out["scores"].columns and seen.value > 0


def test_only_what_is_asked_for_is_fitted(spark, monkeypatch):
    _, rows = detections(spark)
    fits, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda *a, **k: fits.append(a[2]) or fit(*a, **k))
    folds = [(F.col("unit") % 4 != k, F.col("unit") % 4 == k) for k in range(2)]
    out = experiments.identification(rows, folds, ["x", "w"], "model", "unit", "unit", "row_id", ["w"], "tree", 20, 20)
    assert set(out) == {"rows", "result", "baseline", "per_capture", "per_class", "icc", "versus_baseline"}
    assert out["result"].first()["n"] == 240 and fits == [["x", "w"]] * 2
    assert out["rows"].count() == 240 and out["baseline"].count() == 1 and out["versus_baseline"].count() == 1 and fits == [["x", "w"]] * 2 + [["w"]] * 2


@pytest.mark.parametrize("name, fits", [("cross_dataset", 1), ("model_gbm_out_of_fold", 3)])
def test_registered_boosted_models_have_all_their_rounds(spark, tmp_path, monkeypatch, name, fits):
    asked, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda *a, rounds=models.GBM_ROUNDS, **k: asked.append(rounds) or fit(*a, rounds=2, **k))
    monkeypatch.setattr(model_queries, "BOOTSTRAPS", 20)
    k = F.col("id")
    spark.range(1200).select(k.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), k.alias("l_partkey"), (k % 40).alias("l_suppkey"), (k % 50 * 1.0).alias("l_quantity"), (k % 97 * 10.5).alias("l_extendedprice"),
                             (k % 9 / 100).alias("l_tax"), (k % 11 / 100).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert model_queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if fits == 1 else 3)
    assert asked == [200] * fits == [models.GBM_ROUNDS] * fits


def test_merged_rows_boost_like_the_rows_themselves(spark):
    """Cells of one row to hundreds, of one class and of both; leaves of fewer than 20 rows stay refused."""
    r = spark.range(5000).select("id", F.pmod(F.hash("id"), F.lit(5)).alias("a"), F.when(F.col("id") % 300 == 0, F.pmod(F.hash("id", F.lit(1)), F.lit(300)) / 7).otherwise(F.col("id") % 3 * 1.0).alias("b"))
    r = r.withColumn("y", F.pmod(F.hash("id", F.lit(2)), F.lit(12)) < F.col("a") + F.when(F.col("b") > 20, 6).otherwise(F.col("b"))).cache()
    counts = models.class_counts(r, "y")
    model = models.fit("gbm", r, ["a", "b"], "y", rounds=8)
    weighted = models.balanced_weights(r, "y", counts)
    binned, names = model.preparation.columns(weighted)
    cells = models.merged(binned, names, counts).select(F.inline("points"))
    total, weight = cells.agg(F.sum("n"), F.sum(F.col("_weight") * F.col("n"))).first()
    assert 20 < total < 1000 and weight == pytest.approx(5000)
    plain = GBTClassifier(maxDepth=3, stepSize=0.05, maxIter=8, minInstancesPerNode=20, seed=0, featuresCol="_features", labelCol="_y", weightCol="_weight").fit(model.preparation.apply(weighted))
    both = models.Fitted("gbm", [False, True], model.preparation, [plain]).score(model.score(r, "ours"), "theirs")
    assert both.where(F.abs(F.col("ours") - F.col("theirs")) > 1e-9).count() == 0 and both.select("ours").distinct().count() > 8


def test_bins_are_cut_between_values():
    one = np.ones(1000)
    assert models._cuts(np.repeat([1.0, 2.0, 4.0], [998, 1, 1]), one) == [1.5, 3.0]         # rare values keep their bins
    many = models._cuts(np.arange(1000.0), one)
    assert len(many) == 31 and np.abs(np.diff([0, *many, 1000]) - 1000 / 32).max() < 1.5
    near = models._cuts(np.arange(33.0), np.r_[np.full(32, 1.0), 0.1])
    assert near[0] == 0.5 and near[-1] == 30.5                                              # the cut whose weight below is nearest, not the next
    heavy = models._cuts(np.r_[np.zeros(900), np.arange(1.0, 101)], one)
    assert heavy[0] == 0.5 and heavy == sorted(set(heavy)) and len(heavy) > 1
    assert models._cuts(np.array([3.0, 3.0]), one[:2]) == [3.0]


def test_a_fold_without_two_classes_outside_it_stops_before_any_fit(spark, monkeypatch):
    rows = spark.range(90).select((F.col("id") % 3 == 0).alias("y"), (F.col("id") % 5 * 1.0).alias("x"), F.when(F.col("id") % 3 == 0, "only").otherwise("rest").alias("fold"))
    fits = []
    monkeypatch.setattr(models, "fit", lambda *a, **k: fits.append(a))
    with pytest.raises(ValueError, match="one class"):
        models.out_of_fold(rows, "fold", ["x"], "y", "gbm")
    assert fits == []
