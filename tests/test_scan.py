"""Ordered scans cut into many ranges must equal plain windows, also with one dominant key and heavy ties."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigspark.operators import profiles, ranks, sampling, sequences
from sigspark.operators.scan import RANGE, lookup_join, ordered, with_ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))              # one key holds half of the rows
    t = np.where(rng.random(n) < 0.35, 500, rng.integers(0, 1000, n))           # one time holds a third of the rows
    pdf = pd.DataFrame({"k": key, "t": t, "id": np.arange(n), "v": rng.integers(0, 50, n).astype(float), "label": rng.random(n) < 0.4})
    return spark.createDataFrame(pdf).repartition(5).cache()


def same(a, b):
    cols = sorted(b.columns)
    x, y = (sorted(map(tuple, d.select(*cols).collect()), key=repr) for d in (a, b))
    assert x == y


def test_ranges_keep_order_and_stay_small(rows):
    ranged, n = with_ranges(rows, ["t", "id"], target_rows=200)
    assert n > 10
    sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
    assert max(sizes) < 700                                                      # the heavy time is cut by id
    pdf = ranged.toPandas().sort_values(["t", "id"])
    assert pdf[RANGE].is_monotonic_increasing


def test_lag_running_and_row_number(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    scan = ordered(rows, ["k"], ["t", "id"], target_rows=150)
    assert scan.ranges > 5
    got = scan.lag({"p1": ("v", 1), "p3": ("v", 3)}).running({"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}).running({"before": (F.sum, F.col("v"))}, inclusive=False).row_number("rn").frame()
    want = (rows.withColumn("p1", F.lag("v", 1).over(w)).withColumn("p3", F.lag("v", 3).over(w)).withColumn("rn", F.row_number().over(w).cast("long")))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = want.withColumn("s", F.sum("v").over(up)).withColumn("m", F.max("v").over(up)).withColumn("before", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same(got, want)


def test_keys_that_fit_a_range_are_not_cut(rows):
    largest = rows.groupBy("k").count().agg(F.max("count")).first()[0]
    whole, cut = (ordered(rows, ["k"], ["t", "id"], target_rows=t) for t in (largest, largest - 1))
    assert (whole.ranges, cut.ranges > 1) == (1, True)                           # 3 000 rows are two ranges either way
    same(whole.row_number("rn").frame(), cut.row_number("rn").frame())


def test_global_order(rows):
    w = Window.partitionBy(F.lit(0)).orderBy("v", "id")
    same(ordered(rows, [], ["v", "id"], target_rows=100).row_number("rn").frame(), rows.withColumn("rn", F.row_number().over(w).cast("long")))


@pytest.mark.parametrize("f", [
    lambda d, t: sequences.alarms(d, ["k"], ["t", "id"], F.col("v") > 25, target_rows=t),
    lambda d, t: sequences.value_runs(d, ["k"], ["t", "id"], F.col("v") > 25, target_rows=t),
    lambda d, t: sequences.runs(d, ["k"], "t", target_rows=t),
    lambda d, t: sequences.missing_numbers(d.withColumn("v", F.col("v").cast("int")), ["k"], "v", 0, target_rows=t),
    lambda d, t: sequences.interval_union(d.withColumn("e", F.col("t") + F.col("v")), ["k"], "t", "e", "id", target_rows=t),
    lambda d, t: sequences.transitions(d, ["k"], ["t", "id"], "v", target_rows=t),
    lambda d, t: sampling.running_quota(d, ["k"], ["t", "id"], "v", 200, target_rows=t),
    lambda d, t: ranks.auc(d, "v", F.col("label"), ["k"], target_rows=t),
    lambda d, t: ranks.auc_per_stratum(d, "v", F.col("label"), "k", target_rows=t),
    lambda d, t: ranks.mid_ranks(d, "v", ["k"], target_rows=t),
    lambda d, t: ranks.exact_quantiles(d, "v", {"a": 0.025, "b": 0.5, "c": 0.975}, ["k"], target_rows=t),
    lambda d, t: profiles.bin_medians(d, F.floor(F.col("t") / 50), "v", ["k"], target_rows=t),
], ids=["alarms", "value_runs", "runs", "missing", "union", "transitions", "quota", "auc", "auc_per_stratum", "mid_ranks", "quantiles", "bin_medians"])
def test_many_ranges_equal_one(rows, f):
    def rounded(d):
        return d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    same(rounded(f(rows, 90)), rounded(f(rows, 10 ** 9)))


def test_spearman_against_numpy(rows):
    pdf = rows.toPandas()
    a, b = pdf["t"].rank(), pdf["v"].rank()
    got = ranks.spearman(rows, "t", "v", target_rows=100).first()["spearman"]
    assert abs(got - np.corrcoef(a, b)[0, 1]) < 1e-9


def test_time_blocks_split_only_after_longer_pause(spark):
    df = spark.sql("select 'a' k, id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) ts from values (1, 0), (2, 3600), (3, 7201) as t(id, s)")
    out = sequences.time_blocks(df, ["k"], "ts", "id", 3600).orderBy("block").collect()
    assert [r["n"] for r in out] == [2, 1]


def test_lookup_join_spreads_hot_keys(spark, monkeypatch):
    import sigspark.operators.scan as scan
    monkeypatch.setattr(scan, "TARGET_ROWS", 10)
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("w"), F.min("id").alias("first"))
    same(lookup_join(rows, table, ["k"], "w", share=100), rows.join(table.drop("w"), "k"))


def test_lookup_join_of_rows_with_maps(spark):
    rows = spark.sql("select id % 3 as k, map('a', id) as m, struct(map('b', id) as inner) as s, array(map(id, 1)) as l, id from range(500)")
    table = spark.createDataFrame([(0, 167, "x"), (1, 167, "y"), (None, 5, "z")], "k long, n long, name string")
    got = lookup_join(rows, table, ["k"], "n", "left", salts=4, share=10).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"x": 167, "y": 167, None: 166}


def test_fine_cuts_are_a_table(rows, monkeypatch):
    import sigspark.operators.scan as scan
    monkeypatch.setattr(scan, "COARSE", 4)
    ranged, n = scan.with_ranges(rows, ["t", "id"], target_rows=50)
    assert n > 40
    sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300
    assert ranged.toPandas().sort_values(["t", "id"])[RANGE].is_monotonic_increasing
    w = Window.partitionBy("k").orderBy("t", "id")
    for shared in (1 << 18, 1):                                     # broadcast or joined
        monkeypatch.setattr(scan, "SHARED_CUTS", shared)
        got = scan.ordered(rows, ["k"], ["t", "id"], target_rows=50).lag({"p": ("v", 2)}).row_number("rn").frame()
        same(got, rows.withColumn("p", F.lag("v", 2).over(w)).withColumn("rn", F.row_number().over(w).cast("long")))


def test_null_order_values_with_fine_cuts(spark, monkeypatch):
    import sigspark.operators.scan as scan
    monkeypatch.setattr(scan, "COARSE", 3)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("v"), F.col("id").alias("id"))
    got = scan.ordered(rows, [], ["v", "id"], target_rows=40).row_number("rn").frame()
    same(got, rows.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")).cast("long")))


def test_runs_evaluate_their_input_once(spark):
    """Numbers that are dear to make, as row numbers of another scan are, are made once for counting, cutting and scanning."""
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v
    df = spark.range(500).select(F.lit(1).alias("k"), F.udf(counted, "long").asNondeterministic()("id").alias("i"))
    got = sequences.runs(df.where("i % 100 <> 7"), ["k"], "i", 50).collect()
    assert sorted(r["n"] for r in got) == [7, 92, 99, 99, 99, 99] and seen.value == 500


def test_boundary_steps_and_quantiles_evaluate_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return float(v * 7 % 101)
    df = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.udf(counted, "double").asNondeterministic()("id").alias("v"))
    steps = np.abs(np.diff([i * 7 % 101 for i in range(500)]))
    at = np.arange(1, 500) % 25 == 0
    got = sequences.boundary_steps(df, ["k"], "i", "v", 25, 50).collect()[0]
    assert got["boundaries"] == at.sum() and got["ratio"] == np.median(steps[at]) / np.median(steps[~at]) and seen.value == 500
    seen.value = 0
    got = ranks.exact_quantiles(df, "v", {"q": 0.3}, ["k"], 50).collect()[0]
    assert got["n"] == 500 and got["q"] == pytest.approx(np.quantile([i * 7 % 101 for i in range(500)], 0.3)) and seen.value <= 1000     # counted, then reduced
