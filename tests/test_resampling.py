import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import metrics, ranks, replicates
from sigspark.operators import resampling as R
from sigspark.operators.replicates import GroupDraws, GroupShuffles, Rotations
from sigspark.plans import evaluation, experiments


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    p, n = y.sum(), (~y).sum()
    return (r[y].sum() - p * (p + 1) / 2) / (p * n)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(0)
    g = np.repeat(np.arange(20), 30)
    y = g % 2 == 0
    noise = rng.normal(size=20)[g]
    return pd.DataFrame({"row_id": np.arange(600), "group_id": g, "y": y, "score": np.round(3 * y + noise + 0.2 * rng.normal(size=600), 1), "flat": np.round(noise, 1)})


@pytest.fixture(scope="module")
def scores(spark, table):
    return spark.createDataFrame(table).cache()


def pick(rep, slot, n):
    """One pick in Python's unbounded integers."""
    p = 2147483647
    r = (rep % p + 1) * 69621 % p
    h = ((slot % p + 1) * 48271 + slot // p * 40692 % p + r) % p
    a = h * (h + 16807) % p
    b = a * ((a + r) % p) % p
    c = b * (b + 12345) % p
    return (c * p + b) % n


def all_weights(draws):
    return np.concatenate([draws.weights(np.arange(draws.n_groups), reps) for reps in replicates.chunks(draws.n_replicates)], axis=1)


def all_codes(source, n):
    return np.concatenate([source.codes(np.arange(n), reps) for reps in replicates.chunks(source.n_replicates)], axis=1)


def resampled(table, column, weights):
    """AUC of rows copied out by hand, per replicate; None where a class is missing."""
    out = []
    for w in weights.T.astype(int):
        idx = np.repeat(np.arange(len(table)), w[table["group_id"].to_numpy()])
        y, s = table["y"].to_numpy()[idx], table[column].to_numpy()[idx]
        out.append(auc(y, s) if 0 < y.sum() < len(y) else None)
    return {i: v for i, v in enumerate(out) if v is not None}


@pytest.mark.parametrize("rows_per_range", [10 ** 6, 60, 7])
@pytest.mark.parametrize("column", ["score", "constant"])
def test_bootstrap_replicates_equal_resampled_rows(table, scores, column, rows_per_range):
    """Ranges of 7 rows cut ties of one score into many tasks; the constant is one tie of all groups."""
    pdf, df = table.assign(constant=1.5), scores.withColumn("constant", F.lit(1.5))
    numbered, n = R.pure_numbered_groups(df, "group_id", "y")
    draws = GroupDraws(n, 70)
    got = {r["rep"]: r["auc"] for r in R.auc_replicates(df, numbered, "group_id", "y", column, draws, rows_per_range).collect()}
    want = resampled(pdf, column, all_weights(draws))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("rows_per_range", [10 ** 6, 7])
def test_permutation_replicates_equal_relabelled_rows(table, scores, rows_per_range):
    numbered, n = R.pure_numbered_groups(scores, "group_id", "y")
    for source in (R.shuffles(numbered, "y", 70, 3), R.rotations(numbered, "y", 70)):
        got = {r["rep"]: r["auc"] for r in R.auc_replicates(scores, numbered, "group_id", "y", "score", source, rows_per_range).collect()}
        want = {k: auc(c[table["group_id"].to_numpy()] == 1, table["score"].to_numpy()) for k, c in enumerate(all_codes(source, n).T)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_score_of_a_third_of_all_rows_is_cut(spark):
    """One score in 3 000 groups: no range task holds more than its share of them, and the AUC is the plain one."""
    pdf = pd.DataFrame({"group_id": np.arange(9000), "y": np.arange(9000) % 2 == 0, "score": np.where(np.arange(9000) < 3000, 0.5, (np.arange(9000) * 7919 % 1000) / 1000)})
    df = spark.createDataFrame(pdf)
    numbered, n = R.pure_numbered_groups(df, "group_id", "y")
    placed = df.groupBy("group_id", "score").count().join(numbered, "group_id")
    ranged, _ = R.with_ranges(placed, ["score", "_g"], 500)
    assert ranged.groupBy(R.RANGE).count().agg(F.max("count")).first()[0] < 1500
    draws = GroupDraws(n, 3)
    got = {r["rep"]: r["auc"] for r in R.auc_replicates(df, numbered, "group_id", "y", "score", draws, 500).collect()}
    want = resampled(pdf, "score", all_weights(draws))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_picks_do_not_overflow():
    slots = 10**12 + np.arange(5) * 3
    got = replicates.picks(np.arange(5) + 10**6, slots, 10**15)
    assert got.tolist() == [pick(10**6 + i, int(s), 10**15) for i, s in enumerate(slots)] and len(set(got.tolist())) == 5


@pytest.mark.parametrize("first, n", [(0, 50), (0, replicates.BLOCK), (77 << 32, replicates.BLOCK), (1 << 50, 4095)])
def test_picks_of_a_block_are_the_plain_picks(first, n):
    reps = np.arange(9) * 1_000_003
    assert replicates.block_picks(reps, first, 300, n).tolist() == [[pick(int(r), first + j, n) for j in range(300)] for r in reps]


def test_draws_grow_with_the_rows_and_not_with_rows_times_groups():
    """Six times the rows and groups: ranges x groups, the draws of a replicate, grow no faster up to the largest range."""
    drawn = [n_groups * -(-n_rows // R.drawn_range_rows(n_groups, n_rows)) for n_groups, n_rows in [(90_000 * k, 6_000_000 * k) for k in (1, 6)]]
    assert drawn[1] <= 6 * drawn[0] and R.drawn_range_rows(10 ** 9, 10 ** 12) == R.MAX_ROWS_PER_RANGE


def test_two_classes_dealt_to_groups_need_no_range_of_rows(spark, scores):
    numbered, _ = R.pure_numbered_groups(scores, "group_id", "y")
    plan = R.auc_replicates(scores, numbered, "group_id", "y", "score", R.shuffles(numbered, "y", 70, 3), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_slices_of_a_range_add_up(spark):
    """One range of many slices, ties across them, a score heavier than a slice in the middle, weighted rows."""
    rng = np.random.default_rng(1)
    g = rng.integers(0, 300, 9000)
    pdf = pd.DataFrame({"group_id": g, "y": g % 3 == 0, "score": np.where(np.arange(9000) < 2500, 40.0, rng.integers(0, 2000, 9000) / 20)})
    df = spark.createDataFrame(pd.concat([pdf.assign(score=pdf["score"] + d) for d in (0, 0.001, 0.002)] + [pdf]))
    numbered, n = R.pure_numbered_groups(df, "group_id", "y")
    draws = GroupDraws(n, 5)
    got = {r["rep"]: r["auc"] for r in R.auc_replicates(df, numbered, "group_id", "y", "score", draws).collect()}
    want = resampled(df.toPandas(), "score", all_weights(draws))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_one_block_draws_are_the_plain_picks():
    w = all_weights(GroupDraws(50, 3))
    want = np.zeros((50, 3))
    for rep in range(3):
        for slot in range(50):
            want[pick(rep, slot, 50), rep] += 1
    assert (w == want).all()


@pytest.mark.parametrize("n", [1, 2, 50, replicates.BLOCK, replicates.BLOCK + 1, 3 * replicates.BLOCK + 17])
def test_draws_are_as_many_as_groups_and_even(n):
    w = all_weights(GroupDraws(n, 130, seed=5))
    assert (w.sum(axis=0) == n).all()
    if n >= 50:
        assert abs((w == 0).mean() - np.exp(-1)) < 0.03 and abs(w.var() - 1) < 0.1         # as of drawing with replacement
        assert len({tuple(c) for c in w.T.astype(int).tolist()}) == 130
        assert (all_weights(GroupDraws(n, 130, seed=6)) != w).any()


def test_draws_of_some_groups_are_those_of_all():
    """A task that holds few groups, over several blocks, sees what a task that holds all does."""
    draws = GroupDraws(5 * replicates.BLOCK + 3, 70, seed=2)
    some = np.array([0, 5, replicates.BLOCK, 4 * replicates.BLOCK - 1, 5 * replicates.BLOCK + 2])
    for reps in replicates.chunks(70):
        assert (draws.weights(some, reps) == draws.weights(np.arange(draws.n_groups), reps)[some]).all()


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (3, 2), (7, 5, 3), (500, 501)])
def test_shuffles_keep_class_sizes(sizes):
    source, n = GroupShuffles(sizes, 200, seed=1), sum(sizes)
    codes = all_codes(source, n)
    assert all(np.bincount(c, minlength=len(sizes)).tolist() == list(sizes) for c in codes.T)
    places = np.concatenate([source.places(np.arange(n), reps) for reps in replicates.chunks(200)], axis=1)
    assert all(sorted(p) == list(range(n)) for p in places.T.tolist())
    if n > 100:
        assert abs(np.corrcoef(places[:, 0], np.arange(n))[0, 1]) < 0.15 and abs(np.corrcoef(places[:, 0], places[:, 1])[0, 1]) < 0.15


def test_shuffles_of_few_groups_are_even():
    """All 10 ways to give 2 of 5 groups the second label come up about equally often."""
    ways = pd.Series([tuple(c) for c in all_codes(GroupShuffles((3, 2), 4000, seed=9), 5).T.tolist()]).value_counts()
    assert len(ways) == 10 and ways.min() > 300 and ways.max() < 500


def test_rotations_are_for_few_groups():
    assert Rotations(np.array([0, 1, 1]), 2).codes(np.arange(3), np.arange(2)).T.tolist() == [[1, 0, 1], [1, 1, 0]]
    with pytest.raises(ValueError, match="rotations"):
        Rotations(np.broadcast_to(np.uint8(0), replicates.MAX_ROTATED + 1), 1)


def test_label_replicates_equal_resampled_rows(spark):
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(30), 12)
    pdf = pd.DataFrame({"g": g, "y": np.array(list("abc"))[g % 3], "p": rng.choice(list("abcz"), size=360)})
    df = spark.createDataFrame(pdf)
    numbered, n = R.pure_numbered_groups(df, "g", "y")
    counts, draws = R.label_counts(df, "g", "y", "p"), GroupDraws(30, 70)

    def balanced(truth, predicted):
        return np.mean([(predicted[truth == c] == c).mean() for c in np.unique(truth)])
    got = {r["rep"]: r["balanced_accuracy"] for r in R.balanced_accuracy_replicates(counts, numbered, "g", "y", "p", draws).collect()}
    for rep, w in enumerate(all_weights(draws).T.astype(int)):
        idx = np.repeat(np.arange(360), w[g])
        assert abs(got[rep] - balanced(pdf["y"].to_numpy()[idx], pdf["p"].to_numpy()[idx])) < 1e-12
    source = R.shuffles(numbered, "y", 70, 1)
    got = {r["rep"]: r["balanced_accuracy"] for r in R.permuted_balanced_accuracy(counts, numbered, "g", "y", "p", source).collect()}
    for rep, c in enumerate(all_codes(source, 30).T):
        assert abs(got[rep] - balanced(np.array(list("abc"))[c[g]], pdf["p"].to_numpy())) < 1e-12
    got = {r["rep"]: r["rate"] for r in R.rate_replicates(df, numbered, "g", F.col("p") == "z", draws).collect()}
    for rep, w in enumerate(all_weights(draws).T):
        assert abs(got[rep] - (w[g] * (pdf["p"] == "z")).sum() / w[g].sum()) < 1e-12


def test_null_groups_and_scores_beyond_numbers(spark):
    """Rows without a group are one group; null is the lowest score, not-a-number the highest, each tied with itself."""
    rows = [(None, True, float("nan")), (None, True, 0.2), ("a", False, float("nan")), ("a", False, 0.1), ("b", False, 0.2), ("c", True, float("nan")), ("c", True, None), ("b", False, None), ("b", False, 0.0)]
    df = spark.createDataFrame(rows, "g string, y boolean, s double")
    numbered, n = R.pure_numbered_groups(df, "g", "y")
    draws = GroupDraws(n, 20)
    w, position = all_weights(draws), {r["g"]: r["_g"] for r in numbered.collect()}
    for size in (1, 100):
        got = {r["rep"]: r["auc"] for r in R.auc_replicates(df, numbered, "g", "y", "s", draws, size).collect()}
        for rep in range(20):
            up, down = ([(-9.0 if s is None else 9.0 if s != s else s, w[position[g], rep]) for g, y, s in rows if y == side] for side in (True, False))
            wins = sum(a * b * (1 if s > t else 0.5 if s == t else 0) for s, a in up for t, b in down)
            total = sum(a for _, a in up) * sum(b for _, b in down)
            assert (rep in got) == (total > 0) and (total == 0 or abs(got[rep] - wins / total) < 1e-12)


def test_paired_tables_need_identical_rows(spark):
    a = spark.createDataFrame([(1, "g", True, 0.1), (2, "h", False, 0.2)], "row_id int, g string, y boolean, s double")
    assert sorted(map(tuple, evaluation.paired_tables(a, a, "row_id", "g", "y", "s").collect())) == [(1, "g", True, 0.1, 0.1), (2, "h", False, 0.2, 0.2)]
    for b, reason in ((a.where("row_id = 1"), "identical rows"), (a.union(a), "each row once"), (a.withColumn("y", ~F.col("y")), "equal groups and labels")):
        with pytest.raises(ValueError, match=reason):
            evaluation.paired_tables(a, b, "row_id", "g", "y", "s")


def test_effect_is_found_and_noise_is_not(scores):
    strong = evaluation.external(scores, "group_id", "y", "score", 200, 200).first()
    assert strong["auc"] > 0.9 and strong["p_value"] < 0.05 and strong["ci_lo"] > 0.5
    flat = evaluation.auc_permutation(scores, "group_id", "y", "flat", 200).first()
    assert flat["p_value"] > 0.01
    d = evaluation.paired_auc_difference(scores, "group_id", "y", "score", "flat", 200).first()
    assert d["difference"] > 0 and d["share_at_or_below_zero"] < 0.05
    same = evaluation.paired_auc_difference(scores, "group_id", "y", "score", "score", 50).first()
    assert same["difference"] == 0 and same["ci_lo"] == 0 == same["ci_hi"]


def test_mixed_groups_are_refused(spark):
    d = spark.createDataFrame([("a", True, 1.0), ("a", False, 2.0)], "group_id string, y boolean, score double")
    with pytest.raises(ValueError, match="label-pure"):
        evaluation.auc_interval(d, "group_id", "y", "score", 10)


def test_shuffled_labels_keep_counts(scores):
    numbered, n = R.pure_numbered_groups(scores, "group_id", "y")
    c = R.shuffled_labels(numbered, "y", 6, 1).groupBy("rep").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("p"), F.countDistinct("_g").alias("g")).collect()
    assert all((r["n"], r["p"], r["g"]) == (20, 10, 20) for r in c) and len(c) == 6


def test_label_metrics(spark):
    rows = [(f"g{i}", "abc"[i % 3], "abc"[i % 3] if j % 4 else "abc"[(i + 1) % 3]) for i in range(12) for j in range(10)]
    d = spark.createDataFrame(rows, "group_id string, y string, predicted string")
    m = metrics.multiclass_metrics(d, "y", "predicted").first()
    assert abs(m["balanced_accuracy"] - 0.7) < 1e-12 and abs(m["accuracy"] - 0.7) < 1e-12
    r = evaluation.external_labels(d, "group_id", "y", "predicted", 100, 100).first()
    assert r["p_value"] < 0.05 and r["ci_lo"] <= 0.7 <= r["ci_hi"]


def test_balanced_accuracy_ignores_classes_missing_from_truth(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b")], "y string, p string")
    assert metrics.multiclass_metrics(d, "y", "p").first()["balanced_accuracy"] == 0.75


def test_binary_metrics_of_an_empty_class(spark):
    d = spark.createDataFrame([(True, 0.1), (True, 0.2)], "y boolean, s double")
    r = metrics.binary_metrics(d, F.col("y"), F.col("s")).first()
    assert (r["precision"], r["f1"], r["specificity"], r["tp"], r["fn"]) == (0, 0, 0, 0, 2)


def test_icc(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(15), 8)
    v = rng.normal(size=15)[g] + 0.5 * rng.normal(size=120) + 1e6
    parts = [v[g == i] for i in range(15)]
    msb = sum(len(p) * (p.mean() - v.mean()) ** 2 for p in parts) / 14
    msw = sum(((p - p.mean()) ** 2).sum() for p in parts) / 105
    got = metrics.icc1(spark.createDataFrame(pd.DataFrame({"g": g, "v": v})), "g", "v").first()["icc"]
    assert abs(got - (msb - msw) / (msb + 7 * msw)) < 1e-6


def test_capture_decision_ties_go_to_the_first_class(spark):
    d = spark.createDataFrame([("c", "b", 0.5), ("c", "a", 0.5)], "capture string, cls string, p double")
    assert metrics.capture_decisions(d, "capture", "cls", "p").first()["predicted"] == "a"


def test_breakdown_and_strata(spark, table, scores):
    d = scores.withColumn("kind", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b"))
    pdf = d.toPandas()
    for r in ranks.auc_per_stratum(d, "score", F.col("y"), "kind").collect():
        part = pdf[(pdf["kind"] == r["kind"]) | ~pdf["y"]]
        assert abs(r["auc"] - auc(part["y"].to_numpy(), part["score"].to_numpy())) < 1e-12
    for r in experiments.rule_breakdown(d, "score", "y", "kind").collect():
        part = pdf[(pdf["kind"] == r["kind"]) | pdf["y"]]
        assert abs(r["auc"] - auc(part["y"].to_numpy(), part["score"].to_numpy())) < 1e-12


def test_poisson_bound():
    from sigspark.functions.stats import poisson_upper
    assert abs(poisson_upper(0) + np.log(0.05)) < 1e-9
    assert abs(poisson_upper(1) - 4.743865) < 1e-5 and abs(poisson_upper(10) - 16.96222) < 1e-4
    assert abs(poisson_upper(10 ** 8) - 100_016_450) < 20 and 1.6e5 < poisson_upper(10 ** 10) - 10 ** 10 < 1.7e5


def test_samples_give_the_intervals_and_differences_of_the_plain_calls(scores):
    samples = evaluation.auc_samples(scores, "group_id", "y", ["score", "flat"], 60)
    assert evaluation.sampled_interval(samples["flat"]).collect() == evaluation.auc_interval(scores, "group_id", "y", "flat", 60).collect()
    assert evaluation.sampled_difference(samples["score"], samples["flat"]).collect() == evaluation.paired_auc_difference(scores, "group_id", "y", "score", "flat", 60).collect()


def test_widening_reads_its_rows_twice(spark):
    """Once for the capped training rows, once for the test rows, whatever the number of variants."""
    seen = spark.sparkContext.accumulator(0)

    def counted(g):
        seen.add(1)
        return float(g % 2)
    r = spark.range(320).select(F.col("id").alias("row_id"), (F.col("id") % 40).alias("unit"), (F.col("id") % 2 == 0).alias("y"), F.concat(F.lit("d"), (F.floor(F.col("id") / 2) % 4).cast("string")).alias("dataset"))
    rows = r.withColumn("x", F.udf(counted, "double").asNondeterministic()("unit"))
    out = experiments.widen(rows, experiments.source_variants(["d0", "d1", "d2", "d3"], "d0", "d1", "d2", ["d3"]), "d0", "dataset", "row_id", ["x"], "y", "unit", 50, kind="tree", n_bootstrap=20).collect()
    assert len(out) == 4 and all(r["auc"] == 1 for r in out) and seen.value <= 2 * 320
