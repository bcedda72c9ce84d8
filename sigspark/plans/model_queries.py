"""Registered model and experiment queries. Boosted models have all their rounds; `evaluate_with_refits` refits few
times so that it stays cheap to check."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, ranks, splits
from . import evaluation, experiments
from .evidence_queries import _auc_once
from .signal_queries import vectors
from .tables import load, r6, scores

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FEATURES = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
BOOTSTRAPS, REFITS = 2000, 3


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as feature rows: group = supplier, label a noisy function of the features that is constant per supplier
    group half; partitions by supplier."""
    l = load(spark, sf_dir, "lineitem")
    return l.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_discount").alias("row_id"), F.col("l_suppkey").alias("unit"), *FEATURES,
                    (F.col("l_suppkey") % 2 == 0).alias("y"), F.concat(F.lit("fold"), (F.floor(F.col("l_suppkey") / 2) % 3).cast("string")).alias("partition"),
                    "l_returnflag", (F.col("l_suppkey") % 4).cast("string").alias("model"), F.year("l_shipdate").alias("year"),
                    F.when(F.col("l_suppkey") % 5 == 0, "a").otherwise("b").alias("dataset"))


def shifted(spark, sf_dir) -> DataFrame:
    """The same rows with a real effect: quantity depends on the label."""
    return lines(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("y"), 8.0).otherwise(0.0))


@register("model_tree")
def model_tree(spark, sf_dir):
    d = shifted(spark, sf_dir)
    s = models.fit("tree", d.where("partition <> 'fold0'"), FEATURES, "y").score(d.where("partition = 'fold0'"))
    return ranks.auc(s, "score", F.col("y")).withColumn("auc", r6(F.col("auc")))


@register("model_linear")
def model_linear(spark, sf_dir):
    d = shifted(spark, sf_dir)
    s = models.fit("linear", d.where("partition <> 'fold0'"), FEATURES, "y").score(d.where("partition = 'fold0'"))
    return ranks.auc(s, "score", F.col("y")).withColumn("auc", r6(F.col("auc")))


@register("model_gbm_out_of_fold")
def model_gbm_out_of_fold(spark, sf_dir):
    s = models.out_of_fold(shifted(spark, sf_dir), "partition", FEATURES, "y", "gbm")
    return ranks.auc(s, "score", F.col("y"), ["partition"]).withColumn("auc", r6(F.col("auc")))


@register("evaluate_with_refits")
def evaluate_with_refits(spark, sf_dir):
    return experiments.evaluate(shifted(spark, sf_dir), "partition", ["l_quantity"], "y", "unit", "tree", REFITS, BOOTSTRAPS)[0]


@register("cross_dataset")
def cross_dataset(spark, sf_dir):
    d = shifted(spark, sf_dir)
    return experiments.cross(d.where("dataset = 'b'"), d.where("dataset = 'a'"), FEATURES, "y", "unit", "gbm", n_permutations=BOOTSTRAPS, n_bootstrap=BOOTSTRAPS)["result"]


@register("within_dataset")
def within_dataset(spark, sf_dir):
    d = shifted(spark, sf_dir).select("unit", "y", *FEATURES)
    folds = splits.group_kfold(d, 3, "y", "unit")
    return experiments.within(d, folds, FEATURES, ["l_tax"], "y", "unit", "linear", BOOTSTRAPS)["versus_shortcut"]


@register("dataset_identification")
def dataset_identification(spark, sf_dir):
    return experiments.dataset_identification(lines(spark, sf_dir), FEATURES, "dataset", "unit", 3)


@register("shortcut_baseline")
def shortcut_baseline(spark, sf_dir):
    return experiments.shortcut_baseline(shifted(spark, sf_dir), ["l_quantity"], "y", "unit", 3, BOOTSTRAPS)


@register("held_out_identification")
def held_out_identification(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity") + F.col("model").cast("int") * 12)
    d = d.withColumn("capture", F.concat_ws("/", "unit", "year"))
    folds = [(F.col("unit") % 3 != k, F.col("unit") % 3 == k) for k in range(3)]
    return experiments.identification(d, folds, FEATURES, "model", "unit", "capture", "row_id", ["l_tax"], "tree", BOOTSTRAPS, BOOTSTRAPS)["result"]


@register("metadata_only")
def metadata_only(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 8).cast("string").alias("pack"), (F.col("s_nationkey") % 2).cast("string").alias("cls"), F.col("s_acctbal"), (F.col("s_nationkey") * 1.0).alias("nk"))
    return experiments.metadata_only(s, ["s_acctbal", "nk"], "cls", "pack")


@register("receiver_check")
def receiver_check(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("rx", F.when(F.col("l_returnflag") == "A", "u1").otherwise("u2"))
    return experiments.receiver_check(d, FEATURES, "unit", "rx", F.col("year") >= 1994, "tree", 3, BOOTSTRAPS)


@register("learning_curve")
def learning_curve(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity") + F.col("model").cast("int") * 12).withColumn("unit", F.col("unit") % 12)
    return experiments.learning_curve(d, ["l_quantity", "l_tax"], "model", "unit", "1", F.col("year") < 1996, F.col("year") >= 1996, [1, 2], 2, kind="tree")


@register("source_widening")
def source_widening(spark, sf_dir):
    d = shifted(spark, sf_dir).withColumn("dataset", F.concat(F.lit("d"), (F.floor(F.col("unit") / 2) % 4).cast("string")))
    variants = experiments.source_variants(["d0", "d1", "d2", "d3"], "d0", "d1", "d2", ["d3"])
    d = d.dropDuplicates(["row_id"])
    return experiments.widen(d, variants, "d0", "dataset", "row_id", FEATURES, "y", "unit", 2000, kind="tree", n_bootstrap=BOOTSTRAPS)


# ------------------------------------------------------------------ rules without fitting have exact SQL
@register("transfer_rule", """WITH tr AS (SELECT (user_id % 3 = 0)::INT AS y, value AS a, hour(ts) AS b, day(ts) AS c FROM events WHERE user_id % 2 = 0), te AS (SELECT (user_id % 3 = 0)::INT AS y, value AS a, hour(ts) AS b, day(ts) AS c FROM events WHERE user_id % 2 = 1),
""" + ", ".join(f"t{f} AS ({_auc_once('tr', f, 'y')}), e{f} AS ({_auc_once('te', f, 'y')})" for f in "abc") + """,
r AS (SELECT 'a' AS f, ta.auc AS train, ea.auc AS test FROM ta, ea UNION ALL SELECT 'b', tb.auc, eb.auc FROM tb, eb UNION ALL SELECT 'c', tc.auc, ec.auc FROM tc, ec)
SELECT f AS feature, CASE WHEN train >= 0.5 THEN 1 ELSE -1 END AS direction, round(train, 6) AS train_auc, round(CASE WHEN train >= 0.5 THEN test ELSE 1 - test END, 6) AS auc FROM r ORDER BY abs(train - 0.5) DESC, f LIMIT 1""")
def transfer_rule(spark, sf_dir):
    s = load(spark, sf_dir, "events").select(F.col("user_id").alias("g"), (F.col("user_id") % 3 == 0).alias("y"), F.col("value").alias("a"), F.hour("ts").alias("b"), F.dayofmonth("ts").alias("c"))
    out = experiments.transfer_rule(s.where("g % 2 = 0"), s.where("g % 2 = 1"), ["a", "b", "c"], "y", "g", BOOTSTRAPS, BOOTSTRAPS)
    return out.select("feature", "direction", r6(F.col("train_auc")).alias("train_auc"), r6(F.col("auc")).alias("auc"))


@register("rule_breakdown", """WITH p AS (SELECT value AS v FROM events WHERE user_id % 3 = 0), n AS (SELECT event_type AS stratum, value AS v FROM events WHERE user_id % 3 <> 0)
SELECT stratum, (SELECT count(*) FROM p) AS n_pos, (SELECT count(*) FROM n m WHERE m.stratum = n.stratum) AS n_neg, round(avg(((SELECT count(*) FROM p WHERE p.v > n.v) + 0.5 * (SELECT count(*) FROM p WHERE p.v = n.v)) / (SELECT count(*) FROM p))::DOUBLE, 6) AS auc FROM n GROUP BY stratum""")
def rule_breakdown(spark, sf_dir):
    out = experiments.rule_breakdown(scores(spark, sf_dir), "score", "y", "event_type")
    return out.select(F.col("event_type").alias("stratum"), "n_pos", "n_neg", r6(F.col("auc")).alias("auc"))


@register("against_baselines", """WITH s AS (SELECT (user_id % 3 = 0)::INT AS y, value AS d, hour(ts) AS p, day(ts) AS a, minute(ts) AS b FROM events),
""" + ", ".join(f"o{f} AS ({_auc_once('s', f, 'y')})" for f in "dpab") + """,
best AS (SELECT * FROM (SELECT 'a' AS f, auc FROM oa UNION ALL SELECT 'b', auc FROM ob) ORDER BY abs(auc - 0.5) DESC, f LIMIT 1)
SELECT 'power' AS baseline, 'p' AS feature, round(greatest(op.auc, 1 - op.auc), 6) AS baseline_auc, round(od.auc - greatest(op.auc, 1 - op.auc), 6) AS difference FROM od, op
UNION ALL SELECT 'best single feature', f, round(greatest(best.auc, 1 - best.auc), 6), round(od.auc - greatest(best.auc, 1 - best.auc), 6) FROM od, best""")
def against_baselines(spark, sf_dir):
    s = load(spark, sf_dir, "events").select(F.col("user_id").alias("g"), (F.col("user_id") % 3 == 0).alias("y"), F.col("value").alias("d"), F.hour("ts").alias("p"), F.dayofmonth("ts").alias("a"), F.minute("ts").alias("b"))
    out = experiments.against_baselines(s, "d", "p", ["a", "b"], "y", "g", BOOTSTRAPS)
    return out.select("baseline", "feature", r6(F.col("baseline_auc")).alias("baseline_auc"), r6(F.col("difference")).alias("difference"))


@register("train_test_report", """WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS side, (user_id % 3 = 0)::INT AS y, value / 490.0 AS v FROM events),
t AS (SELECT side, count(*) FILTER (y = 1 AND v >= 0.1) AS tp, count(*) FILTER (y = 0 AND v >= 0.1) AS fp, count(*) FILTER (y = 0 AND v < 0.1) AS tn, count(*) FILTER (y = 1 AND v < 0.1) AS fn FROM s GROUP BY 1)
SELECT side, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall FROM t""")
def train_test_report(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("score", F.col("score") / 490.0 + 0.4)
    out = experiments.train_test_report(s.where("group_id % 2 = 0"), s.where("group_id % 2 = 1"), "y", "score")
    return out.select("side", "tp", "fp", "tn", "fn", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("recall")).alias("recall"))


@register("alarm_report", """WITH f AS (SELECT user_id, (user_id % 3 = 0)::INT AS y, ts, event_id, (value > 60)::INT AS fl FROM events),
a AS (SELECT *, sum(fl) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS active FROM f),
p AS (SELECT user_id, max(y) AS y, count(*) AS n, count(*) FILTER (active AND NOT before) AS onsets FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM a) GROUP BY 1)
SELECT coalesce(sum(onsets) FILTER (y = 0), 0)::BIGINT AS false_onsets, sum(n) FILTER (y = 0)::BIGINT AS negative_seconds, round(avg((onsets > 0)::INT) FILTER (y = 1), 6) AS positive_recordings_alarmed,
  round(sum(onsets) FILTER (y = 0) / (sum(n) FILTER (y = 0) / 3600), 6) AS false_alarms_per_hour FROM p""")
def alarm_report(spark, sf_dir):
    s = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("user_id") % 3 == 0).alias("y"))
    out = experiments.alarm_report(s, "user_id", ["ts", "event_id"], "value", "y", 60)
    return out.select("false_onsets", "negative_seconds", r6(F.col("positive_recordings_alarmed")).alias("positive_recordings_alarmed"), r6(F.col("false_alarms_per_hour")).alias("false_alarms_per_hour"))


@register("one_class_report", """WITH t AS (SELECT quantile_cont(value, 0.95) AS t FROM events WHERE user_id % 3 = 0)
SELECT event_type, dayofweek(ts)::BIGINT AS band, count(*) AS n, round(avg((value > t)::INT), 6) AS share, round(any_value(t), 6) AS threshold FROM events, t WHERE user_id % 3 <> 0 GROUP BY 1, 2""")
def one_class_report(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "user_id", "value", (F.dayofweek("ts") - 1).cast("long").alias("band"))
    out = experiments.one_class_report(e.where("user_id % 3 <> 0"), e.where("user_id % 3 = 0"), "value", ["event_type", "band"])
    return out.select("event_type", "band", "n", r6(F.col("share")).alias("share"), r6(F.col("threshold")).alias("threshold"))


@register("decision_rules", f"""WITH s AS (SELECT (user_id % 3 = 0)::INT AS y, value AS v FROM events), o AS ({_auc_once('s', 'v', 'y')}) SELECT n_pos, n_neg, round(auc, 6) AS auc, auc > 0.5 AND auc > 0.9 AS strong FROM o""")
def decision_rules(spark, sf_dir):
    out = experiments.decisions(evaluation.external(scores(spark, sf_dir), "group_id", "y", "score", BOOTSTRAPS, BOOTSTRAPS))
    return out.select("n_pos", "n_neg", r6(F.col("auc")).alias("auc"), (F.col("transfers") & (F.col("auc") > 0.9)).alias("strong"))
