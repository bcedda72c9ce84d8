"""Registered queries over score, event and label tables, each with the SQL that defines its result."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..functions.stats import poisson_upper_95
from ..operators import metrics, profiles, ranks, sampling, sequences, splits
from ..operators import resampling as R
from ..operators.scan import ordered
from . import evaluation
from .tables import label_scores, load, r6, scores

BOOTSTRAPS = 2000
PERMUTATIONS = 2000
KEPT_USERS_FOLDS = 5

# ------------------------------------------------------------------ SQL fragments shared by the definitions
_SCORES = "s AS (SELECT event_id, user_id AS g, (user_id % 3 = 0)::INT AS y, value AS v FROM events)"
_GROUPS = "gr AS (SELECT g, y, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n_g FROM (SELECT DISTINCT g, y FROM s))"


def _draws(groups: str = "gr", reps: int = BOOTSTRAPS) -> str:
    """SQL repeating operators.replicates.picks, for up to BLOCK groups."""
    return f"""ng AS (SELECT count(*) AS n_g FROM {groups}),
dx AS (SELECT r.rep, n_g, slot, (r.rep % 2147483647 + 1) * 69621 % 2147483647 AS r
      FROM ng, (SELECT unnest(range({reps})) AS rep) r, (SELECT unnest(range((SELECT n_g FROM ng))) AS slot) j),
dh AS (SELECT rep, n_g, r, ((slot % 2147483647 + 1) * 48271 + slot // 2147483647 * 40692 % 2147483647 + r) % 2147483647 AS h FROM dx),
da AS (SELECT rep, n_g, r, h * (h + 16807) % 2147483647 AS a FROM dh),
db AS (SELECT rep, n_g, a * ((a + r) % 2147483647) % 2147483647 AS b FROM da),
draws AS (SELECT rep, ((b * (b + 12345) % 2147483647) * 2147483647 + b) % n_g AS k, count(*) AS w FROM db GROUP BY 1, 2)"""


def _auc_by_rep(value: str, name: str) -> str:
    """AUC per replicate from weighted rows (rep, value, wp, wn)."""
    return f"""{name} AS (SELECT rep, sum(wp * (coalesce(below, 0) + 0.5 * wn)) / (sum(wp) * sum(wn)) AS auc FROM (
  SELECT rep, {value} AS v, sum(wp)::DOUBLE AS wp, sum(wn)::DOUBLE AS wn,
         sum(sum(wn)) OVER (PARTITION BY rep ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS below
  FROM weighted GROUP BY rep, {value}) GROUP BY rep HAVING sum(wp) > 0 AND sum(wn) > 0)"""


def _auc_once(source: str, value: str, y: str, alias: str = "auc") -> str:
    return f"""SELECT sum(p * (coalesce(below, 0) + 0.5 * n)) / (sum(p) * sum(n)) AS {alias}, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM (
  SELECT {value} AS v, sum({y})::DOUBLE AS p, sum(1 - {y})::DOUBLE AS n,
         sum(sum(1 - {y})) OVER (ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS below
  FROM {source} GROUP BY {value})"""


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return add


# ------------------------------------------------------------------ resampling
@register("group_auc_bootstrap", f"""WITH {_SCORES}, {_GROUPS}, {_draws()},
weighted AS (SELECT d.rep, s.v, d.w * s.y AS wp, d.w * (1 - s.y) AS wn FROM s JOIN gr USING (g, y) JOIN draws d USING (k)),
{_auc_by_rep('v', 'reps')}, obs AS ({_auc_once('s', 'v', 'y')})
SELECT n_pos, n_neg, round(obs.auc, 6) AS auc, round(quantile_cont(reps.auc, 0.025), 6) AS ci_lo,
       round(quantile_cont(reps.auc, 0.975), 6) AS ci_hi, count(*) AS n_replicates FROM obs, reps GROUP BY ALL""")
def group_auc_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.auc_interval(scores(spark, sf_dir), "group_id", "y", "score", BOOTSTRAPS)
    return out.select("n_pos", "n_neg", *[r6(F.col(c)).alias(c) for c in ("auc", "ci_lo", "ci_hi")], "n_replicates")


@register("group_auc_permutation", f"""WITH {_SCORES}, {_GROUPS},
dealt AS (SELECT r.rep, (k + r.rep + 1) % n_g AS k, y FROM gr, (SELECT unnest(range({PERMUTATIONS})) AS rep) r),
weighted AS (SELECT d.rep, s.v, d.y AS wp, 1 - d.y AS wn FROM s JOIN gr USING (g) JOIN dealt d ON d.k = gr.k),
{_auc_by_rep('v', 'reps')}, obs AS ({_auc_once('s', 'v', 'y')})
SELECT round(obs.auc, 6) AS observed, count(*) AS n, round((1 + count(*) FILTER (reps.auc >= obs.auc)) / (1.0 + count(*))::DOUBLE, 6) AS p_value,
  round(quantile_cont(reps.auc, 0.5), 6) AS null_median, round(quantile_cont(reps.auc, 0.95), 6) AS null_95th FROM obs, reps GROUP BY obs.auc""")
def group_auc_permutation(spark, sf_dir):
    s = scores(spark, sf_dir)
    dealt = R.rotations(R.pure_numbered_groups(s, "group_id", "y")[0], "y", PERMUTATIONS)
    out = evaluation.auc_permutation(s, "group_id", "y", "score", PERMUTATIONS, relabelled=dealt)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("observed", "p_value", "null_median", "null_95th")])


@register("paired_auc_difference", f"""WITH s AS (SELECT user_id AS g, (user_id % 3 = 0)::INT AS y, value AS a, hour(ts) AS b FROM events),
{_GROUPS}, {_draws()},
weighted AS (SELECT d.rep, s.a, s.b, d.w * s.y AS wp, d.w * (1 - s.y) AS wn FROM s JOIN gr USING (g, y) JOIN draws d USING (k)),
{_auc_by_rep('a', 'ra')}, {_auc_by_rep('b', 'rb')}, oa AS ({_auc_once('s', 'a', 'y')}), ob AS ({_auc_once('s', 'b', 'y')})
SELECT round(oa.auc - ob.auc, 6) AS difference, round(quantile_cont(ra.auc - rb.auc, 0.025), 6) AS ci_lo,
  round(quantile_cont(ra.auc - rb.auc, 0.975), 6) AS ci_hi,
  round(avg(CASE WHEN ra.auc - rb.auc <= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_at_or_below_zero
FROM oa, ob, ra JOIN rb USING (rep) GROUP BY oa.auc, ob.auc""")
def paired_auc_difference(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("hour", F.hour("ts"))
    out = evaluation.paired_auc_difference(s, "group_id", "y", "score", "hour", BOOTSTRAPS)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


_LABELLED = """s AS (SELECT d.doc_id, d.source || '/' || l.quality::VARCHAR AS g, l.quality AS y, (d.n_chars > 500)::INT AS p,
  (length(d.text) % 2)::INT AS q, l.toxic FROM documents d JOIN labels l USING (doc_id))"""


def _ba_by_rep(pred: str, name: str) -> str:
    return f"""{name} AS (SELECT rep, avg(rec) AS ba FROM (SELECT d.rep, s.y, sum(d.w * (s.y = s.{pred})::INT)::DOUBLE / sum(d.w) AS rec
  FROM s JOIN gr USING (g) JOIN draws d USING (k) GROUP BY 1, 2) GROUP BY rep)"""


def _ba_once(pred: str) -> str:
    return f"SELECT avg(rec) AS ba, sum(n)::BIGINT AS n FROM (SELECT y, avg((y = {pred})::INT) AS rec, count(*) AS n FROM s GROUP BY y)"


@register("balanced_accuracy_by_group", f"""WITH {_LABELLED}, {_GROUPS}, {_draws()}, {_ba_by_rep('p', 'reps')}, obs AS ({_ba_once('p')})
SELECT n, round(obs.ba, 6) AS balanced_accuracy, round(quantile_cont(reps.ba, 0.025), 6) AS ci_lo,
  round(quantile_cont(reps.ba, 0.975), 6) AS ci_hi, count(*) AS n_replicates FROM obs, reps GROUP BY n, obs.ba""")
def balanced_accuracy_by_group(spark, sf_dir):
    out = evaluation.labels_interval(label_scores(spark, sf_dir), "group_id", "truth", "predicted", BOOTSTRAPS)
    return out.select("n", "n_replicates", *[r6(F.col(c)).alias(c) for c in ("balanced_accuracy", "ci_lo", "ci_hi")])


@register("balanced_accuracy_permutation", f"""WITH {_LABELLED}, {_GROUPS},
dealt AS (SELECT r.rep, (k + r.rep + 1) % n_g AS k, y FROM gr, (SELECT unnest(range({PERMUTATIONS})) AS rep) r),
reps AS (SELECT rep, avg(rec) AS ba FROM (SELECT d.rep, d.y, avg((d.y = s.p)::INT) AS rec FROM s JOIN gr USING (g) JOIN dealt d ON d.k = gr.k GROUP BY 1, 2) GROUP BY rep),
obs AS ({_ba_once('p')})
SELECT round(obs.ba, 6) AS observed, count(*) AS n, round((1 + count(*) FILTER (round(reps.ba, 12) >= round(obs.ba, 12))) / (1.0 + count(*))::DOUBLE, 6) AS p_value,
  round(quantile_cont(reps.ba, 0.5), 6) AS null_median, round(quantile_cont(reps.ba, 0.95), 6) AS null_95th FROM obs, reps GROUP BY obs.ba""")
def balanced_accuracy_permutation(spark, sf_dir):
    s = label_scores(spark, sf_dir)
    dealt = R.rotations(R.pure_numbered_groups(s, "group_id", "truth")[0], "truth", PERMUTATIONS)
    out = evaluation.labels_permutation(s, "group_id", "truth", "predicted", PERMUTATIONS, relabelled=dealt)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("observed", "p_value", "null_median", "null_95th")])


@register("paired_label_difference", f"""WITH {_LABELLED}, {_GROUPS}, {_draws()}, {_ba_by_rep('p', 'ra')}, {_ba_by_rep('q', 'rb')},
oa AS ({_ba_once('p')}), ob AS ({_ba_once('q')})
SELECT round(oa.ba - ob.ba, 6) AS difference, round(quantile_cont(ra.ba - rb.ba, 0.025), 6) AS ci_lo, round(quantile_cont(ra.ba - rb.ba, 0.975), 6) AS ci_hi,
  round(avg(CASE WHEN ra.ba - rb.ba <= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_at_or_below_zero FROM oa, ob, ra JOIN rb USING (rep) GROUP BY oa.ba, ob.ba""")
def paired_label_difference(spark, sf_dir):
    out = evaluation.paired_label_difference(label_scores(spark, sf_dir), "group_id", "truth", "predicted", "other", BOOTSTRAPS)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@register("subset_auc_interval", f"""WITH s AS (SELECT user_id AS g, (user_id % 3 = 0)::INT AS y, value AS v FROM events WHERE event_type <> 'purchase' OR user_id % 3 = 0),
{_GROUPS}, {_draws()},
weighted AS (SELECT d.rep, s.v, d.w * s.y AS wp, d.w * (1 - s.y) AS wn FROM s JOIN gr USING (g, y) JOIN draws d USING (k)),
{_auc_by_rep('v', 'reps')}, obs AS ({_auc_once('s', 'v', 'y')})
SELECT n_pos, n_neg, round(obs.auc, 6) AS auc, round(quantile_cont(reps.auc, 0.025), 6) AS ci_lo,
       round(quantile_cont(reps.auc, 0.975), 6) AS ci_hi, count(*) AS n_replicates FROM obs, reps GROUP BY ALL""")
def subset_auc_interval(spark, sf_dir):
    keep = (F.col("event_type") != "purchase") | F.col("y")
    out = evaluation.subset_auc(scores(spark, sf_dir), "group_id", "y", "score", keep, BOOTSTRAPS)
    return out.select("n_pos", "n_neg", *[r6(F.col(c)).alias(c) for c in ("auc", "ci_lo", "ci_hi")], "n_replicates")


_TRAIN_THRESHOLD = "thr AS (SELECT quantile_cont(value, 0.95) AS t FROM events WHERE user_id % 3 <> 0 AND user_id % 2 = 0)"


@register("operating_point", f"""WITH {_TRAIN_THRESHOLD}, s AS (SELECT user_id AS g, 0 AS y, (value > t)::INT AS f FROM events, thr WHERE user_id % 3 <> 0 AND user_id % 2 = 1),
{_GROUPS}, {_draws()},
reps AS (SELECT rep, sum(w * f)::DOUBLE / sum(w) AS rate FROM s JOIN gr USING (g) JOIN draws USING (k) GROUP BY rep)
SELECT round((SELECT t FROM thr), 6) AS threshold, round((SELECT avg(f) FROM s), 6) AS rate, round(quantile_cont(rate, 0.025), 6) AS ci_lo,
  round(quantile_cont(rate, 0.975), 6) AS ci_hi, count(*) AS n_replicates FROM reps""")
def operating_point(spark, sf_dir):
    s = scores(spark, sf_dir)
    train = s.where(~F.col("y") & (F.col("group_id") % 2 == 0))
    test = s.where(~F.col("y") & (F.col("group_id") % 2 == 1))
    threshold = ranks.exact_quantiles(train, "score", {"threshold": 0.95}).first()["threshold"]      # one number
    out = evaluation.rate_interval(test, "group_id", F.col("score") > threshold, BOOTSTRAPS)
    return out.select(r6(F.lit(threshold)).alias("threshold"), *[r6(F.col(c)).alias(c) for c in ("rate", "ci_lo", "ci_hi")], "n_replicates")


# ------------------------------------------------------------------ ranks and metrics
@register("auc_by_event_type", """WITH s AS (SELECT event_type, value AS v, (user_id % 3 = 0)::INT AS y FROM events),
c AS (SELECT event_type, v, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n, sum(sum(1 - y)) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS b FROM s GROUP BY 1, 2)
SELECT event_type, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, round(sum(p * (coalesce(b, 0) + 0.5 * n)) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY 1""")
def auc_by_event_type(spark, sf_dir):
    out = ranks.auc(scores(spark, sf_dir), "score", F.col("y"), ["event_type"])
    return out.select("event_type", "n_pos", "n_neg", r6(F.col("auc")).alias("auc"))


@register("auc_per_stratum", """WITH pos AS (SELECT event_type AS stratum, value AS v, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2),
neg AS (SELECT value AS v, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1),
cum AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n AS below FROM neg),
u AS (SELECT pos.stratum, pos.n, (SELECT coalesce(sum(n), 0) FROM neg WHERE neg.v < pos.v) + 0.5 * coalesce((SELECT n FROM neg WHERE neg.v = pos.v), 0) AS wins FROM pos)
SELECT stratum, sum(n)::BIGINT AS n_pos, (SELECT sum(n) FROM neg)::BIGINT AS n_neg, round((sum(n * wins) / (sum(n) * (SELECT sum(n) FROM neg)))::DOUBLE, 6) AS auc FROM u GROUP BY stratum""")
def auc_per_stratum(spark, sf_dir):
    out = ranks.auc_per_stratum(scores(spark, sf_dir), "score", F.col("y"), "event_type")
    return out.select(F.col("event_type").alias("stratum"), "n_pos", "n_neg", r6(F.col("auc")).alias("auc"))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("best_single_feature", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS v, (l_returnflag = 'R')::INT AS y FROM lineitem" for f in _FEATURES) + """),
c AS (SELECT feature, v, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n, sum(sum(1 - y)) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS b FROM l GROUP BY 1, 2),
a AS (SELECT feature, sum(p * (coalesce(b, 0) + 0.5 * n)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1)
SELECT feature, round(auc, 6) AS auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM a ORDER BY abs(auc - 0.5) DESC, feature LIMIT 1""")
def best_single_feature(spark, sf_dir):
    aucs = ranks.auc_by_feature(load(spark, sf_dir, "lineitem"), _FEATURES, F.col("l_returnflag") == "R")
    return ranks.best_single_feature(aucs).select("feature", r6(F.col("auc")).alias("auc"), "direction")


@register("spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a::DOUBLE, b::DOUBLE), 6) AS spearman FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    out = ranks.spearman(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", r6(F.col("spearman")).alias("spearman"))


@register("exact_quantiles", """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1""")
def exact_quantiles(spark, sf_dir):
    out = ranks.exact_quantiles(load(spark, sf_dir, "events"), "value", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, ["event_type"])
    return out.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("q05", "q50", "q95")])


@register("binary_metrics", """WITH t AS (SELECT count(*) FILTER (toxic = 1 AND quality >= 0.5) AS tp, count(*) FILTER (toxic = 0 AND quality >= 0.5) AS fp,
  count(*) FILTER (toxic = 0 AND quality < 0.5) AS tn, count(*) FILTER (toxic = 1 AND quality < 0.5) AS fn FROM labels)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(greatest(tp + fn, tn + fp) / (tp + fp + tn + fn), 6) AS majority_accuracy FROM t""")
def binary_metrics(spark, sf_dir):
    out = metrics.binary_metrics(load(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality"))
    return out.select("tp", "fp", "tn", "fn", *[r6(F.col(c)).alias(c) for c in out.columns[4:]])


@register("confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(load(spark, sf_dir, "labels"), "quality", "toxic")


@register("confusion_matrix", """SELECT lang, count(*) FILTER (source_lang = 'de') AS de, count(*) FILTER (source_lang = 'en') AS en,
  count(*) FILTER (source_lang = 'es') AS es, count(*) FILTER (source_lang = 'fr') AS fr
FROM (SELECT lang, CASE n_chars % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS source_lang FROM documents) GROUP BY 1""")
def confusion_matrix(spark, sf_dir):
    names = F.array(*[F.lit(v) for v in ("de", "en", "es", "fr")])
    d = load(spark, sf_dir, "documents").withColumn("guess", F.element_at(names, (F.col("n_chars") % 4 + 1).cast("int")))
    return metrics.confusion_matrix(d, "lang", "guess", ["de", "en", "es", "fr"])


@register("multiclass_metrics", """WITH s AS (SELECT lang AS y, CASE n_chars % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS p FROM documents),
c AS (SELECT y, count(*) AS n, count(*) FILTER (y = p) AS hit FROM s GROUP BY 1), m AS (SELECT p, count(*) AS m FROM s GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n), 6) AS balanced_accuracy, round(avg(2 * hit / (n + coalesce(m, 0))), 6) AS macro_f1,
  round(max(n) / sum(n), 6) AS majority_accuracy FROM c LEFT JOIN m ON c.y = m.p""")
def multiclass_metrics(spark, sf_dir):
    names = F.array(*[F.lit(v) for v in ("de", "en", "es", "fr")])
    d = load(spark, sf_dir, "documents").withColumn("guess", F.element_at(names, (F.col("n_chars") % 4 + 1).cast("int")))
    out = metrics.multiclass_metrics(d, "lang", "guess")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


@register("class_recall", "SELECT quality AS class, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS recall FROM labels GROUP BY 1")
def class_recall(spark, sf_dir):
    return metrics.per_class(load(spark, sf_dir, "labels"), "quality", "toxic").select("class", "n", r6(F.col("recall")).alias("recall"))


@register("icc1", """WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * v) AS ssw, (SELECT avg(value) FROM events) AS grand FROM g),
b AS (SELECT sum(g.n * (m - grand) * (m - grand)) AS ssb FROM g, t)
SELECT k AS groups, n::BIGINT AS n, round((ssb / (k - 1) - ssw / (n - k)) / (ssb / (k - 1) + (n / k - 1) * ssw / (n - k)), 6) AS icc FROM t, b""")
def icc1(spark, sf_dir):
    return metrics.icc1(load(spark, sf_dir, "events"), "user_id", "value").select("groups", "n", r6(F.col("icc")).alias("icc"))


@register("recording_means", """SELECT user_id, count(*) AS n, round(avg(value), 6) AS score, (user_id % 3 = 0) AS y, user_id % 50 AS grp FROM events GROUP BY user_id""")
def recording_means(spark, sf_dir):
    s = load(spark, sf_dir, "events").select("user_id", F.col("value").alias("score"), (F.col("user_id") % 3 == 0).alias("y"), (F.col("user_id") % 50).alias("grp"))
    return metrics.recording_means(s, "user_id", "score", "y", "grp").withColumn("score", r6(F.col("score")))


@register("capture_decisions", """WITH p AS (SELECT l_orderkey, l_shipmode AS c, avg(v) AS p FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, l_discount AS v FROM lineitem) GROUP BY 1, 2)
SELECT l_orderkey, predicted, round(p, 6) AS p FROM (SELECT l_orderkey, c AS predicted, p, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(p, 9) DESC, c) AS rn FROM p) WHERE rn = 1""")
def capture_decisions(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    # the mean is rounded before the argmax so that equal means stay equal on any engine
    means = l.groupBy("l_orderkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("p"))
    out = metrics.capture_decisions(means, "l_orderkey", "l_returnflag", "p")
    return out.select("l_orderkey", "predicted", r6(F.col("p")).alias("p"))


@register("flag_share", """SELECT event_type, dayofweek(ts) AS band, count(*) AS n, round(avg((value > 100)::INT), 6) AS share FROM events GROUP BY 1, 2""")
def flag_share(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("band", (F.dayofweek("ts") - 1).cast("long"))
    return metrics.flag_share(e, ["event_type", "band"], F.col("value"), 100).withColumn("share", r6(F.col("share")))


# ------------------------------------------------------------------ splits
@register("group_kfold", """WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN 'true' ELSE 'false' END AS stratum FROM events GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, user_id) AS rn FROM g),
f AS (SELECT stratum, 0::BIGINT AS rn, NULL::BIGINT AS user_id, 0::BIGINT AS n, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load FROM (SELECT DISTINCT stratum FROM g)
  UNION ALL SELECT o.stratum, o.rn, o.user_id, o.n, list_position(f.load, list_min(f.load)) - 1,
    [CASE WHEN i = list_position(f.load, list_min(f.load)) THEN f.load[i] + o.n ELSE f.load[i] END for i in [1, 2, 3, 4, 5]]
  FROM f JOIN o ON o.stratum = f.stratum AND o.rn = f.rn + 1)
SELECT user_id, stratum, n, fold::INT AS fold FROM f WHERE rn > 0""")
def group_kfold(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("y", F.col("user_id") % 3 == 0)
    return splits.group_kfold(e, KEPT_USERS_FOLDS, "y", "user_id")


@register("leakage_groups", """WITH a AS (SELECT event_id, user_id, weekofyear(ts) % 2 AS p FROM events)
SELECT 'group spans partitions' AS rule, user_id::VARCHAR AS entity_id, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS detail FROM a GROUP BY user_id HAVING count(DISTINCT p) > 1
UNION ALL SELECT 'unknown capture', o_orderkey::VARCHAR, '' FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)""")
def leakage_groups(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    assignment = e.select("event_id", (F.weekofyear("ts") % 2).cast("string").alias("partition"))
    strangers = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("0").alias("partition"))
    known = strangers.join(e.select("event_id"), "event_id", "left_anti")
    return splits.leakage_problems(e, assignment.unionByName(known), "user_id", "event_id")


@register("feasibility", """WITH e AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END AS label FROM events WHERE value > 20),
g AS (SELECT user_id, string_agg(DISTINCT coalesce(label, 'None'), '|' ORDER BY coalesce(label, 'None')) AS stratum FROM e GROUP BY 1)
SELECT stratum, count(*) AS n_groups FROM g WHERE stratum <> 'None' GROUP BY 1""")
def feasibility(spark, sf_dir):
    t = F.col("event_type")
    label = F.when(t.isin("click", "view"), None).otherwise(t == "purchase")
    return splits.feasibility(load(spark, sf_dir, "events").where("value > 20").withColumn("label", label), "label", "user_id")


@register("split_digest", """WITH l AS (SELECT substr(sha256(event_id::VARCHAR), 1, 3) AS b, event_id::VARCHAR || chr(9) || 'fold' || (user_id % 5)::VARCHAR AS line FROM events),
h AS (SELECT b, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY 1)
SELECT sum(n)::BIGINT AS captures, 1 AS levels, sha256(string_agg(b || chr(9) || h, chr(10) ORDER BY b)) AS assignment_sha256 FROM h""")
def split_digest(spark, sf_dir):
    a = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("fold"), F.col("user_id") % 5).alias("partition"))
    return splits.block_digest(a, "event_id")


@register("sorted_round_robin", """SELECT user_id, 'fold' || ((row_number() OVER (ORDER BY user_id) - 1) % 5)::VARCHAR AS partition FROM (SELECT DISTINCT user_id FROM events)""")
def sorted_round_robin(spark, sf_dir):
    return splits.sorted_round_robin(load(spark, sf_dir, "events"), "user_id", 5)


@register("leave_one_group_out", """WITH p AS (SELECT DISTINCT lang, source FROM documents), k AS (SELECT lang FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT 'without ' || source AS fold, source, lang FROM p JOIN k USING (lang)""")
def leave_one_group_out(spark, sf_dir):
    return splits.leave_one_group_out(load(spark, sf_dir, "documents"), "source", "lang")


@register("designed_folds", """WITH e AS (SELECT event_id, 'd' || least(3, 1 + day(ts) // 10)::VARCHAR AS day, CASE WHEN user_id % 2 = 0 THEN 'u1' ELSE 'u2' END AS rx FROM events),
f AS (SELECT 'first day to second' AS fold, CASE WHEN day = 'd1' THEN 'train' WHEN day = 'd2' AND rx = 'u2' THEN 'test' END AS role FROM e
UNION ALL SELECT 'first day to third', CASE WHEN day = 'd1' THEN 'train' WHEN day = 'd3' AND rx = 'u2' THEN 'test' END FROM e
UNION ALL SELECT 'receiver to receiver', CASE WHEN day = 'd2' AND rx = 'u2' THEN 'train' WHEN day = 'd2' AND rx = 'u1' THEN 'test' END FROM e)
SELECT fold, role, count(*) AS n FROM f WHERE role IS NOT NULL GROUP BY 1, 2""")
def designed_folds(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.select("event_id", F.concat(F.lit("d"), F.least(F.lit(3), 1 + F.floor(F.dayofmonth("ts") / 10)).cast("string")).alias("day"),
                    F.when(F.col("user_id") % 2 == 0, "u1").otherwise("u2").alias("rx"))
    return splits.designed_folds(rows, splits.day_receiver_folds()).groupBy("fold", "role").agg(F.count("*").alias("n"))


@register("partition_label_counts", """SELECT 'fold' || (user_id % 5)::VARCHAR AS partition, CASE WHEN event_type = 'error' THEN 'None' WHEN user_id % 3 = 0 THEN 'true' ELSE 'false' END AS label, count(*) AS n FROM events GROUP BY 1, 2""")
def partition_label_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("fold"), F.col("user_id") % 5).alias("partition"),
                                             F.when(F.col("event_type") != "error", F.col("user_id") % 3 == 0).alias("y"))
    return splits.counts_by_partition_label(e, "y")


@register("groups_per_label", "SELECT (user_id % 3 = 0) AS y, count(DISTINCT user_id) AS n_groups FROM events GROUP BY 1")
def groups_per_label(spark, sf_dir):
    return metrics.groups_per_label(scores(spark, sf_dir), "group_id", "y")


# ------------------------------------------------------------------ sequences
@register("time_blocks", """WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM l)
SELECT user_id, block::BIGINT AS block, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY 1, 2""")
def time_blocks(spark, sf_dir):
    return sequences.time_blocks(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600)


_ALARMS = """f AS (SELECT user_id, ts, event_id, (value > 100)::INT AS fl FROM events),
a AS (SELECT *, sum(fl) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS active FROM f),
o AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS onset FROM a)"""


@register("kofn_onsets", f"WITH {_ALARMS} SELECT user_id, count(*) AS n, sum(fl)::BIGINT AS flags, sum(onset::INT)::BIGINT AS onsets FROM o GROUP BY 1")
def kofn_onsets(spark, sf_dir):
    rows = sequences.alarms(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], F.col("value") > 100)
    return sequences.alarm_summary(rows, ["user_id"])


@register("kofn_onsets_many_ranges", f"WITH {_ALARMS} SELECT user_id, count(*) AS n, sum(fl)::BIGINT AS flags, sum(onset::INT)::BIGINT AS onsets FROM o GROUP BY 1")
def kofn_onsets_many_ranges(spark, sf_dir):
    """The same scan cut into ranges of 500 rows, as a table far larger than a range would be."""
    rows = sequences.alarms(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], F.col("value") > 100, target_rows=500)
    return sequences.alarm_summary(rows, ["user_id"])


@register("alarm_rate", f"""WITH {_ALARMS}, p AS (SELECT user_id, sum(onset::INT)::BIGINT AS onsets, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS hours FROM o GROUP BY 1)
SELECT user_id, onsets, round(hours, 6) AS hours, round(CASE WHEN hours > 0 THEN onsets / hours END, 6) AS per_hour,
  round(CASE WHEN onsets = 0 AND hours > 0 THEN -ln(0.05) / hours END, 6) AS zero_onsets_upper95 FROM p""")
def alarm_rate(spark, sf_dir):
    rows = sequences.alarms(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], F.col("value") > 100)
    p = rows.groupBy("user_id").agg(F.sum(F.col("onset").cast("int")).alias("onsets"), ((micros(F.max("ts")) - micros(F.min("ts"))) / 3.6e9).alias("hours"))
    hours = F.when(F.col("hours") > 0, F.col("hours"))
    upper = poisson_upper_95(F.col("onsets")) / hours
    return p.select("user_id", "onsets", r6(F.col("hours")).alias("hours"), r6(F.col("onsets") / hours).alias("per_hour"),
                    r6(F.when(F.col("onsets") == 0, upper)).alias("zero_onsets_upper95"))


@register("alarm_budget", """WITH RECURSIVE f AS (SELECT event_type, ts, event_id, (value > 100)::INT AS hot FROM events),
n AS (SELECT *, sum(hot) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS active FROM f),
o AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY event_type ORDER BY ts, event_id), false) AS onset FROM n),
p AS (SELECT event_type, sum(onset::INT)::BIGINT AS onsets, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS hours FROM o GROUP BY 1),
b AS (SELECT event_type, onsets, hours, onsets::DOUBLE AS lo, onsets + 10 + 10 * sqrt(onsets + 1) AS hi, 0 AS step FROM p
  UNION ALL SELECT event_type, onsets, hours, CASE WHEN c > 0.05 THEN mid ELSE lo END, CASE WHEN c > 0.05 THEN hi ELSE mid END, step + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, onsets + 1), lambda i: exp(i * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(i + 1)))) AS c FROM b WHERE step < 60))
SELECT event_type, onsets, round(onsets / hours, 6) AS per_hour, round(lo / hours, 6) AS per_hour_upper95 FROM b WHERE step = 60""")
def alarm_budget(spark, sf_dir):
    """One-sided 95 % Poisson bound of the onset rate of every event type, at any count."""
    e = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    rows = sequences.alarms(e, ["event_type"], ["ts", "event_id"], F.col("value") > 100)
    p = rows.groupBy("event_type").agg(F.sum(F.col("onset").cast("int")).alias("onsets"), ((micros(F.max("ts")) - micros(F.min("ts"))) / 3.6e9).alias("hours"))
    return p.select("event_type", "onsets", r6(F.col("onsets") / F.col("hours")).alias("per_hour"), r6(poisson_upper_95("onsets") / F.col("hours")).alias("per_hour_upper95"))


@register("interval_union_occupancy", """WITH i AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 1800000000 AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT user_id, count(*) AS n, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::BIGINT AS covered FROM m GROUP BY 1""")
def interval_union_occupancy(spark, sf_dir):
    i = load(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("a")).withColumn("b", F.col("a") + 1800000000)
    return sequences.interval_union(i, ["user_id"], "a", "b", "event_id")


@register("start_intervals", """WITH l AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, count(*) AS n, round(avg(gap) / 1e6, 4) AS interval_mean, round(CASE WHEN count(gap) > 1 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 6) AS interval_cv FROM l GROUP BY 1""")
def start_intervals(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("t"))
    out = sequences.start_intervals(e, ["user_id"], "t", "event_id")
    return out.select("user_id", "n", F.round(F.col("interval_mean") / 1e6, 4).alias("interval_mean"), r6(F.col("interval_cv")).alias("interval_cv"))


@register("gapfree_runs", """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM d),
x AS (SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM r GROUP BY l_orderkey, i)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS run, first, last, n FROM x""")
def gapfree_runs(spark, sf_dir):
    return sequences.runs(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@register("missing_numbers", """WITH m AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey, unnest(range(1, m + 1))::INT AS missing FROM m)
SELECT l_orderkey, missing FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = a.l_orderkey AND l.l_linenumber = a.missing)""")
def missing_numbers(spark, sf_dir):
    return sequences.missing_numbers(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@register("consecutive_check", """SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS complete FROM lineitem GROUP BY 1""")
def consecutive_check(spark, sf_dir):
    return sequences.consecutive_check(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@register("role_transitions", """WITH l AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, count(*) AS n, sum(CASE WHEN p <> role THEN 1 ELSE 0 END)::BIGINT AS changes FROM l GROUP BY 1""")
def role_transitions(spark, sf_dir):
    return sequences.transitions(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@register("value_runs", """WITH l AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT user_id, run::BIGINT AS run, min(event_type) AS value, min(ts) AS start, count(*) AS n FROM b GROUP BY 1, 2""")
def value_runs(spark, sf_dir):
    return sequences.value_runs(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))


@register("zero_runs", """WITH z AS (SELECT l_suppkey, l_orderkey, (CASE WHEN l_discount < 0.08 THEN 0 ELSE 1 END) AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax, l_discount) AS i FROM lineitem),
r AS (SELECT l_suppkey, i, i - row_number() OVER (PARTITION BY l_suppkey ORDER BY i) AS k FROM z WHERE x = 0)
SELECT l_suppkey, min(i) AS start, count(*) AS n FROM r GROUP BY l_suppkey, k HAVING count(*) >= 8""")
def zero_runs(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount"]
    from ..operators.scan import ordered
    samples = ordered(l, ["l_suppkey"], order).row_number("i").frame().withColumn("x", F.when(F.col("l_discount") < 0.08, 0).otherwise(1))
    return sequences.zero_runs(samples, ["l_suppkey"], "i", "x", 8)


@register("mean_abs_step", """WITH l AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events)
SELECT user_id, round(avg(d), 9) AS mean_step FROM l GROUP BY 1""")
def mean_abs_step(spark, sf_dir):
    return sequences.mean_abs_step(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("mean_step", F.round("mean_step", 9))


@register("part_index", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS part_index FROM events""")
def part_index(spark, sf_dir):
    return sequences.part_index(load(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@register("boundary_steps", """WITH l AS (SELECT event_type, i, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY i)) AS step FROM
  (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)),
q AS (SELECT event_type, quantile_cont(step, 0.99) AS p99, quantile_cont(step, 0.5) AS med FROM l WHERE step IS NOT NULL AND i % 25 <> 0 GROUP BY 1)
SELECT event_type, count(*) AS boundaries, round(avg((step > p99)::INT), 6) AS share_above_p99, round(quantile_cont(step, 0.5) / any_value(med), 6) AS ratio
FROM l JOIN q USING (event_type) WHERE step IS NOT NULL AND i % 25 = 0 GROUP BY 1""")
def boundary_steps(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id")
    samples = sequences.part_index(e, ["event_type"], ["ts", "event_id"])
    out = sequences.boundary_steps(samples, ["event_type"], "part_index", "value", 25)
    return out.select("event_type", "boundaries", r6(F.col("share_above_p99")).alias("share_above_p99"), r6(F.col("ratio")).alias("ratio"))


@register("file_continuity", """WITH f AS (SELECT event_type, day(ts) AS d, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, arg_min(value, event_id) AS x, arg_max(value, event_id) AS y, stddev_pop(value) AS sd FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(b) OVER w AS pb, lag(y) OVER w AS py, lag(sd) OVER w AS psd FROM f WINDOW w AS (PARTITION BY event_type ORDER BY d))
SELECT event_type, d::INT AS d, a < pb AS overlaps, round(CASE WHEN psd > 0 THEN abs(x - py) / psd END, 6) AS jump_over_step FROM l WHERE pb IS NOT NULL""")
def file_continuity(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    files = e.groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(
        micros(F.min("ts")).alias("a"), micros(F.max("ts")).alias("b"), F.min_by("value", "event_id").alias("x"), F.max_by("value", "event_id").alias("y"), F.stddev_pop("value").alias("sd"))
    out = sequences.file_continuity(files, ["event_type"], "d", "a", "b", "x", "y", "sd")
    return out.withColumn("jump_over_step", r6(F.col("jump_over_step")))


# ------------------------------------------------------------------ samples
@register("capped_sample", """SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 48271) % 2147483647, event_id) AS rn FROM events) WHERE rn <= 20""")
def capped_sample(spark, sf_dir):
    return sampling.capped_sample(load(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 20, order=(F.col("event_id") * 48271) % 2147483647)


@register("running_quota", """SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE coalesce(b, 0) < 200""")
def running_quota(spark, sf_dir):
    return sampling.running_quota(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 200).drop("ts")


@register("first_loud_rows", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value > 20) WHERE rn <= 10""")
def first_loud_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("value > 20").select("user_id", "event_id", "ts")
    return sampling.first_n(e, ["user_id"], [F.col("ts"), F.col("event_id")], 10).drop("ts")


def _training_draws(k: int, draws: int) -> str:
    """SQL repeating operators.sampling.training_draws: k picks, each moved past what is taken."""
    p, steps, state = 2147483647, [], "u0"
    for j in range(k):
        steps.append(f"""h{j} AS (SELECT *, ((own * 1024 + {j}) % {p} + 1) * 48271 % {p} + (own * 1024 + {j}) // {p} * 40692 % {p} + r AS hx FROM {state}),
a{j} AS (SELECT *, (hx % {p}) * (hx % {p} + 16807) % {p} AS ax FROM h{j}), b{j} AS (SELECT *, ax * ((ax + r) % {p}) % {p} AS bx FROM a{j}),
u{j + 1} AS (SELECT held_out, own, draw, r, n, list_append(taken, list_reduce(list_prepend(((bx * (bx + 12345) % {p}) * {p} + bx) % (n - {j + 1}), list_sort(taken)), lambda x, t: x + (t <= x)::BIGINT)) AS taken FROM b{j})""")
        state = f"u{j + 1}"
    return f"""WITH s AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
u0 AS (SELECT l_suppkey AS held_out, pos AS own, d.draw::INT AS draw, ({k * 1009} + d.draw * 65537 + 1) * 69621 % {p} AS r, n, [pos] AS taken FROM s, (SELECT unnest(range({draws})) AS draw) d),
{", ".join(steps)}
SELECT held_out, draw, s.l_suppkey FROM (SELECT held_out, draw, unnest(taken[2:]) AS pos FROM {state}) JOIN s USING (pos)"""


@register("training_draws", _training_draws(4, 5))
def training_draws(spark, sf_dir):
    """Five draws of four training suppliers for every held-out supplier of the events-by-supplier design."""
    s = load(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    return sampling.training_draws(s, s, "l_suppkey", 4, 5)


# ------------------------------------------------------------------ profiles
@register("bin_medians", """SELECT event_type, bin, n, round(median, 6) AS median FROM (SELECT event_type, day(ts) AS bin, count(*) AS n, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1, 2) WHERE n >= 5""")
def bin_medians(spark, sf_dir):
    out = profiles.bin_medians(load(spark, sf_dir, "events"), F.dayofmonth("ts").cast("long"), "value", ["event_type"])
    return out.withColumn("median", r6(F.col("median")))


@register("window_rms_profile", """WITH w AS (SELECT event_type, i // 20 AS win, sqrt(avg(value * value)) AS rms FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1, 2)
SELECT event_type, count(*) AS windows, round(min(rms), 6) AS rms_min, round(quantile_cont(rms, 0.5), 6) AS rms_median, round(quantile_cont(rms, 0.9), 6) AS rms_p90,
  round(max(rms), 6) AS rms_max, arg_min(win, rms) AS quietest, arg_max(win, rms) AS loudest FROM w GROUP BY 1""")
def window_rms_profile(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id")
    samples = sequences.part_index(e, ["event_type"], ["ts", "event_id"])
    out = profiles.rms_profile(profiles.window_rms(samples, ["event_type"], "part_index", F.col("value"), 20), ["event_type"])
    return out.select("event_type", "windows", *[r6(F.col(c)).alias(c) for c in ("rms_min", "rms_median", "rms_p90", "rms_max")], "quietest", "loudest")


@register("active_share", """WITH w AS (SELECT user_id % 10 AS cap, user_id, avg(value * value) AS power FROM events GROUP BY 1, 2), f AS (SELECT cap, quantile_cont(power, 0.05) AS floor FROM w GROUP BY 1)
SELECT cap, round(floor, 6) AS floor, count(*) AS n, round(avg((power > floor * 10)::INT), 6) AS active_share, round(10 * log10(avg(power) FILTER (power > floor * 10) / floor), 6) AS snr_db FROM w JOIN f USING (cap) GROUP BY cap, floor""")
def active_share(spark, sf_dir):
    w = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("cap"), "user_id").agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    out = profiles.active_share(w, ["cap"])
    return out.select("cap", "n", *[r6(F.col(c)).alias(c) for c in ("floor", "active_share", "snr_db")])


@register("levels_after_trigger", """SELECT o_orderpriority, (o_orderkey - 5000) // 2500 AS band, count(*) AS n, round(sqrt(avg(o_totalprice * o_totalprice)), 4) AS rms, round(100 * avg((o_totalprice <= 10000 OR o_totalprice >= 400000)::INT), 6) AS clipped_percent
FROM orders WHERE o_orderkey >= 5000 GROUP BY 1, 2""")
def levels_after_trigger(spark, sf_dir):
    out = profiles.levels_after_trigger(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", 5000, 2500, (10000, 400000))
    return out.withColumns({"rms": F.round("rms", 4), "clipped_percent": r6(F.col("clipped_percent"))})


@register("identical_channels", """WITH s AS (SELECT l_returnflag AS k, 'a' AS ch, l_orderkey AS pos, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'b', l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_quantity END FROM lineitem)
SELECT k, 2::BIGINT AS channels, 'a' AS first_channel FROM (SELECT DISTINCT k FROM s) WHERE k <> 'R'""")
def identical_channels(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_orderkey").alias("pos"), "l_quantity", "l_tax")
    a = l.select("k", F.lit("a").alias("ch"), "pos", F.col("l_quantity").alias("x"))
    b = l.select("k", F.lit("b").alias("ch"), "pos", F.when(F.col("k") == "R", F.col("l_tax")).otherwise(F.col("l_quantity")).alias("x"))
    return profiles.identical_channels(a.unionByName(b), ["k"], "ch", "pos", "x")


@register("official_split", """SELECT doc_id AS capture_id, lang AS partition FROM documents WHERE lang NOT IN ('es', 'de')""")
def official_split(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture_id"), F.when(F.col("lang") == "de", None).when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("official_split"))
    return splits.official(d)


@register("row_subsets", """WITH e AS (SELECT event_type, user_id % 3 = 0 AS y, value FROM events WHERE value < 400)
SELECT 'one positive kind' AS subset, count(*) AS n FROM e WHERE event_type = 'view' OR NOT y UNION ALL SELECT 'one negative kind', count(*) FROM e WHERE event_type = 'view' OR y UNION ALL SELECT 'labelled', count(*) FROM events WHERE event_type <> 'error'""")
def row_subsets(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("y", F.when(F.col("event_type") != "error", F.col("user_id") % 3 == 0)).withColumn("p", F.col("user_id") % 3 == 0)
    view, clean = F.col("event_type") == "view", F.col("value") < 400
    keep = {"one positive kind": clean & (view | ~F.col("p")), "one negative kind": clean & (view | F.col("p")), "labelled": F.col("y").isNotNull()}
    # one pass: every row names the subsets it is in
    member = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in keep.items()]), lambda s: s.isNotNull())
    return e.select(F.explode(member).alias("subset")).groupBy("subset").agg(F.count("*").alias("n"))


@register("stratified_folds", """SELECT fold, event_type, count(*) AS n FROM (SELECT event_type, ((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 5)::INT AS fold FROM events) GROUP BY 1, 2""")
def stratified_folds(spark, sf_dir):
    out = splits.stratified_kfold(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", ["event_type"], 5)
    return out.groupBy("fold", "event_type").agg(F.count("*").alias("n"))


@register("trigger_levels", """SELECT o_orderpriority, round(avg((o_totalprice <= 10000 OR o_totalprice >= 400000)::INT), 6) AS clip_fraction,
  round(log10(sqrt(avg(o_totalprice * o_totalprice) FILTER (o_orderkey < 5000)) + 1e-9), 6) AS log_rms_pre_trigger,
  round(log10(sqrt(avg(o_totalprice * o_totalprice) FILTER (o_orderkey >= 5000)) + 1e-9), 6) AS log_rms_post_trigger FROM orders GROUP BY 1""")
def trigger_levels(spark, sf_dir):
    out = profiles.trigger_levels(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", 5000, (10000, 400000))
    return out.select("o_orderpriority", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


# ------------------------------------------------------------------ keys and ids that are hard to cut
@register("scan_with_null_key", """SELECT event_id, row_number() OVER w AS rn, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total, lag(value, 2) OVER w AS two_back
FROM (SELECT *, CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS kind FROM events) WINDOW w AS (PARTITION BY kind ORDER BY ts, event_id)""")
def scan_with_null_key(spark, sf_dir):
    """Two event types without a name are one key, which holds the largest part of the rows."""
    e = load(spark, sf_dir, "events").withColumn("kind", F.when(~F.col("event_type").isin("click", "view"), F.col("event_type")))
    scan = ordered(e, ["kind"], ["ts", "event_id"]).lag({"two_back": ("value", 2)}).running({"total": (F.sum, F.col("value"))}).row_number("rn")
    return scan.frame().select("event_id", "rn", F.round("total", 4).alias("total"), "two_back")


@register("quantiles_with_null_key", """SELECT CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS kind, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid
FROM events GROUP BY 1""")
def quantiles_with_null_key(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("kind", F.when(~F.col("event_type").isin("click", "view"), F.col("event_type")))
    return ranks.exact_quantiles(e, "value", {"low": 0.05, "mid": 0.5}, ["kind"]).select("kind", "n", r6(F.col("low")).alias("low"), r6(F.col("mid")).alias("mid"))


@register("positions_of_prefixed_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY 'an-archive-of-captures/site-1/' || o_orderkey::VARCHAR) - 1 AS _g FROM orders")
def positions_of_prefixed_ids(spark, sf_dir):
    """Sorted positions of ids that begin alike: ranges are cut by the whole id."""
    ids = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("an-archive-of-captures/site-1/"), F.col("o_orderkey").cast("string")).alias("id"))
    return R.numbered_groups(ids, "id").select("o_orderkey", "_g")
