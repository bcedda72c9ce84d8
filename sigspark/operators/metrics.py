"""Decision and label metrics as plain aggregates over score tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio


def confusion(df: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """Long confusion table (keys, truth, predicted, n)."""
    return df.groupBy(*keys, truth, predicted).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, classes).count().fillna(0)


def binary_metrics(df: DataFrame, truth: Column, score: Column, threshold: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """Metrics of the decision ``score >= threshold``; ratios of an empty class are 0."""
    y, p = truth.cast("boolean"), score >= threshold
    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))
    t = df.groupBy(*keys).agg(count(y & p).alias("tp"), count(~y & p).alias("fp"), count(~y & ~p).alias("tn"), count(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    recall, specificity, precision = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp), safe_ratio(tp, tp + fp)
    return t.select(*keys, "tp", "fp", "tn", "fn", ((tp + tn) / n).alias("accuracy"),
                    ((recall + specificity) / 2).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
                    specificity.alias("specificity"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    (F.greatest(tp + fn, tn + fp) / n).alias("majority_accuracy"))


def per_class(df: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """(keys, class, n, recall, precision, f1) over the classes present in the truth; precision and F1 are 0 when the
    class is never predicted."""
    keys = list(keys)
    cells = confusion(df, truth, predicted, keys)
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    by_truth = cells.groupBy(*keys, F.col(truth).alias("class")).agg(F.sum("n").alias("n"), hit.alias("hit"))
    by_pred = cells.groupBy(*keys, F.col(predicted).alias("class")).agg(F.sum("n").alias("m"))
    j = by_truth.join(by_pred, [*keys, "class"], "left")
    m = F.coalesce("m", F.lit(0))
    return j.select(*keys, "class", "n", (F.col("hit") / F.col("n")).alias("recall"), safe_ratio(F.col("hit"), m).alias("precision"),
                    safe_ratio(2 * F.col("hit"), F.col("n") + m).alias("f1"), "hit")


def multiclass_metrics(df: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over classes present in the truth), macro F1, majority accuracy."""
    c = per_class(df, truth, predicted, keys)
    return c.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), (F.max("n") / F.sum("n")).alias("majority_accuracy"))


def groups_per_label(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.select(group, label).distinct().groupBy(label).agg(F.count("*").alias("n_groups"))


def icc1(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way random-effects intraclass correlation. Within-group squares come from each group's own variance, not
    from a difference of large sums."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
              F.sum(F.col("n") * F.col("m")).alias("s"))
    # the between-group squares need the grand mean: one row, joined back to the per-group rows
    ssb = (g.join(F.broadcast(t.select((F.col("s") / F.col("n")).alias("grand"))))
           .agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb")))
    msb, msw, k = F.col("ssb") / (F.col("groups") - 1), F.col("ssw") / (F.col("n") - F.col("groups")), F.col("n") / F.col("groups")
    return (t.join(F.broadcast(ssb)).select("groups", "n", ((msb - msw) / (msb + (k - 1) * msw)).alias("icc")))


def recording_means(df: DataFrame, recording: str, score: str, label: str, group: str) -> DataFrame:
    """One row per recording: mean score, its label and group (constant within a recording)."""
    return df.groupBy(recording).agg(F.avg(score).alias(score), F.min(label).alias(label), F.min(group).alias(group), F.count("*").alias("n"))


def capture_decisions(probabilities: DataFrame, capture: str, cls: str, p: str) -> DataFrame:
    """Mean class probability per capture, then the largest; ties go to the smallest class name."""
    means = probabilities.groupBy(capture, cls).agg(F.avg(p).alias("p"))
    return (means.groupBy(capture).agg(F.min(F.struct((-F.col("p")).alias("q"), F.col(cls).alias("c"))).alias("b"))
            .select(capture, F.col("b.c").alias("predicted"), (-F.col("b.q")).alias("p")))


def flag_share(df: DataFrame, keys: list[str], score: Column, threshold: Column | float) -> DataFrame:
    """Share of rows strictly above a threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(score > limit, 1.0).otherwise(0.0)).alias("share"))
