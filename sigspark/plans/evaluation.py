"""Evaluations: one metric over pooled scores, its group-bootstrap interval and its group-permutation test.

Inputs are score tables; labels are label-pure per group. ``draws`` and ``relabelled`` choose the random source, see
``operators.replicates``; neither is a table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, metrics, ranks
from ..operators import resampling as R
from ..operators.replicates import GroupDraws, GroupShuffles, Rotations
from ..session import cut_lineage


def _groups(scores: DataFrame, group: str, label: str) -> tuple[DataFrame, int]:
    return R.pure_numbered_groups(scores, group, label)


def auc_interval(scores: DataFrame, group: str, label: str, score: str, n_bootstrap: int = 2000,
                 draws: GroupDraws | None = None) -> DataFrame:
    """(n_pos, n_neg, auc, ci_lo, ci_hi, n_replicates)."""
    numbered, n = _groups(scores, group, label)
    reps = R.auc_replicates(scores, numbered, group, label, score, draws or GroupDraws(n, n_bootstrap))
    observed = ranks.auc(scores, score, F.col(label).cast("boolean"))
    return observed.join(F.broadcast(R.interval(reps, "auc")))


def auc_samples(scores: DataFrame, group: str, label: str, columns: list[str], n_bootstrap: int = 2000) -> dict[str, tuple[DataFrame, DataFrame]]:
    """score column -> (observed AUC, its replicates), all on the same draws: groups are numbered once, and the replicates of a column are
    made once, however many intervals and differences are taken from them."""
    numbered, n = _groups(scores, group, label)
    y = F.col(label).cast("boolean")
    return {c: (ranks.auc(scores, c, y), cut_lineage(R.auc_replicates(scores, numbered, group, label, c, GroupDraws(n, n_bootstrap)))) for c in columns}


def sampled_interval(sample: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``auc_interval`` of one of ``auc_samples``."""
    observed, reps = sample
    return observed.join(F.broadcast(R.interval(reps, "auc")))


def sampled_difference(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``paired_auc_difference`` of two of ``auc_samples``."""
    observed = a[0].select(F.col("auc").alias("x")).join(F.broadcast(b[0].select(F.col("auc").alias("z")))).select((F.col("x") - F.col("z")).alias("difference"))
    return observed.join(F.broadcast(R.difference_summary(a[1], b[1], "auc")))


def auc_permutation(scores: DataFrame, group: str, label: str, score: str, n_permutations: int = 2000, seed: int = 0,
                    relabelled: GroupShuffles | Rotations | None = None) -> DataFrame:
    """(observed, n, p_value, null_median, null_95th): labels permuted between groups, scores fixed."""
    numbered, _ = _groups(scores, group, label)
    source = relabelled or R.shuffles(numbered, label, n_permutations, seed)
    null = R.auc_replicates(scores, numbered, group, label, score, source)
    observed = ranks.auc(scores, score, F.col(label).cast("boolean")).select("auc")
    return R.permutation_summary(null, "auc", observed)


def external(scores: DataFrame, group: str, label: str, score: str, n_permutations: int = 2000, n_bootstrap: int = 2000,
             seed: int = 0) -> DataFrame:
    """A fixed model on an external test set: AUC, interval, permutation test in one row."""
    numbered, n = _groups(scores, group, label)
    placed = R.placed_counts(scores, numbered, group, label, score)             # groups, their counts and the AUC serve both
    observed = cut_lineage(ranks.auc(scores, score, F.col(label).cast("boolean")))
    reps, null = (R.auc_replicates(scores, numbered, group, label, score, source, placed=placed)
                  for source in (GroupDraws(n, n_bootstrap), R.shuffles(numbered, label, n_permutations, seed)))
    p = R.permutation_summary(null, "auc", observed.select("auc")).select("p_value", "null_median", "null_95th")
    return observed.join(F.broadcast(R.interval(reps, "auc"))).join(F.broadcast(p))


def subset_auc(scores: DataFrame, group: str, label: str, score: str, keep, n_bootstrap: int = 2000) -> DataFrame:
    return auc_interval(scores.where(keep), group, label, score, n_bootstrap)


def paired_auc_difference(scores: DataFrame, group: str, label: str, a: str, b: str, n_bootstrap: int = 2000,
                          draws: GroupDraws | None = None) -> DataFrame:
    """(difference, ci_lo, ci_hi, share_at_or_below_zero): AUC(a) - AUC(b) on identical rows and draws."""
    numbered, n = _groups(scores, group, label)
    draws = draws or GroupDraws(n, n_bootstrap)
    summary = R.difference_summary(*[R.auc_replicates(scores, numbered, group, label, s, draws) for s in (a, b)], "auc")
    y = F.col(label).cast("boolean")
    observed = (ranks.auc(scores, a, y).select(F.col("auc").alias("x"))
                .join(F.broadcast(ranks.auc(scores, b, y).select(F.col("auc").alias("z"))))
                .select((F.col("x") - F.col("z")).alias("difference")))
    return observed.join(F.broadcast(summary))


def labels_interval(scores: DataFrame, group: str, truth: str, predicted: str, n_bootstrap: int = 2000,
                    draws: GroupDraws | None = None) -> DataFrame:
    """(n, balanced_accuracy, ci_lo, ci_hi, n_replicates)."""
    numbered, n = _groups(scores, group, truth)
    counts = R.label_counts(scores, group, truth, predicted)
    reps = R.balanced_accuracy_replicates(counts, numbered, group, truth, predicted, draws or GroupDraws(n, n_bootstrap))
    observed = metrics.multiclass_metrics(scores, truth, predicted).select("n", "balanced_accuracy")
    return observed.join(F.broadcast(R.interval(reps, "balanced_accuracy")))


def labels_permutation(scores: DataFrame, group: str, truth: str, predicted: str, n_permutations: int = 2000, seed: int = 0,
                       relabelled: GroupShuffles | Rotations | None = None) -> DataFrame:
    numbered, _ = _groups(scores, group, truth)
    counts = R.label_counts(scores, group, truth, predicted)
    null = R.permuted_balanced_accuracy(counts, numbered, group, truth, predicted, relabelled or R.shuffles(numbered, truth, n_permutations, seed))
    observed = metrics.multiclass_metrics(scores, truth, predicted).select("balanced_accuracy")
    return R.permutation_summary(null, "balanced_accuracy", observed)


def external_labels(scores: DataFrame, group: str, truth: str, predicted: str, n_permutations: int = 2000,
                    n_bootstrap: int = 2000, seed: int = 0) -> DataFrame:
    """Multi-class external test: balanced accuracy with interval and permutation test."""
    ci = labels_interval(scores, group, truth, predicted, n_bootstrap)
    p = labels_permutation(scores, group, truth, predicted, n_permutations, seed).select("p_value", "null_median", "null_95th")
    return ci.join(F.broadcast(p))


def paired_tables(a: DataFrame, b: DataFrame, row_id: str, group: str, label: str, score: str) -> DataFrame:
    """(row_id, group, label, a, b): two detectors' score tables as one, for the paired comparisons.

    Both must hold each row once, the same rows, and agree on group and label of each; anything else is an error, since a
    difference over unlike rows is none.
    """
    for table in (a, b):
        if table.groupBy(row_id).count().where("count > 1").limit(1).count():
            raise ValueError("paired comparison needs each row once")
    both = joins.paired_rows(a.select(row_id, group, label, F.col(score).alias("a")),
                             b.select(row_id, F.col(group).alias("_group"), F.col(label).alias("_label"), F.col(score).alias("b")), row_id)
    if both.where(~(F.col(group).eqNullSafe(F.col("_group")) & F.col(label).eqNullSafe(F.col("_label")))).limit(1).count():
        raise ValueError("paired comparison needs equal groups and labels of a row")
    return both.drop("_group", "_label")


def paired_label_difference(scores: DataFrame, group: str, truth: str, a: str, b: str, n_bootstrap: int = 2000,
                            draws: GroupDraws | None = None) -> DataFrame:
    numbered, n = _groups(scores, group, truth)
    draws = draws or GroupDraws(n, n_bootstrap)
    reps = [R.balanced_accuracy_replicates(R.label_counts(scores, group, truth, p), numbered, group, truth, p, draws) for p in (a, b)]
    observed = [metrics.multiclass_metrics(scores, truth, p).select(F.col("balanced_accuracy").alias(n)) for p, n in ((a, "x"), (b, "z"))]
    difference = observed[0].join(F.broadcast(observed[1])).select((F.col("x") - F.col("z")).alias("difference"))
    return difference.join(F.broadcast(R.difference_summary(*reps, "balanced_accuracy")))


def rate_interval(rows: DataFrame, group: str, flagged, n_bootstrap: int = 2000, draws: GroupDraws | None = None) -> DataFrame:
    """(rate, ci_lo, ci_hi, n_replicates): share of flagged rows, groups resampled."""
    numbered, n = R.pure_numbered_groups(rows.withColumn("_one", F.lit(1)), group, "_one")
    observed = rows.agg(F.avg(F.when(flagged, 1.0).otherwise(0.0)).alias("rate"))
    return observed.join(F.broadcast(R.interval(R.rate_replicates(rows, numbered, group, flagged, draws or GroupDraws(n, n_bootstrap)), "rate")))
