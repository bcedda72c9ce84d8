"""Classifiers by name. All fits are pyspark.ml estimators, so training is distributed; class weights are balanced.

tree    depth-3 tree, leaves of at least 20 rows
linear  standardised logistic regression, unit penalty
gbm     boosted depth-3 trees, step 0.05, 200 rounds; missing values are imputed and flagged

A boosting round passes over all rows once a level, and trees see no more of a row than the bin of each value. Rows of a cell
(equal bins) are therefore merged before boosting into points that carry the rows' weights, so the passes are bounded by the
number of cells, not rows, where features are few.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .catalog import union_all
from .ranks import exact_quantiles

KINDS = ("tree", "linear", "gbm")
GBM_ROUNDS = 200
BINS, LEAF_ROWS = 32, 20
CUT_ROWS = 40_000               # rows that bins are cut from; the estimator would take 10 000
POINTS_A_TASK = 100_000
JOBS = 3                        # boosted models fitted at a time: a round is three short jobs
_DONE = "_features", "rawPrediction", "probability", "prediction", "_y", "_weight"


def class_list(df: DataFrame, label: str) -> list:
    """Sorted class names (a handful)."""
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())


def class_counts(df: DataFrame, label: str) -> dict:
    """Class name -> rows, in name order."""
    found = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect()       # a handful
    return dict(sorted((r[0], r[1]) for r in found))


def balanced_weights(df: DataFrame, label: str, counts: dict) -> DataFrame:
    """Add ``_weight`` = n / (classes * n_class) and ``_y``, the class position."""
    n, weight, index = sum(counts.values()), F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, (c, own) in enumerate(counts.items()):
        weight = F.when(F.col(label) == F.lit(c), n / (len(counts) * own)).otherwise(weight)
        index = F.when(F.col(label) == F.lit(c), float(i)).otherwise(index)
    return df.withColumn("_weight", weight).withColumn("_y", index)


@dataclass
class Preparation:
    """Column transforms learned on the training side only."""

    features: list[str]
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    fill: dict[str, float] = field(default_factory=dict)
    cuts: dict[str, list[float]] = field(default_factory=dict)

    @staticmethod
    def learn(kind: str, train: DataFrame, features: list[str], share: float = 1.0, seed: int = 0) -> "Preparation":
        """``train`` has ``_weight`` for "gbm", whose bins are cut from this share of the rows."""
        p = Preparation(features)
        if kind == "linear":
            row = train.select(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
            p.centre = {c: row[f"m_{c}"] or 0.0 for c in features}
            p.scale = {c: row[f"s_{c}"] or 1.0 for c in features}
        elif kind == "gbm":
            missing = train.select(*[F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(c) for c in features]).first()
            for c in features:
                if missing[c]:
                    clean = train.where(~F.isnan(F.col(c).cast("double")))
                    found = exact_quantiles(clean, c, {"m": 0.5}).first()
                    p.fill[c] = found["m"] if found and found["m"] is not None else 0.0
            ready, names = p.columns(train)
            some = np.array((ready.sample(share, seed) if share < 1 else ready).select(*names, "_weight").collect(), float).reshape(-1, len(names) + 1)
            p.cuts = {c: _cuts(some[:, i], some[:, -1]) for i, c in enumerate(names)}
        return p

    def columns(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows with the transformed columns, and their names."""
        columns = []
        for c in self.features:
            x = F.col(c).cast("double")
            if c in self.fill:
                gone = x.isNull() | F.isnan(x)
                columns += [F.when(gone, F.lit(float(self.fill[c]))).otherwise(x).alias(f"_f_{c}"), gone.cast("double").alias(f"_g_{c}")]
            elif self.scale:
                columns.append(((x - self.centre[c]) / self.scale[c]).alias(f"_f_{c}"))
            else:
                columns.append(x.alias(f"_f_{c}"))
        inner = df.select("*", *columns)
        names = [c for c in inner.columns if c not in df.columns]
        if self.cuts:
            bins = [f"_b{c}" for c in names]
            inner = Bucketizer(inputCols=names, outputCols=bins, splitsArray=[[-np.inf, *self.cuts[c], np.inf] for c in names]).transform(inner).drop(*names)
            inner, names = inner.withColumns({b: F.col(b).cast("byte") for b in bins}), bins        # numbers; the column it made is marked as categories
        return inner, names

    def apply(self, df: DataFrame) -> DataFrame:
        inner, names = self.columns(df)
        return VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="error").transform(inner).drop(*names)


def _cuts(values: np.ndarray, weights: np.ndarray) -> list[float]:
    """Points between neighbouring values, or those that leave about equal weight in each bin if there are more values than bins."""
    found, at = np.unique(values, return_inverse=True)
    last = np.arange(len(found) - 1)                            # of each bin
    if len(found) > BINS:
        below = np.cumsum(np.bincount(at, weights))
        wanted = below[-1] * np.arange(1, BINS) / BINS
        last = np.searchsorted(below, wanted).clip(1, len(found) - 1)
        last = np.unique(np.where(wanted - below[last - 1] < below[last] - wanted, last - 1, last))     # the nearest, as the estimator does
        last = last[last < len(found) - 1]
    low, high = found[last], found[last + 1]
    middle = low / 2 + high / 2
    cuts = np.unique(np.where(middle > low, middle, high))
    return [float(c) for c in cuts[np.isfinite(cuts)]] or [float(found[0]) if len(found) and np.isfinite(found[0]) else 0.0]


def merged(binned: DataFrame, names: list[str], counts: dict) -> DataFrame:
    """Cells (equal bins) with ``points``, an array of (_y, _weight, n): n points of that weight stand for a class's rows.

    Together the points have the weight of the rows. A cell of fewer than ``LEAF_ROWS`` rows has a point for each, another at
    least that many; so of any cells, points are too few for a leaf exactly when rows are.
    """
    cells = binned.groupBy(*names).agg(*[F.count_if(F.col("_y") == float(i)).alias(f"_n{i}") for i in range(len(counts))], F.count("*").alias("_n"))
    points = []
    for i, own in enumerate(counts.values()):
        rows = F.col(f"_n{i}")
        k = F.when(F.col("_n") < LEAF_ROWS, rows).otherwise(F.ceil(rows * LEAF_ROWS / F.col("_n"))).cast("int")
        weight = rows * (sum(counts.values()) / (len(counts) * own)) / F.greatest(k, F.lit(1))
        points.append(F.struct(F.lit(float(i)).alias("_y"), weight.alias("_weight"), k.alias("n")))
    return cells.select(*names, F.filter(F.array(*points), lambda p: p["n"] > 0).alias("points"))


def _boost(kept: DataFrame, weighted: DataFrame, preparation: Preparation, counts: dict, rounds: int, seed: int) -> list:
    context = kept.sparkSession.sparkContext
    if context.getCheckpointDir() is None:                      # a round's errors build on those before it; without it their lineage only grows
        context.setCheckpointDir(shared_dir(kept.sparkSession))
    binned, names = preparation.columns(weighted)
    cells = merged(binned, names, counts).persist()
    try:
        n = cells.agg(F.sum(F.aggregate("points", F.lit(0), lambda a, p: a + p["n"]))).first()[0]
        kept.unpersist()                                        # the cells stand for it from here on
        points = cells.repartition(-(-n // POINTS_A_TASK)).select(*names, F.inline("points")).select(*names, "_y", "_weight", F.explode(F.sequence(F.lit(1), "n")))
        ready = VectorAssembler(inputCols=names, outputCol="_features").transform(points).select("_features", "_y", "_weight")
        gbt = GBTClassifier(maxDepth=3, stepSize=0.05, maxIter=rounds, maxBins=BINS, minInstancesPerNode=LEAF_ROWS, seed=seed, featuresCol="_features", labelCol="_y", weightCol="_weight")
        if len(counts) == 2:
            return [gbt.fit(ready)]
        return [gbt.fit(ready.withColumn("_y", (F.col("_y") == float(i)).cast("double"))) for i in range(len(counts))]
    finally:
        cells.unpersist()


@dataclass
class Fitted:
    kind: str
    classes: list
    preparation: Preparation
    parts: list

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Rows plus ``probabilities``, an array in class order."""
        ready = self.preparation.apply(df)
        if len(self.parts) == 1:
            out = self.parts[0].transform(ready).withColumn("probabilities", vector_to_array("probability"))
            return out.drop(*_DONE)
        for i, part in enumerate(self.parts):                   # one against the rest
            ready = part.transform(ready).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        raw = F.array(*[F.col(f"_p{i}") for i in range(len(self.parts))])
        total = sum((F.col(f"_p{i}") for i in range(1, len(self.parts))), F.col("_p0"))
        return ready.withColumn("probabilities", F.transform(raw, lambda p: p / total)).drop("_features", *[f"_p{i}" for i in range(len(self.parts))])

    def score(self, df: DataFrame, output: str = "score") -> DataFrame:
        """P(last class) for two classes; use for True of (False, True)."""
        return self.probabilities(df).withColumn(output, F.element_at("probabilities", -1)).drop("probabilities")

    def predict(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        """The most probable class; ties go to the first class."""
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return self.probabilities(df).withColumn(output, F.element_at(names, best)).drop("probabilities")


def fit(kind: str, train: DataFrame, features: list[str], label: str, rounds: int = GBM_ROUNDS, seed: int = 0, counts: dict | None = None) -> Fitted:
    """``counts``: rows of each class in ``train``, if the caller knows them.

    The source is read once. What is kept are the plain columns, a fraction of the size of vectors; every pass of the estimator
    makes its vectors from them.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    kept = train.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label])).persist()
    try:
        counts = class_counts(kept, label) if counts is None else counts
        classes = list(counts)
        if len(classes) < 2:
            raise ValueError("training side has one class")
        weighted = balanced_weights(kept, label, counts)
        p = Preparation.learn(kind, weighted, features, CUT_ROWS / sum(counts.values()), seed)
        if kind == "gbm":
            return Fitted(kind, classes, p, _boost(kept, weighted, p, counts, rounds, seed))
        ready = p.apply(weighted).select("_features", "_y", "_weight")
        common = {"featuresCol": "_features", "labelCol": "_y", "weightCol": "_weight"}
        if kind == "tree":
            parts = [DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=LEAF_ROWS, seed=seed, **common).fit(ready)]
        else:
            total = ready.agg(F.sum("_weight")).first()[0]
            parts = [LogisticRegression(regParam=1.0 / total, standardization=False, maxIter=200, **common).fit(ready)]
    finally:
        kept.unpersist()
    return Fitted(kind, classes, p, parts)


def fold_counts(rows: DataFrame, partition: str, label: str) -> dict:
    """partition -> {class: rows}, both in name order; from one pass."""
    found = rows.groupBy(partition, label).agg(F.count("*").alias("n")).orderBy(partition, label).collect()     # folds x classes
    out = {r[0]: {} for r in found}
    for r in found:
        if r[1] is not None:
            out[r[0]][r[1]] = r[2]
    return out


def _pooled(counts: list[dict]) -> dict:
    return {c: sum(d.get(c, 0) for d in counts) for c in sorted({c for d in counts for c in d})}


def fold_fits(rows: DataFrame, partition: str, features: list[str], label: str, kind: str, per_fold: dict | None = None, **options) -> dict:
    """partition -> model fitted without it. The loop is over partitions; each fit is a distributed job."""
    per_fold = fold_counts(rows, partition, label) if per_fold is None else per_fold
    counts = {name: _pooled([d for other, d in per_fold.items() if other != name and None not in (other, name)]) for name in per_fold}
    if any(len(c) < 2 for c in counts.values()):                # before any fit is paid for
        raise ValueError("training side has one class")

    def one(name) -> Fitted:
        return fit(kind, rows.where(F.col(partition) != F.lit(name)), features, label, counts=counts[name], **options)
    with ThreadPoolExecutor(JOBS if kind == "gbm" else 1) as pool:
        return dict(zip(per_fold, pool.map(one, per_fold)))


def out_of_fold(rows: DataFrame, partition: str, features: list[str], label: str, kind: str, **options) -> DataFrame:
    """Every row scored by a model fitted without its partition: ``score`` if binary, else ``predicted``."""
    per_fold = fold_counts(rows, partition, label)
    binary, parts = len(_pooled(list(per_fold.values()))) == 2, []
    for name, model in fold_fits(rows, partition, features, label, kind, per_fold, **options).items():
        held = rows.where(F.col(partition) == F.lit(name))
        parts.append(model.score(held) if binary else model.predict(held))
    return union_all(parts)


def held_out(rows: DataFrame, folds: list[tuple[Column, Column]], features: list[str], label: str, kind: str = "gbm", classes: list | None = None, **options) -> DataFrame:
    """Pooled test rows over designed (train, test) folds with ``predicted`` and ``probabilities`` (in the sorted order of
    all classes; a class the fold never saw gets 0). ``classes``: those of ``rows``, if the caller knows them."""
    classes = class_list(rows, label) if classes is None else classes
    parts = []
    for train, test in folds:
        model = fit(kind, rows.where(train), features, label, **options)
        p = model.probabilities(rows.where(test))
        full = F.array(*[F.col("probabilities")[model.classes.index(c)] if c in model.classes else F.lit(0.0) for c in classes])
        names = F.array(*[F.lit(c) for c in classes])
        p = p.withColumn("probabilities", full)
        parts.append(p.withColumn("predicted", F.element_at(names, F.array_position("probabilities", F.array_max("probabilities")).cast("int"))))
    return union_all(parts)
