"""Rank statistics and exact quantiles without putting a key, or the whole table, into one task.

Rows are first reduced to (key, value) counts, so ties cost nothing; the counts are then scanned in value ranges.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import kept_counts, lookup_join, null_safe, ordered, row_bound


def auc(df: DataFrame, score: str, positive: Column, keys: list[str] = (), target_rows: int | None = None) -> DataFrame:
    """ROC AUC with ties worth one half, pooled per key. Columns: keys, n_pos, n_neg, auc (NULL with one class).

    Shuffles on (keys, score) after partial aggregation, then on (keys, score range).
    """
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("pos"),
                                          F.sum(F.when(positive, 0).otherwise(1)).alias("neg"))
    scan = ordered(counts, keys, [score], target_rows, row_bound(df, counts, target_rows)).running({"neg_below": (F.sum, F.col("neg"))}, inclusive=False)
    wins = F.col("pos") * (F.coalesce(F.col("neg_below"), F.lit(0)) + F.col("neg") * 0.5)
    out = scan.frame().groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.withColumn("auc", F.when(pairs > 0, F.col("wins") / pairs)).drop("wins")


def auc_by_feature(df: DataFrame, features: list[str], positive: Column, keys: list[str] = (),
                   target_rows: int | None = None) -> DataFrame:
    """One AUC per feature column: unpivoted once, ranked once."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])
    long = (df.withColumn("_positive", positive).select(*keys, "_positive", F.explode(pairs).alias("p"))
            .select(*keys, "_positive", "p.feature", "p.score").where(F.col("score").isNotNull()))
    return auc(long, "score", F.col("_positive"), [*keys, "feature"], target_rows)


def best_single_feature(aucs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The feature furthest from chance and its direction; the first name wins ties."""
    distance = F.abs(F.col("auc") - 0.5)
    best = F.min(F.struct((-distance).alias("d"), F.col("feature"), F.col("auc"))).alias("b")
    return (aucs.where(F.col("auc").isNotNull()).groupBy(*keys).agg(best)
            .select(*keys, F.col("b.feature").alias("feature"), F.col("b.auc").alias("auc"),
                    F.when(F.col("b.auc") >= 0.5, 1).otherwise(-1).alias("direction")))


def auc_per_stratum(df: DataFrame, score: str, positive: Column, stratum: str, target_rows: int | None = None) -> DataFrame:
    """Positives of each stratum against **all** negatives.

    Negatives are not copied per stratum: both sides share one scan over the scores, which tells every positive how
    many negatives lie below it; strata are formed afterwards.
    """
    counts = df.groupBy(score, F.when(positive, F.col(stratum)).alias(stratum), positive.alias("_y")).agg(F.count("*").alias("n"))
    per_score = counts.groupBy(score).agg(
        F.sum(F.when(F.col("_y"), 0).otherwise(F.col("n"))).alias("neg"), F.sum("n").alias("w"))
    below = (ordered(per_score, [], [score], target_rows, row_bound(df, per_score, target_rows))
             .running({"neg_below": (F.sum, F.col("neg"))}, inclusive=False).frame()
             .withColumn("neg_below", F.coalesce("neg_below", F.lit(0))))
    total = df.agg(F.sum(F.when(positive, 0).otherwise(1)).alias("n_neg"))
    placed = lookup_join(counts.where("_y"), below, [score], "w")
    out = placed.groupBy(stratum).agg(F.sum("n").alias("n_pos"),
                                      F.sum(F.col("n") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("wins"))
    return (out.join(F.broadcast(total))                            # one row
            .withColumn("auc", F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg")))
            .select(stratum, "n_pos", "n_neg", "auc"))


def mid_ranks(df: DataFrame, value: str, keys: list[str] = (), target_rows: int | None = None) -> DataFrame:
    """(keys, value, n, rank): average rank of every distinct value, 1-based."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    scan = ordered(counts, keys, [value], target_rows, row_bound(df, counts, target_rows)).running({"below": (F.sum, F.col("n"))}, inclusive=False)
    return scan.frame().select(*keys, value, "n", (F.coalesce("below", F.lit(0)) + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] = (), target_rows: int | None = None) -> DataFrame:
    """Rank correlation with ties averaged: Pearson correlation of the mid-ranks."""
    keys = list(keys)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    cells = pairs.groupBy(*keys, x, y).agg(F.count("*").alias("m"))
    rx = mid_ranks(pairs, x, keys, target_rows).withColumnRenamed("rank", "rx")
    ry = mid_ranks(pairs, y, keys, target_rows).withColumnRenamed("rank", "ry")
    cells = lookup_join(lookup_join(cells, rx, [*keys, x], "n"), ry, [*keys, y], "n")
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    # ranks of n rows average (n + 1) / 2, so the centred sums need one pass
    sums = cells.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(m * a * b).alias("ab"), F.sum(m * a * a).alias("aa"),
                                    F.sum(m * b * b).alias("bb"))
    shift = F.col("n") * ((F.col("n") + 1) / 2.0) ** 2
    den = F.sqrt((F.col("aa") - shift) * (F.col("bb") - shift))
    return sums.select(*keys, "n", F.when(den > 0, (F.col("ab") - shift) / den).alias("spearman"))


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: list[str] = (),
                    target_rows: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key, as ``percentile`` gives, without one buffer per key.

    qs: output column -> quantile. NULL values are ignored.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value))
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("c"))
    counts, n_rows = kept_counts(present, counts, target_rows)
    upto = ordered(counts, keys, [value], target_rows, n_rows).running({"hi": (F.sum, F.col("c"))}).frame()
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    # a value covers the zero-based positions [hi - c, hi); only the values at the wanted positions survive
    placed = null_safe(upto, sizes, keys)
    lo = F.col("hi") - F.col("c")
    picks = []
    for name, q in qs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((pos >= lo) & (pos < F.col("hi")), F.col(value))).alias(f"{name}_{side}"))
    out = placed.groupBy(*keys, "n").agg(*picks)
    frac = {name: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q))) for name, q in qs.items()}
    return out.select(*keys, "n", *[(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * frac[name]).alias(name)
                                    for name in qs])
