"""Group bootstrap, group permutation and paired differences.

Rows of one group are not independent, so groups are what is resampled or relabelled. A replicate gives each group a
non-negative weight (a bootstrap) or a label (a permutation); ``operators.replicates`` computes both inside the tasks.

All replicates of an AUC are computed in one pass: rows are reduced to (group, score) counts and cut into ranges of
bounded size by (score, group number), so that one score shared by many groups is cut too. Each range adds up its weighted
Mann-Whitney counts for every replicate at once. Its lowest and its highest score may go on in a neighbour, so they
leave the task as sums of their own and meet per (score, replicate); all between is one row per (range, replicate).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .replicates import BLOCK, GroupDraws, GroupShuffles, Rotations, chunks
from .scan import RANGE, lookup_join, null_safe, ordered, row_bound, with_ranges

ROWS_PER_RANGE = 25_000                # 64 replicates of a range take about 50 MB in a task
MAX_ROWS_PER_RANGE = 2_000_000         # and of the largest range of draws, which are summed in slices, about 500 MB
DRAWN_RANGES = 24                      # ranges of draws are not made larger than this share of the rows
SLICE = 1024                           # rows of a range that are summed at once: 64 replicates of them stay in a cache


# ------------------------------------------------------------------ groups and draws
def numbered_groups(groups: DataFrame, group: str, n_groups: int | None = None) -> DataFrame:
    """Add the 0-based position ``_g`` of each group in sorted order."""
    return ordered(groups, [], [group], n_rows=n_groups).row_number("_g").frame().withColumn("_g", F.col("_g") - 1)


def pure_numbered_groups(df: DataFrame, group: str, label: str) -> tuple[DataFrame, int]:
    """Numbered groups and how many there are, with the purity check in the same pass."""
    groups = cut_lineage(df.groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("_other"), F.count("*").alias("n")))
    found = groups.agg(F.count("*").alias("n"), F.sum((F.col(label) != F.col("_other")).cast("int")).alias("mixed")).first()
    if found["mixed"]:
        raise ValueError("permutation needs label-pure groups")
    return cut_lineage(numbered_groups(groups.drop("_other"), group, found["n"])), found["n"]


def class_sizes(numbered: DataFrame, label: str) -> list[tuple]:
    """(label, groups), sorted; one entry per class."""
    return [tuple(r) for r in numbered.groupBy(label).agg(F.count("*").alias("groups")).orderBy(label).collect()]


def shuffles(numbered: DataFrame, label: str, n_replicates: int, seed: int = 0) -> GroupShuffles:
    return GroupShuffles(tuple(n for _, n in class_sizes(numbered, label)), n_replicates, seed)


def rotations(numbered: DataFrame, label: str, n_replicates: int, step: int = 1) -> Rotations:
    """Class numbers of all groups in sorted order; refused above MAX_ROTATED groups before they are read."""
    classes = [c for c, _ in class_sizes(numbered, label)]
    Rotations(np.empty(numbered.count(), dtype=np.uint16), n_replicates, step)
    code = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int").alias("code")
    return Rotations(numbered.select("_g", code).toPandas().sort_values("_g")["code"].to_numpy(np.uint16), n_replicates, step)


def shuffled_labels(numbered: DataFrame, label: str, n_replicates: int, seed: int) -> DataFrame:
    """(rep, _g, label): labels dealt to groups in a seeded hash order, independently per replicate."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))).alias("rep")
    dealt = numbered.select("_g", label, reps).withColumn("h", F.xxhash64(F.lit(seed), "rep", "_g"))
    hashed = ordered(dealt, ["rep"], ["h", "_g"]).row_number("at").frame()
    return (hashed.select("rep", (F.col("at") - 1).alias("_g"), F.col("_g").alias("source"))
            .join(numbered.select(F.col("_g").alias("source"), label), "source").drop("source"))


# ------------------------------------------------------------------ AUC replicates
def _pair(source, groups: np.ndarray, positive: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, replicate) weights as a positive and as a negative."""
    if isinstance(source, GroupDraws):
        w = source.weights(groups, reps)
        return w * positive[:, None], w * (1 - positive)[:, None]
    codes = source.codes(groups, reps)
    return (codes == 1).astype(float), (codes == 0).astype(float)


def _drawn_range(outer: np.ndarray, value: np.ndarray, n: np.ndarray, y: np.ndarray, at: np.ndarray, groups: np.ndarray, starts: np.ndarray, source: GroupDraws) -> Iterator[pd.DataFrame]:
    """Sums of one range under group draws: its lowest score, its highest and all between, per replicate.

    A group is positive or negative, never both, so the negatives of a slice are summed up once and each positive looks up
    how many lie below it and how many not above it; half of both is its wins. Slices hold whole scores; a score
    heavier than a slice is added up in parts.
    """
    ends, side = np.append(starts[1:], len(n)), np.stack([n * y, n * ~y])
    score = np.repeat(np.arange(len(starts)), ends - starts)
    ones, slices, k = bool((n == 1).all()), [], 1
    while k < len(starts) - 1:
        last = max(k, min(int(np.searchsorted(ends, starts[k] + SLICE, side="right")) - 1, len(starts) - 2))
        rows, k = slice(int(starts[k]), int(ends[last])), last + 1
        if rows.stop - rows.start > SLICE:
            slices.append((rows, None, None, None, None))
            continue
        up, down = rows.start + np.flatnonzero(y[rows]), rows.start + np.flatnonzero(~y[rows])
        slices.append((rows, up, down, *[np.searchsorted(score[down], score[up], side=s).astype(np.int32) for s in ("left", "right")]))

    def both(rows: slice, w: np.ndarray) -> np.ndarray:
        return sum(side[:, i:min(i + SLICE, rows.stop)] @ w[at[i:min(i + SLICE, rows.stop)]].astype(float) for i in range(rows.start, rows.stop, SLICE))

    for reps in chunks(source.n_replicates):
        w, none = source.weights(groups, reps, np.uint16), np.zeros(len(reps))
        for k in {0, len(starts) - 1}:                                              # scores that a neighbour may share
            pos, neg = both(slice(int(starts[k]), int(ends[k])), w)
            yield pd.DataFrame({"k": outer[starts[k]], "at": value[starts[k]], "shared": True, "rep": reps, "pos": pos, "neg": neg, "wins": none})
        if len(starts) < 3:
            continue
        pos, below, wins = np.zeros((3, len(reps)))
        for rows, up, down, lo, hi in slices:
            if up is None:
                more, neg = both(rows, w)
                wins, pos, below = wins + more * (below + 0.5 * neg), pos + more, below + neg
                continue
            sums = np.empty((len(down) + 1, len(reps)))
            sums[0], sums[1:] = below, w[at[down]]
            won = w[at[up]].astype(float)
            if not ones:
                sums[1:] *= n[down, None]
                won *= n[up, None]
            np.cumsum(sums, axis=0, out=sums)
            wins = wins + 0.5 * np.einsum("ij,ij->j", won, sums[lo] + sums[hi])
            pos, below = pos + won.sum(axis=0), sums[-1].copy()
        yield pd.DataFrame({"k": outer[starts[1]], "at": value[starts[1]], "shared": False, "rep": reps, "pos": pos, "neg": below, "wins": wins})


def _dealt_two_ways(source: GroupDraws | GroupShuffles | Rotations) -> bool:
    """Does every group carry class 0 or class 1 in every replicate?"""
    if isinstance(source, GroupShuffles):
        return len(source.sizes) == 2
    return isinstance(source, Rotations) and len(source.labels) > 0 and int(source.labels.max()) <= 1


def _rank_sum_replicates(placed: DataFrame, n_rows: int, source: GroupShuffles | Rotations) -> DataFrame:
    """(rep, auc) of labels dealt to whole groups, from the rank sums of the groups.

    If every row is positive or negative, the wins of the positives are the sum of their (rows below + half of the rows tied) less
    half the square of their number, whoever they are. So a replicate needs two numbers a group, and none of its rows.
    """
    total = placed.groupBy("_k", "_s").agg(F.sum("_n").alias("_t"))
    ranked = ordered(total, [], ["_k", "_s"], n_rows=row_bound(placed, total, None)).running({"_upto": (F.sum, F.col("_t"))}).frame()
    rows = lookup_join(placed, ranked.select("_k", "_s", (F.col("_upto") - F.col("_t") * 0.5).alias("_m"), F.col("_t").alias("_w")), ["_k", "_s"], "_w")
    per = rows.groupBy("_g").agg(F.sum("_n").cast("double").alias("n"), F.sum(F.col("_n") * F.col("_m")).alias("t"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, source.n_replicates))
        for pdf in batches:
            groups, values = pdf["_g"].to_numpy(), pdf[["n", "t"]].to_numpy(float).T
            sums[2] += values[0].sum()
            for at in range(0, len(groups), BLOCK):
                for reps in chunks(source.n_replicates):
                    sums[:2, reps] += values[:, at:at + BLOCK] @ (source.codes(groups[at:at + BLOCK], reps) == 1)
        yield pd.DataFrame({"rep": np.arange(source.n_replicates), "pos": sums[0], "t": sums[1], "n": sums[2]})

    sums = per.mapInPandas(summed, "rep long, pos double, t double, n double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("pos", "t", "n")])
    pairs = F.col("pos") * (F.col("n") - F.col("pos"))
    return sums.where(pairs > 0).select("rep", ((F.col("t") - 0.5 * F.col("pos") * F.col("pos")) / pairs).alias("auc"))


def drawn_range_rows(n_groups: int, n_rows: int) -> int:
    """Rows of a range of draws: four for each group whose draws it makes, while there are DRAWN_RANGES ranges to share the work."""
    return max(ROWS_PER_RANGE, min(MAX_ROWS_PER_RANGE, 4 * n_groups, n_rows // DRAWN_RANGES))


def placed_counts(df: DataFrame, numbered: DataFrame, group: str, label: str, score: str) -> tuple[DataFrame, int]:
    """Rows of each (group, score), with the group's number and label, and how many such pairs there are."""
    counts = df.groupBy(group, score).agg(F.count("*").alias("_n"))
    known = numbered.select(group, "_g", F.col(label).cast("int").alias("_y"))
    kind, own = df.schema[score].dataType, F.col(score)
    # the value stands beside its rank among null, numbers and not-a-number: pandas would make one of the outer two
    rank = F.when(own.isNull(), 0).when(F.isnan(own) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False), 2).otherwise(1)
    placed = cut_lineage(null_safe(counts, known, [group])
                         .select(rank.alias("_k"), F.when(rank == 1, own).otherwise(F.lit(0).cast(kind)).alias("_s"), "_g", "_y", "_n"))
    return placed, placed.count()


def auc_replicates(df: DataFrame, numbered: DataFrame, group: str, label: str, score: str, source: GroupDraws | GroupShuffles | Rotations,
                   rows_per_range: int | None = None, placed: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(rep, auc) for every replicate of ``source``; one-class replicates are dropped. Null is the lowest score and not-a-number
    the highest, each tied with itself, as in ``ranks.auc``.

    Shuffles: rows on (group, score) after partial aggregation, counts on group number's table and on range, range sums on
    (replicate, score). A range makes the draws of all blocks that its groups lie in, so without ``rows_per_range`` ranges grow
    with the number of groups; labels dealt two ways need no ranges. ``placed``: the ``placed_counts`` of these rows, if the caller
    has made them.
    """
    kind = df.schema[score].dataType
    placed, n_rows = placed or placed_counts(df, numbered, group, label, score)
    if _dealt_two_ways(source):
        return _rank_sum_replicates(placed, n_rows, source)
    drawn = isinstance(source, GroupDraws)
    if rows_per_range is None:
        rows_per_range = drawn_range_rows(source.n_groups, n_rows) if drawn else ROWS_PER_RANGE
    ranged, n_ranges = with_ranges(placed, ["_k", "_s", "_g"], rows_per_range, n_rows)

    def per_range(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k", "_s"], kind="stable")
        outer, value, n = pdf["_k"].to_numpy(), pdf["_s"].to_numpy(), pdf["_n"].to_numpy(float)
        starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (outer[1:] != outer[:-1])])
        groups, first, at = np.unique(pdf["_g"].to_numpy(), return_index=True, return_inverse=True)
        positive, parts = pdf["_y"].to_numpy()[first], []
        if drawn and np.isin(positive, (0, 1)).all():
            return pd.concat(_drawn_range(outer, value, n, positive[at] == 1, at, groups, starts, source))
        n = n[:, None]
        for reps in chunks(source.n_replicates):
            w_pos, w_neg = _pair(source, groups, positive, reps)
            pos, neg = np.add.reduceat(w_pos[at] * n, starts, axis=0), np.add.reduceat(w_neg[at] * n, starts, axis=0)
            none = np.zeros(len(reps))
            for k in {0, len(starts) - 1}:                                          # scores that a neighbour may share
                parts.append(pd.DataFrame({"k": outer[starts[k]], "at": value[starts[k]], "shared": True, "rep": reps, "pos": pos[k], "neg": neg[k], "wins": none}))
            if len(starts) > 2:
                pos, neg = pos[1:-1], neg[1:-1]
                below = np.cumsum(neg, axis=0) - neg
                parts.append(pd.DataFrame({"k": outer[starts[1]], "at": value[starts[1]], "shared": False, "rep": reps, "pos": pos.sum(axis=0), "neg": neg.sum(axis=0),
                                           "wins": (pos * (below + 0.5 * neg)).sum(axis=0)}))
        return pd.concat(parts)

    # ranges are small in bytes but heavy in work, so they must not be coalesced, nor two of them be dealt to one task while others have none
    sums = (ranged.repartition(4 * n_ranges, RANGE).groupBy(RANGE)
            .applyInPandas(per_range, f"k int, at {kind.simpleString()}, shared boolean, rep long, pos double, neg double, wins double"))
    met = (sums.groupBy("rep", "k", "at").agg(F.max("shared").alias("shared"), *[F.sum(c).alias(c) for c in ("pos", "neg", "wins")])
           .withColumn("wins", F.when(F.col("shared"), 0.5 * F.col("pos") * F.col("neg")).otherwise(F.col("wins"))))
    earlier = Window.partitionBy("rep").orderBy("k", "at").rowsBetween(Window.unboundedPreceding, -1)   # at most three rows per range
    total = (met.withColumn("neg_below", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
             .groupBy("rep").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                 F.sum(F.col("wins") + F.col("pos") * F.col("neg_below")).alias("wins")))
    return total.where((F.col("pos") > 0) & (F.col("neg") > 0)).select("rep", (F.col("wins") / (F.col("pos") * F.col("neg"))).alias("auc"))


# ------------------------------------------------------------------ balanced accuracy and rate replicates
def label_counts(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """(group, truth, predicted, n): everything the label metrics need."""
    return df.groupBy(group, truth, predicted).agg(F.count("*").alias("n"))


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of neighbouring groups side by side, so that a batch asks for few blocks of draws."""
    return rows.repartition(F.floor(F.col("_g") / BLOCK)).sortWithinPartitions("_g")


def _drawn_sums(rows: DataFrame, source: GroupDraws) -> DataFrame:
    """(rep, key, hit, n): weighted sums of (_g, key, hit, n) rows. A task keeps two numbers per key and replicate."""
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            groups, at = np.unique(pdf["_g"].to_numpy(), return_inverse=True)
            names, key = np.unique(pdf["key"].to_numpy(), return_inverse=True)
            values = pdf[["hit", "n"]].to_numpy(float)
            for reps in chunks(source.n_replicates):
                w = source.weights(groups, reps)[at]
                for k, name in enumerate(names):
                    mine = key == k
                    found.setdefault(name, np.zeros((2, source.n_replicates)))[:, reps] += values[mine].T @ w[mine]
        for name, (hit, n) in found.items():
            yield pd.DataFrame({"rep": np.arange(source.n_replicates), "key": name, "hit": hit, "n": n})

    sums = _by_block(rows.select("_g", "key", F.col("hit").cast("double"), F.col("n").cast("double"))).mapInPandas(summed, "rep long, key string, hit double, n double")
    return sums.groupBy("rep", "key").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).where("n > 0")


def balanced_accuracy_replicates(counts: DataFrame, numbered: DataFrame, group: str, truth: str, predicted: str, source: GroupDraws) -> DataFrame:
    """(rep, balanced_accuracy): mean recall over the classes present in the replicate."""
    hits = counts.groupBy(group, truth).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    placed = null_safe(hits, numbered.select(group, "_g"), [group]).withColumn("key", F.to_json(F.struct(F.col(truth).alias("v"))))
    return _drawn_sums(placed, source).groupBy("rep").agg(F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def permuted_balanced_accuracy(counts: DataFrame, numbered: DataFrame, group: str, truth: str, predicted: str, source: GroupShuffles | Rotations) -> DataFrame:
    """(rep, balanced_accuracy) with each group carrying the label dealt to it."""
    classes = [c for c, _ in class_sizes(numbered, truth)]
    code = (F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(predicted)), F.lit(0)) - 1).cast("int")
    per = counts.groupBy(group, predicted).agg(F.sum("n").alias("n"))
    placed = null_safe(per, numbered.select(group, "_g"), [group]).select("_g", code.alias("code"), F.col("n").cast("double").alias("n"))
    width = len(classes)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, width, source.n_replicates))
        for pdf in batches:
            groups, at = np.unique(pdf["_g"].to_numpy(), return_inverse=True)
            n, own = pdf["n"].to_numpy()[:, None], pdf["code"].to_numpy()[:, None]
            for reps in chunks(source.n_replicates):
                dealt = source.codes(groups, reps)[at].astype(np.int64)
                cell = (dealt * len(reps) + np.arange(len(reps))).ravel()
                for k, value in enumerate((n * (dealt == own), np.broadcast_to(n, dealt.shape))):
                    sums[k][:, reps] += np.bincount(cell, value.ravel(), width * len(reps)).reshape(width, len(reps))
        for k in range(width):
            yield pd.DataFrame({"rep": np.arange(source.n_replicates), "key": k, "hit": sums[0, k], "n": sums[1, k]})

    cells = (_by_block(placed).mapInPandas(summed, "rep long, key int, hit double, n double")
             .groupBy("rep", "key").agg((F.sum("hit") / F.nullif(F.sum("n"), F.lit(0.0))).alias("recall")))
    return cells.groupBy("rep").agg(F.avg("recall").alias("balanced_accuracy"))


def rate_replicates(df: DataFrame, numbered: DataFrame, group: str, flagged: Column, source: GroupDraws) -> DataFrame:
    """(rep, rate): share of flagged rows when whole groups are drawn."""
    sums = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.when(flagged, 1).otherwise(0)).alias("hit"))
    placed = null_safe(sums, numbered.select(group, "_g"), [group]).withColumn("key", F.lit(""))
    return _drawn_sums(placed, source).select("rep", (F.col("hit") / F.col("n")).alias("rate"))


# ------------------------------------------------------------------ summaries (inputs: one row per replicate)
def interval(replicates: DataFrame, value: str) -> DataFrame:
    """95 % percentile interval over the replicates."""
    return replicates.agg(F.percentile(value, F.lit(0.025)).alias("ci_lo"), F.percentile(value, F.lit(0.975)).alias("ci_hi"),
                          F.count(value).alias("n_replicates"))


def permutation_summary(null: DataFrame, value: str, observed: DataFrame) -> DataFrame:
    """(observed, n, p_value, null_median, null_95th); observed is a one-row frame with the same column."""
    joined = null.select(F.col(value).alias("v")).join(F.broadcast(observed.select(F.col(value).alias("observed"))))
    return joined.groupBy("observed").agg(
        F.count("*").alias("n"),
        ((1 + F.sum(F.when(F.col("v") >= F.col("observed"), 1).otherwise(0))) / (1 + F.count("*"))).alias("p_value"),
        F.percentile("v", F.lit(0.5)).alias("null_median"), F.percentile("v", F.lit(0.95)).alias("null_95th"))


def difference_summary(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Replicates of two score sets drawn alike -> interval of a - b and the share at or below zero."""
    d = a.select("rep", F.col(value).alias("a")).join(b.select("rep", F.col(value).alias("b")), "rep").withColumn("d", F.col("a") - F.col("b"))
    return d.agg(F.percentile("d", F.lit(0.025)).alias("ci_lo"), F.percentile("d", F.lit(0.975)).alias("ci_hi"),
                 F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("share_at_or_below_zero"))
