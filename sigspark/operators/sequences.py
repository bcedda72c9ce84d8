"""Runs, blocks, alarms and continuity: operators over rows in time order. All of them use ordered scans, so a single
long recording or one busy sensor is cut into ranges instead of filling one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..session import cut_lineage
from .scan import ordered, row_bound


def runs(df: DataFrame, keys: list[str], seq: str, target_rows: int | None = None) -> DataFrame:
    """Gap-free runs of integers: (keys, run, first, last, n). Duplicates of a number are counted once. ``df`` is evaluated once."""
    distinct = cut_lineage(df.select(*keys, seq).distinct())
    scan = ordered(distinct, keys, [seq], target_rows).lag({"_prev": (seq, 1)})
    scan = scan.islands("run", F.col("_prev").isNull() | (F.col(seq) - F.col("_prev") != 1))
    return scan.frame().groupBy(*keys, "run").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n"))


def missing_numbers(df: DataFrame, keys: list[str], seq: str, start: int, target_rows: int | None = None) -> DataFrame:
    """(keys, missing): numbers between ``start`` and the key's largest that do not occur, one row each."""
    distinct = df.select(*keys, seq).distinct()
    scan = ordered(distinct, keys, [seq], target_rows, row_bound(df, distinct, target_rows)).lag({"_prev": (seq, 1)})
    lo = F.coalesce(F.col("_prev") + 1, F.lit(start))
    gaps = scan.frame().where(F.col(seq) - lo >= 1)
    return gaps.select(*keys, F.explode(F.sequence(lo, F.col(seq) - 1)).alias("missing"))


def consecutive_check(df: DataFrame, keys: list[str], seq: str, start: int) -> DataFrame:
    """(keys, n, complete): do the distinct numbers run from ``start`` without holes?"""
    distinct = df.select(*keys, seq).distinct()
    return distinct.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.min(seq) == start) & (F.max(seq) == F.count("*") + (start - 1))).alias("complete"))


def time_blocks(df: DataFrame, keys: list[str], ts: str, tie: str, pause_s: float, target_rows: int | None = None) -> DataFrame:
    """Recording blocks: a new block starts when the pause is strictly longer than ``pause_s``."""
    scan = ordered(df.select(*keys, ts, tie), keys, [ts, tie], target_rows).lag({"_prev": (ts, 1)})
    new = F.col("_prev").isNull() | (seconds(F.col(ts)) - seconds(F.col("_prev")) > pause_s)
    return (scan.islands("block", new).frame().groupBy(*keys, "block")
            .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")))


def value_runs(df: DataFrame, keys: list[str], order: list[str], value: Column, target_rows: int | None = None) -> DataFrame:
    """Runs of equal values in order: (keys, run, value, start, n)."""
    scan = ordered(df.withColumn("_v", value).select(*keys, *order, "_v"), keys, order, target_rows)
    scan = scan.with_columns({"_seen": F.lit(1)}).lag({"_prev": ("_v", 1), "_seen_prev": ("_seen", 1)})
    scan = scan.islands("run", F.col("_seen_prev").isNull() | ~F.col("_v").eqNullSafe(F.col("_prev")))
    return (scan.frame().groupBy(*keys, "run")
            .agg(F.min("_v").alias("value"), F.min(order[0]).alias("start"), F.count("*").alias("n")))


def zero_runs(df: DataFrame, keys: list[str], position: str, sample: str, min_length: int = 8, target_rows: int | None = None) -> DataFrame:
    """Runs of at least ``min_length`` exactly zero samples: (keys, start, n)."""
    zeros = df.where(F.col(sample) == 0).select(*keys, position)
    found = runs(zeros, keys, position, target_rows)
    return found.where(F.col("n") >= min_length).select(*keys, F.col("first").alias("start"), "n")


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str, target_rows: int | None = None) -> DataFrame:
    """(keys, n, changes, mean_jump): number of value changes between neighbours."""
    scan = ordered(df.select(*keys, *order, value), keys, order, target_rows).lag({"_prev": (value, 1)})
    changed = F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(value)), 1).otherwise(0)
    return scan.frame().groupBy(*keys).agg(F.count("*").alias("n"), F.sum(changed).alias("changes"))


def mean_abs_step(df: DataFrame, keys: list[str], order: list[str], value: str, target_rows: int | None = None) -> DataFrame:
    """(keys, mean_step): mean absolute successive difference."""
    scan = ordered(df.select(*keys, *order, value), keys, order, target_rows).lag({"_prev": (value, 1)})
    return scan.frame().groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_prev"))).alias("mean_step"))


# ------------------------------------------------------------------ alarms
def alarms(df: DataFrame, keys: list[str], order: list[str], flag: Column, k: int = 2, n: int = 3,
           target_rows: int | None = None) -> DataFrame:
    """Rows with ``active`` (at least k of the last n rows flagged) and ``onset`` (active and the row before not).

    The first rows of a key look at fewer rows.
    """
    scan = ordered(df.withColumn("flagged", F.when(flag, 1).otherwise(0)), keys, order, target_rows)
    scan = scan.lookback({"_hits": lambda w: F.sum("flagged").over(w.rowsBetween(-(n - 1), 0)),
                          "_hits_before": lambda w: F.sum("flagged").over(w.rowsBetween(-n, -1))}, back=n)
    active = F.col("_hits") >= k
    return (scan.with_columns({"active": active, "onset": active & ~(F.coalesce("_hits_before", F.lit(0)) >= k)})
            .frame().drop("_hits", "_hits_before"))


def alarm_summary(alarm_rows: DataFrame, keys: list[str]) -> DataFrame:
    return alarm_rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("flagged")).alias("flags"),
                                         F.sum(F.col("onset").cast("int")).alias("onsets"))


# ------------------------------------------------------------------ intervals
def interval_union(df: DataFrame, keys: list[str], start: str, end: str, tie: str, target_rows: int | None = None) -> DataFrame:
    """(keys, n, covered): total length of the union of intervals; start and end are numbers."""
    scan = ordered(df.select(*keys, start, end, tie), keys, [start, tie], target_rows)
    scan = scan.running({"_reach": (F.max, F.col(end))}, inclusive=False)
    added = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start))))
    return scan.frame().groupBy(*keys).agg(F.count("*").alias("n"), F.sum(added).alias("covered"))


def start_intervals(df: DataFrame, keys: list[str], start: str, tie: str, target_rows: int | None = None) -> DataFrame:
    """(keys, n, interval_mean, interval_cv): spacing of starts; CV is population std over mean, NULL for a single
    interval or a zero mean."""
    scan = ordered(df.select(*keys, start, tie), keys, [start, tie], target_rows).lag({"_prev": (start, 1)})
    gap = F.col(start) - F.col("_prev")
    return (scan.with_columns({"gap": gap}).frame().groupBy(*keys)
            .agg(F.count("*").alias("n"), F.avg("gap").alias("interval_mean"), F.count("gap").alias("_m"),
                 F.stddev_pop("gap").alias("_sd"))
            .withColumn("interval_cv", F.when((F.col("_m") > 1) & (F.col("interval_mean") > 0), F.col("_sd") / F.col("interval_mean")))
            .drop("_m", "_sd"))


def part_index(df: DataFrame, keys: list[str], order: list[str], target_rows: int | None = None) -> DataFrame:
    """Zero-based position in time order."""
    scan = ordered(df, keys, order, target_rows).row_number("part_index")
    return scan.frame().withColumn("part_index", F.col("part_index") - 1)


# ------------------------------------------------------------------ continuity across stored parts
def boundary_steps(samples: DataFrame, keys: list[str], position: str, value: str, clip: int,
                   target_rows: int | None = None) -> DataFrame:
    """Per key: is the jump across part boundaries like the steps inside parts?

    (keys, boundaries, share_above_p99, ratio): share of boundary jumps above the within-part 99th percentile, and the
    median boundary jump over the median inner step. Parts are ``clip`` samples long. ``samples`` is evaluated once, and so are
    the steps, which five reductions read.
    """
    from .ranks import exact_quantiles

    scan = ordered(cut_lineage(samples.select(*keys, position, value)), keys, [position], target_rows).lag({"_prev": (value, 1)})
    steps = cut_lineage(scan.frame().where(F.col("_prev").isNotNull()).select(
        *keys, (F.col(position) % clip == 0).alias("boundary"), F.abs(F.col(value) - F.col("_prev")).alias("step")))
    inner = exact_quantiles(steps.where(~F.col("boundary")), "step", {"p99": 0.99, "inner_median": 0.5}, keys, target_rows)
    at = steps.where("boundary")
    medians = exact_quantiles(at, "step", {"jump_median": 0.5}, keys, target_rows).drop("n")
    shares = (at.join(inner.drop("n"), keys).groupBy(*keys)
              .agg(F.count("*").alias("boundaries"), F.avg((F.col("step") > F.col("p99")).cast("double")).alias("share_above_p99")))
    return (shares.join(medians, keys).join(inner.select(*keys, "inner_median"), keys)
            .select(*keys, "boundaries", "share_above_p99",
                    F.when(F.col("inner_median") > 0, F.col("jump_median") / F.col("inner_median")).alias("ratio")))


def file_continuity(files: DataFrame, keys: list[str], order: str, start: str, end: str, first: str, last: str, step: str,
                    target_rows: int | None = None) -> DataFrame:
    """Neighbouring files of a key: do they overlap in time, and how large is the jump against the typical step?"""
    scan = ordered(files, keys, [order], target_rows).lag({"_end": (end, 1), "_last": (last, 1), "_step": (step, 1)})
    return (scan.frame().where(F.col("_end").isNotNull())
            .select(*keys, order, (F.col(start) < F.col("_end")).alias("overlaps"),
                    (F.abs(F.col(first) - F.col("_last")) / F.nullif(F.col("_step"), F.lit(0.0))).alias("jump_over_step")))
