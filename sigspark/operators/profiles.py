"""Aggregates that describe stored material: levels, inventories, copies, status tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_quantiles


# ------------------------------------------------------------------ catalog-style aggregates
def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, declared: str) -> DataFrame:
    """Parents whose declared number of children differs from what points at them: (parent, declared, found)."""
    found = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("found"))
    return (parents.select(parent_key, F.col(declared).alias("declared")).join(found, parent_key, "left")
            .withColumn("found", F.coalesce("found", F.lit(0))).where(~F.col("declared").eqNullSafe(F.col("found"))))


def distinct_text(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): the distinct values of a field as one evidence string. Meant for fields with few values."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), "; ").alias("values"))


def inventory_summary(files: DataFrame, dataset: str, digest: str, size: str) -> DataFrame:
    """(dataset, files, bytes, duplicate_groups, reclaimable): copies of one content inside a dataset."""
    contents = files.groupBy(dataset, digest).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.max(size).alias("one"))
    again = F.col("n") > 1
    return contents.groupBy(dataset).agg(
        F.sum("n").alias("files"), F.sum("total").alias("bytes"), F.sum(F.when(again, 1).otherwise(0)).alias("duplicate_groups"),
        F.sum(F.when(again, (F.col("n") - 1) * F.col("one")).otherwise(0)).alias("reclaimable"))


def sizes_with_different_content(files: DataFrame, digest: str, size: str) -> DataFrame:
    """(size, contents): sizes shared by files of different content, where equal size must not be taken for a copy."""
    return (files.select(size, digest).distinct().groupBy(size).agg(F.count("*").alias("contents")).where(F.col("contents") > 1))


def shared_values(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Values carried by several entities (duplicate serial numbers): (value, entities)."""
    pairs = df.where(F.col(value).isNotNull()).select(value, entity).distinct()
    return pairs.groupBy(value).agg(F.count("*").alias("entities")).where(F.col("entities") > 1)


def units_by(df: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """(keys, units): number of distinct units. The units themselves are ``df.select(keys, unit).distinct()``, as rows."""
    return df.select(*keys, unit).distinct().groupBy(*keys).agg(F.count("*").alias("units"))


def status_cube(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b) with totals per row, per column and overall; a total's key is the word ``total``."""
    def named(c: str) -> Column:
        return F.when(F.grouping(c) == 1, F.lit("total")).otherwise(F.col(c).cast("string")).alias(c)
    return df.cube(a, b).agg(named(a).alias("_a"), named(b).alias("_b"), F.count("*").alias("n")).select(F.col("_a").alias(a), F.col("_b").alias(b), "n")


def bin_medians(df: DataFrame, bin_: Column, value: str, keys: list[str] = (), min_rows: int = 5, target_rows: int | None = None) -> DataFrame:
    """(keys, bin, n, median) of bins with at least ``min_rows`` rows."""
    binned = df.withColumn("bin", bin_)
    return exact_quantiles(binned, value, {"median": 0.5}, [*keys, "bin"], target_rows).where(F.col("n") >= min_rows)


# ------------------------------------------------------------------ levels of sampled signals
def level_profile(samples: DataFrame, keys: list[str], channel: str, value: str, clip_at: float = 0.999) -> DataFrame:
    """Per key: level of the mean channel RMS in dBFS, peak, clipped %, largest DC offset, channel spread in dB.

    samples: one row per sample and channel, full scale 1.
    """
    x = F.col(value).cast("double")
    per_channel = samples.groupBy(*keys, channel).agg(
        F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"), F.avg(F.when(F.abs(x) >= clip_at, 1.0).otherwise(0.0)).alias("clip"),
        F.count("*").alias("n"), F.avg(x).alias("dc"))
    db = 20 * F.log10(F.col("rms") + F.lit(1e-12))
    return per_channel.groupBy(*keys).agg(
        (20 * F.log10(F.avg("rms") + F.lit(1e-12))).alias("level_dbfs"), F.max("peak").alias("peak"),
        (100 * F.sum(F.col("clip") * F.col("n")) / F.sum("n")).alias("clipped_percent"), F.max(F.abs("dc")).alias("dc_offset"),
        (F.max(db) - F.min(db)).alias("channel_spread_db"))


def window_rms(samples: DataFrame, keys: list[str], position: str, value: Column, window: int) -> DataFrame:
    """(keys, win, n, rms): RMS of fixed windows of ``window`` samples."""
    return (samples.groupBy(*keys, F.floor(F.col(position) / window).alias("win"))
            .agg(F.count("*").alias("n"), F.sqrt(F.avg(value * value)).alias("rms")))


def rms_profile(windows: DataFrame, keys: list[str], target_rows: int | None = None) -> DataFrame:
    """(keys, windows, rms_min, rms_median, rms_p90, rms_max, quietest, loudest) over the rows of :func:`window_rms`."""
    q = exact_quantiles(windows, "rms", {"rms_median": 0.5, "rms_p90": 0.9}, keys, target_rows).withColumnRenamed("n", "windows")
    ends = windows.groupBy(*keys).agg(
        F.min(F.struct("rms", "win")).alias("lo"), F.max(F.struct(F.col("rms"), (-F.col("win")).alias("neg"))).alias("hi"))
    return q.join(ends, keys).select(*keys, "windows", F.col("lo.rms").alias("rms_min"), "rms_median", "rms_p90",
                                     F.col("hi.rms").alias("rms_max"), F.col("lo.win").alias("quietest"), (-F.col("hi.neg")).alias("loudest"))


def active_share(windows: DataFrame, keys: list[str], power: str = "power", margin_db: float = 10.0, target_rows: int | None = None) -> DataFrame:
    """(keys, n, floor, active_share, snr_db): windows more than ``margin_db`` over the 5th-percentile window power."""
    floor = exact_quantiles(windows, power, {"floor": 0.05}, keys, target_rows)
    up = F.col(power) > F.col("floor") * 10 ** (margin_db / 10)
    return (windows.join(floor.drop("n"), keys).groupBy(*keys, "floor")
            .agg(F.count("*").alias("n"), F.avg(up.cast("double")).alias("active_share"), F.avg(F.when(up, F.col(power))).alias("_on"))
            .withColumn("snr_db", F.when(F.col("floor") > 0, 10 * F.log10(F.col("_on") / F.col("floor")))).drop("_on"))


def trigger_levels(samples: DataFrame, keys: list[str], position: str, value: str, trigger: int, rails: tuple[float, float]) -> DataFrame:
    """(keys, clip_fraction, log_rms_pre_trigger, log_rms_post_trigger) of integer codes around a trigger sample."""
    x, p = F.col(value).cast("double"), F.col(position)
    def log_rms(side: Column) -> Column:
        return F.log10(F.sqrt(F.avg(F.when(side, x * x))) + F.lit(1e-9))
    return samples.groupBy(*keys).agg(
        F.avg(F.when((x <= rails[0]) | (x >= rails[1]), 1.0).otherwise(0.0)).alias("clip_fraction"),
        log_rms(p < trigger).alias("log_rms_pre_trigger"), log_rms(p >= trigger).alias("log_rms_post_trigger"))


def levels_after_trigger(samples: DataFrame, keys: list[str], position: str, value: str, trigger: int, width: int, rails: tuple[float, float]) -> DataFrame:
    """(keys, band, n, rms, clipped_percent) per stretch of ``width`` samples from the trigger on."""
    x, p = F.col(value).cast("double"), F.col(position)
    return (samples.where(p >= trigger).groupBy(*keys, F.floor((p - trigger) / width).alias("band"))
            .agg(F.count("*").alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), (100 * F.avg(F.when((x <= rails[0]) | (x >= rails[1]), 1.0).otherwise(0.0))).alias("clipped_percent")))


def identical_channels(samples: DataFrame, keys: list[str], channel: str, position: str, value: str) -> DataFrame:
    """(keys, channels, first_channel): channels of one key that hold the same samples. Channels are compared by an
    order-free fingerprint, so none is collected."""
    h = F.xxhash64(F.col(position), F.col(value))
    prints = samples.groupBy(*keys, channel).agg(F.bit_xor(h).alias("a"), F.sum(F.pmod(h, F.lit(2147483647))).alias("b"), F.count("*").alias("n"))
    same = prints.groupBy(*keys, "a", "b", "n").agg(F.count("*").alias("channels"), F.min(channel).alias("first_channel"))
    return same.where(F.col("channels") > 1).select(*keys, "channels", "first_channel")


def transmission_table_checks(transmissions: DataFrame, keys: list[str], start: str, end: str, total: str) -> DataFrame:
    """(keys, transmissions, duration_min, duration_max, bad_order, past_end) of labelled [start, end) sample spans."""
    s, e = F.col(start), F.col(end)
    return transmissions.groupBy(*keys).agg(
        F.count("*").alias("transmissions"), F.min(e - s).alias("duration_min"), F.max(e - s).alias("duration_max"),
        F.sum((e <= s).cast("int")).alias("bad_order"), F.sum((e > F.col(total)).cast("int")).alias("past_end"))


def in_out_power_db(samples: DataFrame, inside: Column, power: Column, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg((10 * F.log10(F.avg(F.when(inside, power)) / F.avg(F.when(~inside, power)))).alias("in_out_db"))
