"""Sampled signals as block tables, and windows cut out of them.

``signal_blocks`` holds at most BLOCK_SAMPLES samples per row, ordered by (capture_id, channel, block_index) inside each
file, so that Parquet statistics skip the row groups a window does not touch. A whole capture is never assembled:
only the blocks of a requested window meet in one row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import evenly_spaced
from ..operators.joins import interval_overlap
from ..operators.scan import ordered
from ..schemas import BLOCK_SAMPLES


def write_blocks(blocks: DataFrame, path: str, files: int | None = None) -> None:
    """Cluster by capture and block for row-group pruning. A long capture is spread over several files."""
    out = blocks.repartitionByRange(*([files] if files else []), "capture_id", "channel", "block_index")
    out.sortWithinPartitions("capture_id", "channel", "block_index").write.mode("overwrite").parquet(path)


def capture_extents(blocks: DataFrame) -> DataFrame:
    """(capture_id, n_total): samples every channel has, i.e. the shortest channel."""
    per_channel = blocks.groupBy("capture_id", "channel").agg(F.max(F.col("start") + F.col("n")).alias("n_total"))
    return per_channel.groupBy("capture_id").agg(F.min("n_total").alias("n_total"))


def fixed_windows(extents: DataFrame, length: int, stride: int | None = None, limit: int | None = None) -> DataFrame:
    """(capture_id, win, start, count): whole windows of ``length`` every ``stride`` samples."""
    step = stride or length
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_total") - length, F.lit(step).cast("long"))
    starts = F.when(F.col("n_total") >= length, starts).otherwise(F.array().cast("array<bigint>"))
    if limit:
        starts = F.slice(starts, 1, limit)
    return (extents.select("capture_id", F.posexplode(starts).alias("win", "start")).withColumn("count", F.lit(length).cast("long")))


def spaced_windows(extents: DataFrame, length: int, n: int) -> DataFrame:
    """(capture_id, win, start, count): n windows evenly spaced from the first sample to the last possible start."""
    fitting = extents.where(F.col("n_total") >= length)
    starts = evenly_spaced(F.col("n_total"), F.lit(length), n)
    return fitting.select("capture_id", F.posexplode(starts).alias("win", "start")).withColumn("count", F.lit(length).cast("long"))


def chunk_start_windows(extents: DataFrame, chunk: int, length: int, per_chunk: int) -> DataFrame:
    """(capture_id, win, start, count): ``per_chunk`` consecutive windows at the start of every stored chunk."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_total") - 1) / chunk))
    starts = F.flatten(F.transform(chunks, lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(per_chunk - 1)), lambda k: c * chunk + k * length)))
    starts = F.filter(starts, lambda s: s + length <= F.col("n_total"))
    return extents.select("capture_id", F.posexplode(starts).alias("win", "start")).withColumn("count", F.lit(length).cast("long"))


def window_problems(requests: DataFrame, extents: DataFrame) -> DataFrame:
    """Requests that start outside their capture, or name an unknown one. A window may reach past the end."""
    joined = requests.join(extents, "capture_id", "left")
    bad = F.col("n_total").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("n_total"))
    return joined.where(bad)


def read_windows(blocks: DataFrame, requests: DataFrame, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """requests (capture_id, win, start, count or NULL to the end) -> (capture_id, channel, win, start, n, i, q).

    The window is clipped at the end of the capture. Requests are turned into the block numbers they touch and joined
    on (capture_id, block_index), so the join is an equi-join whose keys spread a long capture over many tasks.
    Shuffle keys: (capture_id, block_index), then (capture_id, channel, win).
    """
    open_ended = requests.where(F.col("count").isNull())
    if "n_total" not in requests.columns and open_ended.limit(1).count():
        requests = requests.join(capture_extents(blocks), "capture_id").withColumn("count", F.coalesce("count", F.col("n_total") - F.col("start"))).drop("n_total")
    stop = F.col("start") + F.col("count")
    touched = F.explode(F.sequence(F.floor(F.col("start") / block_samples), F.floor((stop - 1) / block_samples)))
    wanted = requests.where(F.col("count") > 0).select("capture_id", "win", F.col("start").alias("_lo"), stop.alias("_hi"), touched.alias("block_index"))
    lo = F.greatest(F.col("_lo"), F.col("start")) - F.col("start")
    hi = F.least(F.col("_hi"), F.col("start") + F.col("n")) - F.col("start")
    def cut(c: str):
        return F.slice(c, (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int"))
    pieces = (blocks.join(wanted, ["capture_id", "block_index"]).where(hi > lo)
              .select("capture_id", "channel", "win", "_lo", "block_index", cut("i").alias("i"), cut("q").alias("q")))
    # at most the samples of one requested window per row
    whole = F.array_sort(F.collect_list(F.struct("block_index", "i", "q")))
    out = pieces.groupBy("capture_id", "channel", "win", "_lo").agg(whole.alias("_p"))
    return out.select("capture_id", "channel", "win", F.col("_lo").alias("start"), F.flatten("_p.i").alias("i"), F.flatten("_p.q").alias("q")
                      ).withColumn("n", F.size("i"))


def with_part_offsets(parts: DataFrame, target_rows: int | None = None) -> DataFrame:
    """parts (capture_id, part_index, n) -> plus [part_lo, part_hi) inside the capture. NULL part indexes come last."""
    filled = parts.withColumn("_order", F.coalesce(F.col("part_index"), F.lit(2147483647)))
    scan = ordered(filled, ["capture_id"], ["_order"], target_rows).running({"part_hi": (F.sum, F.col("n"))})
    return scan.frame().drop("_order").withColumn("part_lo", F.col("part_hi") - F.col("n"))


def parts_of_windows(parts: DataFrame, requests: DataFrame, cell: int) -> DataFrame:
    """The stored parts each window needs, with the sample range to read inside the part: only these are opened."""
    asked = requests.select("capture_id", "win", "start", (F.col("start") + F.col("count")).alias("stop"))
    hits = interval_overlap(asked, with_part_offsets(parts), ["capture_id"], ("start", "stop"), ("part_lo", "part_hi"), cell)
    return hits.withColumn("read_lo", F.greatest("start", "part_lo") - F.col("part_lo")).withColumn(
        "read_hi", F.least("stop", "part_hi") - F.col("part_lo"))


def stack_channels(windows: DataFrame) -> DataFrame:
    """(capture_id, win, channels, x array<array<float>>): channels of one window in name order, cut to the shortest."""
    g = windows.groupBy("capture_id", "win").agg(F.min(F.size("i")).alias("n"), F.array_sort(F.collect_list(F.struct("channel", "i"))).alias("c"))
    return g.select("capture_id", "win", "n", F.col("c.channel").alias("channels"),
                    F.transform("c", lambda s: F.slice(s["i"], 1, F.col("n"))).alias("x"))


def mean_channel(stacked: DataFrame) -> DataFrame:
    """Channels averaged sample by sample (an option; the default everywhere is a single channel)."""
    total = F.aggregate(F.slice("x", 2, F.lit(1 << 20)), F.transform(F.col("x")[0], lambda v: v.cast("double")),
                        lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b.cast("double")))
    return stacked.withColumn("x", F.transform(total, lambda v: (v / F.size(F.col("channels"))).cast("float")))


def stored_row(captures: DataFrame, tensor_rows: DataFrame) -> DataFrame:
    """Captures that are rows of one stored tensor, with their samples: equi-join on (stored_in, stored_index)."""
    return captures.where(F.col("stored_in").isNotNull()).join(tensor_rows, ["stored_in", "stored_index"])


def ordered_artifacts(artifacts: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Artifacts with their ``position`` inside the capture: in time order, unnumbered last, then by channel."""
    live = artifacts.where(F.col("capture_id").isNotNull()).withColumns(
        {"_at": F.coalesce("part_index", F.lit(2147483647)), "_ch": F.coalesce("channel", F.lit(""))})
    placed = ordered(live, ["capture_id"], ["_at", "_ch", "artifact_id"], target_rows).row_number("position").frame()
    return placed.withColumn("position", F.col("position") - 1).drop("_at", "_ch")
