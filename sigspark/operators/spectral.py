"""Spectra as tables. A spectrum is a row with a power array; a window's frames are rows (capture, win, frame, power).

Array expressions keep a whole spectrum in its row, so none of these operators shuffles except where frames of one
window must meet, and a window has a fixed length.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .features import power_frames


def frame_size(fs: float, bin_hz: float = 200e3) -> int:
    """Power of two nearest to fs / bin_hz on a log scale."""
    import math
    return 2 ** round(math.log2(fs / bin_hz))


def spectrogram(windows: DataFrame, nfft: int, keys: list[str]) -> DataFrame:
    """windows (keys, i, q) -> (keys, frame, power)."""
    return windows.select(*keys, F.posexplode(power_frames("i", "q", F.lit(nfft))).alias("frame", "power"))


def cells(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, bin, power): one row per time-frequency cell."""
    return frames.select(*keys, "frame", F.posexplode("power").alias("bin", "power"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def cumulative(power: pd.Series) -> pd.Series:
    """Running sum of an array, one pass over each."""
    return power.map(lambda p: None if p is None else np.cumsum(np.asarray(p, float)))


def crossing(upto: Column, share: float) -> Column:
    """First position (0-based) whose cumulative share reaches ``share``."""
    return F.size(F.filter(upto, lambda c: c / F.element_at(upto, -1) < share))


def occupied_band(spectra: DataFrame, keys: list[str], power: str = "power", lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """(keys, lo_bin, hi_bin): where the cumulative energy passes 0.5 % and 99.5 %."""
    return (spectra.withColumn("_u", cumulative(F.col(power)))
            .select(*keys, crossing(F.col("_u"), lo).alias("lo_bin"), crossing(F.col("_u"), hi).alias("hi_bin")))


def boxcar_peak(spectra: DataFrame, keys: list[str], power: str, half: int, centres: tuple[int, int] | None = None) -> DataFrame:
    """(keys, centre, energy): the largest sum over bins [c - half, c + half); the lowest centre wins ties."""
    n = F.size(power)
    upto = F.concat(F.array(F.lit(0.0)), F.col("_u"))
    first, last = (F.lit(centres[0]), F.lit(centres[1])) if centres else (F.lit(0), n - 1)
    sums = F.transform(F.sequence(first, last), lambda c: F.struct(
        (F.element_at(upto, (F.least(c + half, n) + 1).cast("int")) - F.element_at(upto, (F.greatest(c - half, F.lit(0)) + 1).cast("int"))).alias("energy"),
        (-c).alias("minus")))
    best = F.array_max(sums)
    return (spectra.withColumn("_u", cumulative(F.col(power))).select(*keys, best.alias("_b"))
            .select(*keys, (-F.col("_b.minus")).alias("centre"), F.col("_b.energy").alias("energy")))


def excess_over_median(power: Column) -> Column:
    """max(0, p - median) per bin of one spectrum."""
    s = F.array_sort(power)
    n = F.size(power)
    median = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.transform(power, lambda p: F.greatest(F.lit(0.0), p - median))


def band_energies(spectra: DataFrame, keys: list[str], power: str, bin_hz: Column | float, edges: tuple[float, float], bands: int) -> DataFrame:
    """(keys, band, energy, log_share): energy of equal bands [lo, hi) between two edges."""
    lo, width = edges[0], (edges[1] - edges[0]) / bands
    step = bin_hz if isinstance(bin_hz, Column) else F.lit(bin_hz)
    f = F.col("_k") * step
    long = spectra.select(*keys, F.posexplode(power).alias("_k", "_p"), step.alias("_step"))
    kept = long.where((f >= edges[0]) & (f < edges[1]))
    e = kept.groupBy(*keys, F.floor((f - lo) / width).alias("band")).agg(F.sum("_p").alias("energy"))
    total = Window.partitionBy(*keys)                            # at most ``bands`` rows per spectrum
    return e.withColumn("log_share", F.log10(F.col("energy") / F.sum("energy").over(total) + F.lit(1e-12)))


def mean_spectrum(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, power): bin-wise mean over frames. Partial sums per (keys, bin) are formed before the shuffle."""
    m = cells(frames, keys).groupBy(*keys, "bin").agg(F.avg("power").alias("p"))
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda s: s["p"]).alias("power"))


def band_over_median(spectra: DataFrame, keys: list[str], power: str, margin_db: float = 10.0) -> DataFrame:
    """(keys, lo_bin, hi_bin): first and last bin more than ``margin_db`` above the spectrum's median; NULL if none."""
    long = spectra.select(*keys, F.posexplode(power).alias("bin", "p"))
    long = long.withColumn("m", F.percentile("p", F.lit(0.5)).over(Window.partitionBy(*keys)))      # one spectrum per key
    up = F.col("p") > F.col("m") * 10 ** (margin_db / 10)
    return long.groupBy(*keys).agg(F.min(F.when(up, F.col("bin"))).alias("lo_bin"), F.max(F.when(up, F.col("bin"))).alias("hi_bin"))


def noise_floor(frames: DataFrame, keys: list[str], calibrated: DataFrame | None = None) -> DataFrame:
    """(keys, bin, floor): median over frames, capped at twice the 25th percentile of those medians.

    calibrated (keys or part of them, bin, floor) replaces the estimate. Whole frames are shuffled once to their window, not
    cells; a window's number of frames is fixed, so no group grows with the data.
    """
    if calibrated is not None:
        on = [k for k in keys if k in calibrated.columns]
        bins = cells(frames, keys).select(*keys, "bin").distinct()
        return bins.join(calibrated, [*on, "bin"]).select(*keys, "bin", "floor")
    source = frames.select(*keys, "power")

    def floors(group: pd.DataFrame) -> pd.DataFrame:
        middle = np.median(np.stack(group["power"].map(lambda p: np.asarray(p, float))), axis=0)
        out = pd.DataFrame({k: group[k].iloc[0] for k in keys} | {"bin": np.arange(len(middle)), "floor": np.minimum(middle, 2 * np.percentile(middle, 25))})
        return out[[*keys, "bin", "floor"]]
    out = T.StructType([*[source.schema[k] for k in keys], T.StructField("bin", T.IntegerType()), T.StructField("floor", T.DoubleType())])
    return source.groupBy(*keys).applyInPandas(floors, out)


def cfar_factor(pfa: float) -> float:
    """Threshold over a *median* floor for exponential noise: -ln(pfa) / ln 2."""
    import math
    return -math.log(pfa) / math.log(2)


def cfar_cells(frames: DataFrame, floor: DataFrame, keys: list[str], centre: int | None, pfa: float = 1e-3, dc_bins: int = 1) -> DataFrame:
    """(keys, frame, bin, power, floor) of cells that count as on.

    Cells within ``dc_bins`` of the centre are on only where both neighbours outside the notch are on. With centre None
    there is no notch.
    """
    x = cells(frames, keys).join(floor, [*keys, "bin"])
    on = F.col("power") > F.lit(cfar_factor(pfa)) * F.col("floor")
    if centre is None or not dc_bins:
        return x.where(on)
    left, right = centre - dc_bins - 1, centre + dc_bins + 1
    frame = Window.partitionBy(*keys, "frame")                   # one frame: a fixed number of bins
    sides = F.sum(F.when(on & F.col("bin").isin(left, right), 1).otherwise(0)).over(frame)
    notched = F.col("bin").between(centre - dc_bins, centre + dc_bins)
    return x.withColumn("_s", sides).where(F.when(notched, F.col("_s") == 2).otherwise(on)).drop("_s")


def tile_snr_cells(frames: DataFrame, total: DataFrame, keys: list[str], window_energy: float) -> DataFrame:
    """(keys, noise, snr) from cells; total (keys, total) is the mean sample power."""
    med = cells(frames, keys).groupBy(*keys, "bin").agg(F.percentile("power", F.lit(0.5)).alias("m"))
    noise = med.groupBy(*keys).agg((F.percentile("m", F.lit(0.25)) / F.log(F.lit(2.0)) / window_energy).alias("noise"))
    return noise.join(total, keys).select(*keys, "noise", (F.greatest(F.col("total") - F.col("noise"), F.col("total") * 1e-12) / F.col("noise")).alias("snr"))
