"""Bursts and emitters. A window has a fixed number of frames, so "one window per call" is bounded whatever the data.

windows -> bursts runs inside the window (``window_bursts``); everything about emitters is ordinary Spark on the
bursts table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import kernels as K
from .spectral import cfar_factor, frame_size

# Fixed values
GAP_FRAMES = 4                 # longest bridged gap; gaps touching the outer two frames stay open
MIN_CELLS = 3
SHAPE_OCTAVES = 0.5
EMITTERS_KEPT = 3
WIFI_WIDTHS = ((14e6, 22e6), (30e6, 44e6))
WIFI_RATE, WIFI_LAG, WIFI_SPAN, WIFI_RUN, WIFI_THRESHOLD = 20_000_000, 16, 64, 33, 0.75
HEAD_BEFORE_S, HEAD_S = 5e-6, 25e-6

BURST_FIELDS = ("burst int, t0 double, t1 double, f_lo double, f_hi double, cells long, snr_db double, "
                "occ_lo double, occ_hi double")
BURST_COLUMNS = [f.split()[0] for f in BURST_FIELDS.split(", ")]


# ------------------------------------------------------------------ one window
def floor_of(power: np.ndarray) -> np.ndarray:
    per_bin = np.median(power, axis=0)
    return np.minimum(per_bin, 2 * np.percentile(per_bin, 25))


def on_cells(power: np.ndarray, floor: np.ndarray, pfa: float, dc_bins: int, centre: int | None) -> np.ndarray:
    mask = power > cfar_factor(pfa) * floor
    if centre is not None and dc_bins:
        both = mask[:, centre - dc_bins - 1] & mask[:, centre + dc_bins + 1]
        mask[:, centre - dc_bins: centre + dc_bins + 1] = both[:, None]
    return mask


def bridge(mask: np.ndarray) -> np.ndarray:
    """Fill gaps of up to four frames per bin: an off cell is filled if every frame within two of it lies within two
    frames of an on cell, and all those frames exist."""
    n = len(mask)
    padded = np.pad(mask, ((2, 2), (0, 0)))
    near = np.logical_or.reduce([padded[k:k + n] for k in range(5)])
    padded = np.pad(near, ((2, 2), (0, 0)))
    return mask | np.logical_and.reduce([padded[k:k + n] for k in range(5)])


def label_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(frame, lo, hi, component) of the horizontal runs of a mask; runs of neighbouring frames that touch, corners
    included, share a component. Components are named by their first run in scan order."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    frame, lo = np.nonzero(edges == 1)
    hi = np.nonzero(edges == -1)[1] - 1
    stride = mask.shape[1] + 4
    first = np.searchsorted(frame * stride + hi, (frame - 1) * stride + lo - 1, "left")
    last = np.searchsorted(frame * stride + lo, (frame - 1) * stride + hi + 1, "right")
    count = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(lo)), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    name = np.arange(len(lo))
    while len(below):
        a, b = name[below], name[above]
        if np.array_equal(a, b):
            break
        np.minimum.at(name, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = name[name]
            if np.array_equal(deeper, name):
                break
            name = deeper
    return frame, lo, hi, name


def find_bursts(power: np.ndarray, floor: np.ndarray, mask: np.ndarray, frame_s: float, bin_hz: float,
                min_cells: int = MIN_CELLS) -> pd.DataFrame:
    """Connected detections of one window as boxes with peak SNR and the band holding 99 % of the excess energy."""
    bridged = bridge(mask)
    frame, lo, hi, name = label_runs(bridged)
    if not len(name):
        return pd.DataFrame(columns=BURST_COLUMNS)
    length = hi - lo + 1
    _, member = np.unique(name, return_inverse=True)
    cells = np.bincount(member, weights=length).astype(int)
    at_frame, at_bin = np.nonzero(bridged)
    burst = np.repeat(member, length)
    big = cells[burst] >= min_cells
    at_frame, at_bin, burst = at_frame[big], at_bin[big], burst[big]
    p, fl = power[at_frame, at_bin], floor[at_bin]
    t = pd.DataFrame({"burst": burst, "frame": at_frame, "bin": at_bin, "ratio": p / fl, "excess": np.maximum(p - fl, 0)})
    out = t.groupby("burst").agg(f0=("frame", "min"), f1=("frame", "max"), b0=("bin", "min"), b1=("bin", "max"), ratio=("ratio", "max"))
    per_bin = t.groupby(["burst", "bin"], as_index=False)["excess"].sum()
    whole = per_bin.groupby("burst")["excess"]
    share = whole.cumsum() / (whole.transform("sum") + K.TINY)
    # bins of a box without cells of the burst add nothing, so the crossing is at a bin that has some
    edge_lo = per_bin["bin"].where(share >= 0.005).groupby(per_bin["burst"]).min()
    edge_hi = per_bin["bin"].where(share >= 0.995).groupby(per_bin["burst"]).min()
    empty = whole.sum() <= 0
    edge_lo, edge_hi = edge_lo.where(~empty, out["b1"] + 1), edge_hi.where(~empty, out["b1"] + 1)
    half = power.shape[1] // 2

    def hz(bins: pd.Series, side: float) -> pd.Series:
        return (bins - half + side) * bin_hz

    out = pd.DataFrame({"burst": np.arange(len(out)), "t0": out["f0"] * frame_s, "t1": (out["f1"] + 1) * frame_s, "f_lo": hz(out["b0"], -0.5),
                        "f_hi": hz(out["b1"], 0.5), "cells": cells[out.index], "snr_db": 10 * np.log10(out["ratio"]),
                        "occ_lo": hz(edge_lo, -0.5), "occ_hi": hz(edge_hi, 0.5)})
    return out[BURST_COLUMNS]                                     # numbered in scan order of the first cell


# ------------------------------------------------------------------ windows -> bursts
def window_bursts(windows: DataFrame, keys: list[str], pfa: float = 1e-3, nfft: int | None = None, floors: dict | None = None) -> DataFrame:
    """windows (keys, i, q, sample_rate_hz) -> one row per burst (keys, BURST_FIELDS, duration_s, sample_rate_hz, head_i, head_q).

    No shuffle: each row is a whole window. ``head`` holds the first samples of bursts as wide as Wi-Fi, so that the
    recogniser needs no second look at the window. ``floors`` maps a key tuple prefix to a calibrated floor array.
    """
    schema = windows.select(*keys).schema
    out_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    out_ddl += f", {BURST_FIELDS}, duration_s double, sample_rate_hz double, head_i array<float>, head_q array<float>"

    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                fs = float(row.sample_rate_hz)
                x = np.asarray(row.i, np.float64) + 1j * np.asarray(row.q, np.float64)
                n = nfft or frame_size(fs)
                if len(x) < n:
                    continue
                power = K.power_cells(x[None, :], K.blackman_harris(n))[0].astype(np.float32)
                given = (floors or {}).get(getattr(row, keys[0]))
                floor = floor_of(power) if given is None else np.asarray(given, np.float32)
                found = find_bursts(power, floor, on_cells(power, floor, pfa, 1, n // 2), n / fs, fs / n)
                if not len(found):
                    continue
                for k in keys:
                    found[k] = getattr(row, k)
                found["duration_s"], found["sample_rate_hz"] = len(x) / fs, fs
                width = found["occ_hi"] - found["occ_lo"]
                wide = np.logical_or.reduce([(width >= a) & (width <= c) for a, c in WIFI_WIDTHS])
                starts = np.maximum(0, ((found["t0"] - HEAD_BEFORE_S) * fs).astype(int))
                heads = [x[s:s + int(HEAD_S * fs)] if w else None for s, w in zip(starts, wide)]
                found["head_i"] = [None if h is None else h.real.astype(np.float32) for h in heads]
                found["head_q"] = [None if h is None else h.imag.astype(np.float32) for h in heads]
                yield found[[*keys, *BURST_COLUMNS, "duration_s", "sample_rate_hz", "head_i", "head_q"]]

    return windows.select(*keys, "i", "q", "sample_rate_hz").mapInPandas(run, out_ddl)


def bursts_of_frames(frames: DataFrame, floor: DataFrame, keys: list[str], frame_s: float, bin_hz: float, pfa: float = 1e-3,
                     centre: int | None = None, min_cells: int = MIN_CELLS) -> DataFrame:
    """Bursts from frame rows (keys, frame, power) and a floor table (keys, bin, floor): for material that is already
    stored as spectra. Keys must name one window of fixed length. Shuffle key: keys."""
    schema = frames.select(*keys).schema
    out_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + f", {BURST_FIELDS}"
    floors = floor.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "floor"))), lambda s: s["floor"]).alias("floor"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        power, fl = np.stack(pdf["power"].to_numpy()), np.asarray(pdf["floor"].iloc[0])
        found = find_bursts(power, fl, on_cells(power, fl, pfa, 1, centre), frame_s, bin_hz, min_cells)
        for k in keys:
            found[k] = pdf[k].iloc[0]
        return found[[*keys, *BURST_COLUMNS]]

    return frames.select(*keys, "frame", "power").join(floors, keys).groupBy(*keys).applyInPandas(run, out_ddl)


# ------------------------------------------------------------------ bursts -> emitters
def bandwidth() -> Column:
    return F.col("occ_hi") - F.col("occ_lo")


def centre_hz() -> Column:
    return (F.col("occ_hi") + F.col("occ_lo")) / 2


def group_bursts(bursts: DataFrame, keys: list[str], bin_hz: float | Column, frame_s: float | Column) -> DataFrame:
    """Add ``emitter``: bursts taken by descending cell count join the first emitter whose first member lies within half
    an octave in bandwidth and duration.

    The rule is sequential, so it is a fold over the bursts of one window (bounded by the window's cells). The state is
    the list of first members.
    """
    step = F.lit(bin_hz) if not isinstance(bin_hz, Column) else bin_hz
    shortest = F.lit(frame_s) if not isinstance(frame_s, Column) else frame_s
    shape = F.struct((-F.col("cells")).alias("minus_cells"), F.col("burst"), F.log2(F.greatest(bandwidth(), step)).alias("bw"),
                     F.log2(F.greatest(F.col("t1") - F.col("t0"), shortest)).alias("dur"), F.struct(*bursts.columns).alias("row"))
    listed = bursts.groupBy(*keys).agg(F.array_sort(F.collect_list(shape)).alias("_s"))

    def fits(g, s):
        return (F.abs(s["bw"] - g["bw"]) <= SHAPE_OCTAVES) & (F.abs(s["dur"] - g["dur"]) <= SHAPE_OCTAVES)

    start = F.struct(F.array().cast("array<struct<bw:double,dur:double>>").alias("firsts"), F.array().cast("array<int>").alias("out"))

    def step_fn(acc, s):
        hit = F.transform(acc["firsts"], lambda g: fits(g, s))
        where = F.array_position(hit, F.lit(True)).cast("int")
        new = F.struct(s["bw"].alias("bw"), s["dur"].alias("dur"))
        at = F.when(where > 0, where - 1).otherwise(F.size(acc["firsts"]))
        return F.struct(F.when(where > 0, acc["firsts"]).otherwise(F.concat(acc["firsts"], F.array(new))).alias("firsts"),
                        F.concat(acc["out"], F.array(at.cast("int"))).alias("out"))

    chosen = listed.select("_s", F.aggregate("_s", start, step_fn, lambda acc: acc["out"]).alias("_e"))
    paired = chosen.select(F.explode(F.arrays_zip("_s", "_e")).alias("_z"))
    return paired.select("_z._s.row.*", F.col("_z._e").alias("emitter"))


def emitters(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Behaviour of each emitter: (keys, emitter, blobs, bandwidth_hz, burst_s, hop_set, span_hz, interval_s, interval_cv,
    duty, snr_db, continuous, rank). Undefined intervals are NULL. Windows are per (keys, emitter): bounded by a window.
    """
    k = [*keys, "emitter"]
    length = F.col("t1") - F.col("t0")
    by_time = Window.partitionBy(*k).orderBy("t0", "burst")
    by_centre = Window.partitionBy(*k).orderBy("_c", "burst")
    rows = (grouped.withColumn("_c", centre_hz()).withColumn("_gap", F.col("t0") - F.lag("t0").over(by_time))
            .withColumn("_apart", F.col("_c") - F.lag("_c").over(by_centre)))
    rows = rows.withColumn("bandwidth_hz", F.percentile(bandwidth(), F.lit(0.5)).over(Window.partitionBy(*k)))
    gaps_mean, gaps_sd = F.avg("_gap"), F.stddev_pop("_gap")
    agg = (rows.groupBy(*k, "bandwidth_hz").agg(
        F.count("*").alias("blobs"), F.percentile(length, F.lit(0.5)).alias("burst_s"),
        (1 + F.sum(F.when(F.col("_apart") > 0.5 * F.col("bandwidth_hz"), 1).otherwise(0))).alias("hop_set"),
        (F.max("f_hi") - F.min("f_lo")).alias("span_hz"), F.percentile("_gap", F.lit(0.5)).alias("interval_s"),
        F.when((F.count("_gap") > 1) & (gaps_mean > 0), gaps_sd / gaps_mean).alias("interval_cv"),
        F.least(F.lit(1.0), F.sum(length) / F.max("duration_s")).alias("duty"), F.percentile("snr_db", F.lit(0.5)).alias("snr_db"),
        (F.max(length) > 0.5 * F.max("duration_s")).alias("continuous")))
    by_size = Window.partitionBy(*keys).orderBy((-F.col("blobs") * F.col("burst_s")), "emitter")
    return agg.withColumn("rank", F.row_number().over(by_size) - 1)


def emitter_vectors(found: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window: the three dominant emitters' behaviour and the number with at least five bursts. Windows
    without emitters keep a row; what does not exist is NULL."""
    def log10_positive(c: str) -> Column:
        return F.when(F.col(c) > 0, F.log10(c))
    values = {"log_bw": F.log10("bandwidth_hz"), "log_burst": F.log10("burst_s"), "hop_set": F.col("hop_set").cast("double"),
              "span_mhz": F.col("span_hz") / 1e6, "log_interval": log10_positive("interval_s"), "interval_cv": F.col("interval_cv"),
              "duty": F.col("duty"), "continuous": F.col("continuous").cast("double")}
    picks = [F.max(F.when(F.col("rank") == r, v)).alias(f"e{r}_{n}") for r in range(EMITTERS_KEPT) for n, v in values.items()]
    v = found.groupBy(*keys).agg(F.sum(F.when(F.col("blobs") >= 5, 1.0).otherwise(0.0)).alias("n_emitters_5"), *picks)
    return windows.select(*keys).distinct().join(v, keys, "left").fillna(0.0, ["n_emitters_5"])


def analyse(windows: DataFrame, keys: list[str], pfa: float = 1e-3) -> DataFrame:
    """windows -> emitters. Frame length and bin width follow from the window's own sample rate."""
    fs = F.col("sample_rate_hz")
    n = F.pow(F.lit(2.0), F.bround(F.log2(fs / 200e3)))
    bursts = window_bursts(windows, keys, pfa).drop("head_i", "head_q")
    return emitters(group_bursts(bursts, keys, fs / n, n / fs), keys)


# ------------------------------------------------------------------ Wi-Fi
def lag_correlation(x: np.ndarray, fs: float, centre: float) -> np.ndarray:
    """Normalised autocorrelation at 0.8 us over 3.2 us, after shifting to ``centre`` and resampling to 20 MS/s."""
    from fractions import Fraction
    y = x * np.exp(-2j * np.pi * centre / fs * np.arange(len(x)))
    ratio = Fraction(WIFI_RATE, int(round(fs))).limit_denominator(1000)
    y = (K.resample(y.real[None, :], ratio.numerator, ratio.denominator)
         + 1j * K.resample(y.imag[None, :], ratio.numerator, ratio.denominator))[0]
    if len(y) < WIFI_LAG + WIFI_SPAN:
        return np.zeros(0)

    def moving(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(v)])
        return total[WIFI_SPAN:] - total[:-WIFI_SPAN]

    energy = np.abs(y) ** 2
    both = np.maximum(moving(energy[WIFI_LAG:]), 0) * np.maximum(moving(energy[:-WIFI_LAG]), 0)
    return np.abs(moving(y[WIFI_LAG:] * np.conj(y[:-WIFI_LAG]))) / (np.sqrt(both) + K.TINY)


@F.pandas_udf(T.BooleanType())
def has_training_field(head_i: pd.Series, head_q: pd.Series, centre: pd.Series, fs: pd.Series) -> pd.Series:
    out = []
    for i, q, c, rate in zip(head_i, head_q, centre, fs):
        if i is None or len(i) == 0:
            out.append(False)
            continue
        high = lag_correlation(np.asarray(i, float) + 1j * np.asarray(q, float), float(rate), float(c)) > WIFI_THRESHOLD
        runs = np.diff(np.flatnonzero(np.diff(np.r_[0, high.astype(int), 0])))[::2]
        out.append(bool(len(runs) and runs.max() >= WIFI_RUN))
    return pd.Series(out)


def with_wifi_flag(bursts: DataFrame, fs: str = "sample_rate_hz") -> DataFrame:
    """Bursts plus ``wifi``: 20 or 40 MHz wide and opening with a sustained short training field."""
    return bursts.withColumn("wifi", F.when(F.col("head_i").isNotNull(), has_training_field("head_i", "head_q", centre_hz(), F.col(fs))).otherwise(False))
