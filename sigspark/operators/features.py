"""Signal windows to feature columns. Rows hold whole windows as arrays; kernels run on Arrow batches in the tasks."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K

def _stacked(*columns: pd.Series):
    """Yield (positions, matrices) per common window length."""
    lengths = columns[0].map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, [np.stack([np.asarray(c.iloc[p], float) for p in at]) for c in columns]


def feature_struct(kernel: Callable[[np.ndarray, float], dict[str, np.ndarray]], names: list[str], is_complex: bool, **options):
    """A pandas UDF (i[, q], sample_rate) -> struct of doubles for one kernel."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def fill(fs: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        out = {n: np.full(len(fs), np.nan) for n in names}
        rates = fs.to_numpy(float)
        for at, parts in _stacked(*columns):
            x = parts[0] + 1j * parts[1] if is_complex else parts[0]
            for rate in np.unique(rates[at]):
                pick = rates[at] == rate
                for n, v in kernel(x[pick], float(rate), **options).items():
                    out[n][at[pick]] = v
        return pd.DataFrame(out)

    if is_complex:
        @F.pandas_udf(schema)
        def run(i: pd.Series, q: pd.Series, fs: pd.Series) -> pd.DataFrame:
            return fill(fs, i, q)
    else:
        @F.pandas_udf(schema)
        def run(x: pd.Series, fs: pd.Series) -> pd.DataFrame:
            return fill(fs, x)
    return run


def _numbered(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i:02d}" for i in range(n)]


AUDIO = [*_numbered("band_", 32), *[f"peakiness_{lo}_{hi}" for lo, hi in K.OCTAVES], "spectral_flatness", "spectral_centroid_hz", "modulation_cv"]
MFCC = [*_numbered("mfcc_mean_", 13), *_numbered("mfcc_std_", 13)]
TILE = [*_numbered("shape_q", 12), "occupied_bw_mhz", "active_bins_fraction", "spectral_flatness", "duty_cycle", "transitions", "frame_power_cv",
        "centroid_jump_mean", "centroid_spread", "frame_bw_mean", "frame_bw_std", "amplitude_kurtosis", "papr_db"]
WIDE = [*_numbered("band_", 24), "occupied_bw_mhz", "spectral_flatness", "envelope_active_fraction", "envelope_transitions", "envelope_cv"]
QUIET = ["bg_cell_cv", "bg_freq_cv", "bg_time_cv", "bg_quiet_bin_spread"]


def _spread(df: DataFrame, struct: Column, keep: list[str] | None) -> DataFrame:
    keep = [c for c in df.columns if c not in ("i", "q", "x")] if keep is None else keep
    return df.select(*keep, struct.alias("_f")).select(*keep, "_f.*")


def audio_features(windows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """windows: x array, sample_rate_hz."""
    return _spread(windows, feature_struct(K.audio_features, AUDIO, False)("x", "sample_rate_hz"), keep)


def mfcc_features(windows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _spread(windows, feature_struct(K.mfcc_features, MFCC, False)("x", "sample_rate_hz"), keep)


def band_signature(windows: DataFrame, unit_rms: bool = False, keep: list[str] | None = None) -> DataFrame:
    return _spread(windows, feature_struct(K.band_signature, _numbered("signature_", 32), False, unit_rms=unit_rms)("x", "sample_rate_hz"), keep)


def harmonic_prominence(windows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _spread(windows, feature_struct(K.harmonic_prominence, ["harmonic_db"], False)("x", "sample_rate_hz"), keep)


def high_frequency_share_db() -> Column:
    """Share of the top bands used as a range cue, from the columns of audio_features."""
    return 10 * F.log10(F.pow(F.lit(10.0), F.col("band_27")) + F.pow(F.lit(10.0), F.col("band_28")))


def channel_average(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Features of single channels averaged per window (never the samples: mixing channels invents cues)."""
    return features.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def tile_features(tiles: DataFrame, nfft: int = 128, keep: list[str] | None = None) -> DataFrame:
    """tiles: i, q arrays, sample_rate_hz."""
    return _spread(tiles, feature_struct(K.tile_features, TILE, True, nfft=nfft)("i", "q", "sample_rate_hz"), keep)


def wide_band_features(captures: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    return _spread(captures, feature_struct(K.wide_band_features, WIDE, False, **options)("x", "sample_rate_hz"), keep)


def quiet_half_features(tiles: DataFrame, nfft: int = 128, keep: list[str] | None = None) -> DataFrame:
    def kernel(x, _fs, nfft):
        return K.quiet_half_features(x, nfft)
    return _spread(tiles, feature_struct(kernel, QUIET, True, nfft=nfft)("i", "q", "sample_rate_hz"), keep)


def tile_snr(tiles: DataFrame, nfft: int = 128, keep: list[str] | None = None) -> DataFrame:
    def kernel(x, _fs, nfft):
        return dict(zip(("snr", "noise", "total"), K.tile_snr(x, nfft)))
    return _spread(tiles, feature_struct(kernel, ["snr", "noise", "total"], True, nfft=nfft)("i", "q", "sample_rate_hz"), keep)


# ------------------------------------------------------------------ arrays in, arrays out
def _tile_udf(extra: dict[str, str], kernel):
    """pandas UDF (i, q, parameters...) -> struct(i, q, extra...); kernel(matrix, parameter arrays) per window length.
    Rows whose parameters differ are handled as separate matrices."""
    schema = "i array<float>, q array<float>" + "".join(f", {n} {t}" for n, t in extra.items())

    @F.pandas_udf(schema)
    def run(i: pd.Series, q: pd.Series, p: pd.DataFrame) -> pd.DataFrame:
        out = {n: np.empty(len(i), object) for n in ("i", "q", *extra)}
        values = p.to_numpy(float)
        for at, (re, im) in _stacked(i, q):
            for row in np.unique(values[at], axis=0):
                pick = np.all(values[at] == row, axis=1)
                results = kernel((re + 1j * im)[pick], *row)
                for pos, r in enumerate(at[pick]):
                    tile = results[0][pos]
                    out["i"][r], out["q"][r] = tile.real.astype(np.float32), tile.imag.astype(np.float32)
                    for name, v in zip(extra, results[1:]):
                        out[name][r] = v[pos]
        return pd.DataFrame(out)

    return run


def _replace_tile(df: DataFrame, struct: Column, extra: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in ("i", "q")]
    return df.select(*keep, struct.alias("_t")).select(*keep, "_t.i", "_t.q", *[f"_t.{e}" for e in extra])


def recentred_tiles(blocks: DataFrame, centre: float, width: float, real: bool = False) -> DataFrame:
    """blocks of 250 us with sample_rate_hz and center_frequency_hz -> tiles plus ``coverage``."""
    def kernel(x, fs, fc):
        return K.recentred_tile(x.real if real else x, fs, fc, centre, width, real)
    p = F.struct(F.col("sample_rate_hz").cast("double"), F.coalesce(F.col("center_frequency_hz").cast("double"), F.lit(0.0)))
    return _replace_tile(blocks, _tile_udf({"coverage": "double"}, kernel)("i", "q", p), ["coverage"])


def steered_tiles(blocks: DataFrame, width: float, search: tuple[float, float] | None = None, real: bool = False) -> DataFrame:
    """Tiles steered to the strongest activity, plus ``centre_hz``. Without ``search`` the receiver's whole band."""
    def kernel(x, fs, fc):
        band = search or (fc - fs / 2, fc + fs / 2)
        return K.steered_tile(x.real if real else x, fs, fc, width, band, real)
    p = F.struct(F.col("sample_rate_hz").cast("double"), F.coalesce(F.col("center_frequency_hz").cast("double"), F.lit(0.0)))
    return _replace_tile(blocks, _tile_udf({"centre_hz": "double"}, kernel)("i", "q", p), ["centre_hz"])


def notched_tiles(tiles: DataFrame) -> DataFrame:
    """DC leakage removed. Optional: the notch itself can mark a receiver."""
    def kernel(x, fs, _):
        return (K.without_dc(x, fs),)
    p = F.struct(F.col("sample_rate_hz").cast("double"), F.lit(0.0))
    return _replace_tile(tiles, _tile_udf({}, kernel)("i", "q", p), [])


def equalised_tiles(tiles: DataFrame, target_snr: float, key: list[str], seed: int = 0) -> DataFrame:
    """Noise added so that no tile exceeds ``target_snr``; ``changed`` tells which. Each row has its own seed."""
    def kernel(x, row_seed, _):
        y, changed = K.add_noise_to_snr(x, target_snr, np.full(len(x), row_seed))
        return y, changed.astype(float)
    # 52 bits survive the trip through a double
    p = F.struct((F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52))).cast("double"), F.lit(0.0))
    return _replace_tile(tiles, _tile_udf({"changed": "double"}, kernel)("i", "q", p), ["changed"])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def tile_image(i: pd.Series, q: pd.Series) -> pd.Series:
    """Standardised log-power image (bins x frames) of each tile."""
    out = np.empty(len(i), object)
    for at, (re, im) in _stacked(i, q):
        for pos, image in zip(at, K.tile_image(re + 1j * im)):
            out[pos] = list(image.astype(np.float32))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def power_frames(i: pd.Series, q: pd.Series, nfft: pd.Series) -> pd.Series:
    """Frames x bins power of a window: Blackman-Harris frames without overlap, zero frequency in the middle."""
    out, sizes = np.empty(len(i), object), nfft.to_numpy(int)
    for at, (re, im) in _stacked(i, q):
        for n in np.unique(sizes[at]):
            pick = sizes[at] == n
            for pos, cells in zip(at[pick], K.power_cells(re[pick] + 1j * im[pick], K.blackman_harris(int(n)))):
                out[pos] = list(cells)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum_power(i: pd.Series, q: pd.Series) -> pd.Series:
    """|DFT|^2 of each window, natural bin order."""
    out = np.empty(len(i), object)
    for at, (re, im) in _stacked(i, q):
        for pos, p in zip(at, np.abs(np.fft.fft(re + 1j * im, axis=1)) ** 2):
            out[pos] = p
    return pd.Series(out)


def welch_density(segment: int):
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, fs: pd.Series) -> pd.Series:
        out, rates = np.empty(len(x), object), fs.to_numpy(float)
        for at, (m,) in _stacked(x):
            for rate in np.unique(rates[at]):
                pick = rates[at] == rate
                for pos, p in zip(at[pick], K.welch(m[pick], rate, segment)[1]):
                    out[pos] = p
        return pd.Series(out)
    return run


def resampled(up: int, down: int):
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = np.empty(len(x), object)
        for at, (m,) in _stacked(x):
            for pos, y in zip(at, K.resample(m, up, down)):
                out[pos] = y
        return pd.Series(out)
    return run
