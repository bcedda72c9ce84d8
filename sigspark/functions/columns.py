"""Column expressions shared by the operators. Everything here stays inside Catalyst."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_RMS = 1e-6


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp; independent of the session time zone."""
    whole = (F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400
             + F.hour(ts) * 3600 + F.minute(ts) * 60)
    return whole * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


def seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as 0)."""
    return F.when(condition, 1).otherwise(0)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0 (precision, recall and F1 of an empty class)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den != 0, den))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ------------------------------------------------------------------ arrays of samples
def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def array_mean(x: Column) -> Column:
    return array_sum(x) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")) / F.size(x))


def level_dbfs(x: Column) -> Column:
    """Loudness of one window, dB relative to full scale."""
    return 20 * F.log10(rms(x) + F.lit(1e-12))


def log_rms_iq(i: Column, q: Column) -> Column:
    power = F.aggregate(F.arrays_zip(i.alias("re"), q.alias("im")), F.lit(0.0),
                        lambda acc, s: acc + s["re"].cast("double") ** 2 + s["im"].cast("double") ** 2)
    return F.log10(F.sqrt(power / F.size(i)) + F.lit(1e-12))


def is_audible(x: Column) -> Column:
    return rms(x) > SILENCE_RMS


def array_gcd(codes: Column) -> Column:
    """Greatest common divisor of integer codes: the quantisation step actually used."""
    def euclid(a: Column, b: Column) -> Column:
        # 63-bit integers need at most 91 division steps
        pair = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(91)), pair,
                           lambda p, _: F.when(p["b"] == 0, p).otherwise(
                               F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] != 0, p["b"])).alias("b"))))["a"]
    return F.aggregate(codes, F.lit(0).cast("long"), lambda g, c: euclid(g, c.cast("long")))


def is_quantised(x: Column, scale: float, tolerance: float = 1e-6) -> Column:
    """True if every value is an integer multiple of 1/scale."""
    return F.forall(x, lambda v: F.abs(v.cast("double") * scale - F.bround(v.cast("double") * scale)) <= tolerance)


def hash_order(seed: int, *cols: str) -> Column:
    """The order used by every seeded sample and shuffle."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


# ------------------------------------------------------------------ names, paths, dates
def has_drive_path(value: Column) -> Column:
    return F.coalesce(value.rlike(r"[:\\]"), F.lit(False))


def dataset_of(entity_id: Column) -> Column:
    return F.split(entity_id, "/")[0]


def unit_model(unit: Column) -> Column:
    """Unit name without its trailing ``_number``."""
    return F.regexp_replace(unit, "_[^_]*$", "")


def empty_to_null(value: Column, *sentinels: str) -> Column:
    return F.when(value.isin("", *sentinels), None).otherwise(value)


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[empty_to_null(v) for v in values])


def iso_timestamp(text: Column, pattern: str) -> Column:
    """Zone-less ISO text from a release's own date format. Weekday names in front must be stripped first."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.date_format(F.to_timestamp_ntz(squeezed, F.lit(pattern)), "yyyy-MM-dd'T'HH:mm:ss")


def strip_weekday(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^\p{Alpha}+\s+", "")


def capture_length(duration_s: Column, sample_rate_hz: Column, empty: bool = False) -> Column:
    """Samples per channel if the catalog knows both figures, else NULL. Half-even rounding. A duration of 0 counts as not
    known, as a catalog writes it; with ``empty`` it is that of a capture without samples."""
    known = (duration_s >= 0 if empty else duration_s > 0) & (sample_rate_hz > 0)
    return F.when(known, F.bround(duration_s * sample_rate_hz).cast("long"))


def evenly_spaced(total: Column, block: Column, n: int) -> Column:
    """n integer starts spread over [0, total - block], truncated towards zero."""
    if n == 1:
        return F.array(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda k: F.floor(k * (total - block).cast("double") / F.lit(n - 1)).cast("long"))


def prefixed(columns: list[str], *prefixes: str) -> list[str]:
    """Feature columns by name prefix, sorted by name."""
    return sorted(c for c in columns if c.startswith(tuple(prefixes)))
