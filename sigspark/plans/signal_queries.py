"""Registered queries over sampled signals. ``embeddings`` supplies the samples: each vector is a 64-sample block, the
blocks of one label in vec_id order are one capture."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import activity, features, neighbours, spectral
from ..operators.scan import ordered
from ..sources import blocks
from .tables import load, r6

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BLOCK = 64
WINDOW_FRAMES = 50          # frames of one stored window


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x array<double>)"""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def signal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a block table: capture = label, in-phase the vector, quadrature the vector reversed."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    numbered = ordered(e, ["label"], ["vec_id"]).row_number("rn").frame()
    at = F.col("rn") - 1
    return numbered.select(F.concat(F.lit("emb/"), F.col("label")).alias("capture_id"), F.lit("IQ").alias("channel"), at.alias("block_index"),
                           (at * BLOCK).alias("start"), F.lit(BLOCK).alias("n"), F.col("embedding").alias("i"), F.reverse("embedding").alias("q"))


def windows_of(spark, sf_dir, length: int, stride: int | None = None) -> DataFrame:
    """Windows of the derived captures with a sample rate, for the kernels."""
    b = signal_blocks(spark, sf_dir)
    asked = blocks.fixed_windows(blocks.capture_extents(b), length, stride)
    return blocks.read_windows(b, asked, BLOCK).where(F.col("n") == length)


# ------------------------------------------------------------------ SQL fragments
_X = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings)"
_DFT = f"""{_X}, tw AS (SELECT k, n, cos(2 * pi() * k * n / 64) AS c, sin(2 * pi() * k * n / 64) AS s FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(64)) AS n)),
p AS (SELECT vec_id, any_value(label) AS label, k, pow(sum(x * c), 2) + pow(sum(x * s), 2) AS power FROM v JOIN tw USING (n) GROUP BY vec_id, k)"""
_BLOCKS = """b AS (SELECT 'emb/' || label::VARCHAR AS capture_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS blk, embedding AS e, list_reverse(embedding) AS r FROM embeddings),
s AS (SELECT capture_id, blk * 64 + n AS pos, e[n + 1]::DOUBLE AS i, r[n + 1]::DOUBLE AS q FROM b, (SELECT unnest(range(64)) AS n))"""
# frames of the stored-spectrum fixture: capture = label, window = 50 consecutive vectors of the label, bins = 64 squared values
_FRAMES = f"""f0 AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings),
c AS (SELECT label, rn // {WINDOW_FRAMES} AS win, rn % {WINDOW_FRAMES} AS frame, n AS bin, x * x AS power FROM f0 JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings) USING (vec_id)),
med AS (SELECT label, win, bin, quantile_cont(power, 0.5) AS m FROM c GROUP BY ALL), q AS (SELECT label, win, quantile_cont(m, 0.25) AS q FROM med GROUP BY ALL),
fl AS (SELECT label, win, bin, least(m, 2 * q) AS floor FROM med JOIN q USING (label, win))"""


def stored_frames(spark, sf_dir) -> DataFrame:
    e = ordered(vectors(spark, sf_dir), ["label"], ["vec_id"]).row_number("rn").frame().withColumn("at", F.col("rn") - 1)
    return e.select("label", F.floor(F.col("at") / WINDOW_FRAMES).alias("win"), (F.col("at") % WINDOW_FRAMES).cast("int").alias("frame"),
                    F.transform("x", lambda v: v * v).alias("power"))


# ------------------------------------------------------------------ windows
@register("signal_windows", f"""WITH {_BLOCKS}, e AS (SELECT capture_id, max(pos) + 1 AS n FROM s GROUP BY 1),
w AS (SELECT capture_id, unnest(range(0, n - 99, 90)) AS start FROM e)
SELECT w.capture_id, w.start, count(*)::INT AS n, round(sum(i), 4) AS sum_i, round(sum(q), 4) AS sum_q, round(arg_min(i, pos), 6) AS first_i, round(arg_max(q, pos), 6) AS last_q
FROM w JOIN s ON s.capture_id = w.capture_id AND s.pos >= w.start AND s.pos < w.start + 100 GROUP BY ALL""")
def signal_windows(spark, sf_dir):
    b = signal_blocks(spark, sf_dir)
    asked = blocks.fixed_windows(blocks.capture_extents(b), 100, 90)
    w = blocks.read_windows(b, asked, BLOCK)
    return w.select("capture_id", "start", "n", F.round(C.array_sum(F.col("i")), 4).alias("sum_i"), F.round(C.array_sum(F.col("q")), 4).alias("sum_q"),
                    F.round(F.col("i")[0].cast("double"), 6).alias("first_i"), F.round(F.element_at("q", -1).cast("double"), 6).alias("last_q"))


@register("open_ended_window", f"""WITH {_BLOCKS} SELECT capture_id, count(*)::INT AS n, round(sum(i), 4) AS sum_i FROM s WHERE pos >= 70 GROUP BY 1""")
def open_ended_window(spark, sf_dir):
    # to the end is a large request by nature: the touched blocks are reduced one by one, never stitched
    pieces = signal_blocks(spark, sf_dir).where(F.col("start") + F.col("n") > 70)
    kept = pieces.select("capture_id", F.slice("i", F.greatest(F.lit(1), 71 - F.col("start")).cast("int"), BLOCK).alias("i"))
    return kept.groupBy("capture_id").agg(F.sum(F.size("i")).cast("int").alias("n"), F.round(F.sum(C.array_sum(F.col("i"))), 4).alias("sum_i"))


@register("stride_windows", f"""WITH {_BLOCKS}, e AS (SELECT capture_id, max(pos) + 1 AS n FROM s GROUP BY 1), w AS (SELECT capture_id, n, k FROM e, (SELECT unnest(range(50)) AS k))
SELECT capture_id, k::INT AS win, (k * 40)::BIGINT AS start, 10::BIGINT AS count FROM w WHERE k * 40 + 10 <= n""")
def stride_windows(spark, sf_dir):
    """One window every four window lengths, at most fifty per capture."""
    return blocks.fixed_windows(blocks.capture_extents(signal_blocks(spark, sf_dir)), 10, 40, 50)


@register("spaced_window_starts", f"""WITH {_BLOCKS}, e AS (SELECT capture_id, max(pos) + 1 AS n FROM s GROUP BY 1), k AS (SELECT unnest(range(7)) AS win)
SELECT capture_id, win::INT AS win, floor(win * (n - 200) / 6)::BIGINT AS start, 200::BIGINT AS count FROM e, k""")
def spaced_window_starts(spark, sf_dir):
    return blocks.spaced_windows(blocks.capture_extents(signal_blocks(spark, sf_dir)), 200, 7)


@register("chunk_window_starts", f"""WITH {_BLOCKS}, e AS (SELECT capture_id, max(pos) + 1 AS n FROM s GROUP BY 1),
t AS (SELECT capture_id, n, unnest(range(0, (n - 1) // 1000 + 1)) * 1000 AS c FROM e), w AS (SELECT capture_id, n, c + k * 100 AS start FROM t, (SELECT unnest(range(3)) AS k))
SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY start) - 1)::INT AS win, start::BIGINT AS start, 100::BIGINT AS count FROM w WHERE start + 100 <= n""")
def chunk_window_starts(spark, sf_dir):
    return blocks.chunk_start_windows(blocks.capture_extents(signal_blocks(spark, sf_dir)), 1000, 100, 3)


@register("window_parts", """WITH p AS (SELECT l_suppkey AS capture_id, row_number() OVER w - 1 AS part_index, l_quantity::BIGINT AS n, sum(l_quantity::BIGINT) OVER w AS hi FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w AS (SELECT s_suppkey AS capture_id, k AS win, k * 997 AS start, k * 997 + 60 AS stop FROM supplier, (SELECT unnest(range(12)) AS k))
SELECT w.capture_id, win::INT AS win, part_index, (greatest(start, hi - n) - (hi - n))::BIGINT AS read_lo, (least(stop, hi) - (hi - n))::BIGINT AS read_hi
FROM w JOIN p ON w.capture_id = p.capture_id AND greatest(start, hi - n) < least(stop, hi)""")
def window_parts(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    l = load(spark, sf_dir, "lineitem").select("l_suppkey", *order)
    parts = ordered(l, ["l_suppkey"], order).row_number("rn").frame().select(
        F.col("l_suppkey").alias("capture_id"), (F.col("rn") - 1).alias("part_index"), F.col("l_quantity").cast("long").alias("n"))
    asked = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("capture_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("win")).select(
        "capture_id", "win", (F.col("win") * 997).cast("long").alias("start"), F.lit(60).cast("long").alias("count"))
    return blocks.parts_of_windows(parts, asked, 64).select("capture_id", "win", "part_index", "read_lo", "read_hi")


@register("stacked_channels", """WITH t AS (SELECT vec_id // 2 AS cap, vec_id % 2 AS ch, embedding[1:60 + (vec_id % 2)::INT * 4] AS e FROM embeddings),
m AS (SELECT cap, min(len(e)) AS n, count(*) AS channels FROM t GROUP BY 1)
SELECT cap, n::INT AS n, channels::INT AS channels, round(sum(x), 4) AS total FROM (SELECT t.cap, m.n, m.channels, unnest(t.e[1:m.n])::DOUBLE AS x FROM t JOIN m USING (cap)) GROUP BY ALL""")
def stacked_channels(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    w = e.select(F.floor(F.col("vec_id") / 2).alias("capture_id"), (F.col("vec_id") % 2).alias("channel"), F.lit(0).alias("win"),
                 F.slice("embedding", 1, (60 + F.col("vec_id") % 2 * 4).cast("int")).alias("i"))
    out = blocks.stack_channels(w)
    return out.select(F.col("capture_id").alias("cap"), "n", F.size("channels").alias("channels"), F.round(C.array_sum(F.flatten("x")), 4).alias("total"))


@register("audio_windows", f"""WITH {_BLOCKS}, w AS (SELECT capture_id, pos // 160 AS win, count(*) AS n, sqrt(avg(i * i)) AS rms FROM s GROUP BY ALL)
SELECT capture_id, win, round(rms, 6) AS rms FROM (SELECT capture_id, win, rms, row_number() OVER (PARTITION BY capture_id ORDER BY win) AS rn FROM w WHERE n = 160 AND rms > 1e-6) WHERE rn <= 10""")
def audio_windows(spark, sf_dir):
    from ..operators.sampling import first_n
    w = windows_of(spark, sf_dir, 160).where(C.is_audible(F.col("i")))
    return first_n(w.select("capture_id", F.floor(F.col("start") / 160).alias("win"), r6(C.rms(F.col("i"))).alias("rms")), ["capture_id"], [F.col("win")], 10)


# ------------------------------------------------------------------ spectra
@register("dft_power", f"WITH {_DFT} SELECT vec_id, k::INT AS k, round(power, 6) AS power FROM p")
def dft_power(spark, sf_dir):
    x = vectors(spark, sf_dir)
    zero = F.transform("x", lambda v: F.lit(0.0))
    return x.select("vec_id", F.posexplode(features.spectrum_power("x", zero)).alias("k", "power")).withColumn("power", r6(F.col("power")))


_BH = "(0.35875 - 0.48829 * cos(2 * pi() * n / 15) + 0.14128 * cos(4 * pi() * n / 15) - 0.01168 * cos(6 * pi() * n / 15))"


@register("spectrogram", f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y, unnest(range(64)) AS t FROM embeddings),
w AS (SELECT vec_id, t // 16 AS frame, t % 16 AS n, x, y FROM v), tw AS (SELECT k, n, cos(2 * pi() * k * n / 16) * {_BH} AS c, sin(2 * pi() * k * n / 16) * {_BH} AS s FROM (SELECT unnest(range(16)) AS k), (SELECT unnest(range(16)) AS n))
SELECT vec_id, frame::INT AS frame, ((k + 8) % 16)::INT AS bin, round(pow(sum(x * c + y * s), 2) + pow(sum(y * c - x * s), 2), 6) AS power FROM w JOIN tw USING (n) GROUP BY vec_id, frame, k""")
def spectrogram(spark, sf_dir):
    w = vectors(spark, sf_dir).select("vec_id", F.col("x").alias("i"), F.reverse("x").alias("q"))
    return spectral.cells(spectral.spectrogram(w, 16, ["vec_id"]), ["vec_id"]).withColumn("power", r6(F.col("power")))


@register("welch_density", f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS t FROM embeddings),
g AS (SELECT vec_id, seg, t - seg * 8 AS n, x - avg(x) OVER (PARTITION BY vec_id, seg) AS x FROM v, (SELECT unnest(range(7)) AS seg) WHERE t >= seg * 8 AND t < seg * 8 + 16),
tw AS (SELECT k, n, (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * k * n / 16) AS c, (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * k * n / 16) AS s FROM (SELECT unnest(range(9)) AS k), (SELECT unnest(range(16)) AS n)),
p AS (SELECT vec_id, seg, k, pow(sum(x * c), 2) + pow(sum(x * s), 2) AS p FROM g JOIN tw USING (n) GROUP BY ALL)
SELECT vec_id, k::INT AS k, round(avg(p) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (8000 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * n / 16), 2)) FROM range(16) t(n))), 9) AS density FROM p GROUP BY vec_id, k""")
def welch_density(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return x.select("vec_id", F.posexplode(features.welch_density(16)("x", F.lit(8000.0))).alias("k", "density")).withColumn("density", F.round("density", 9))


@register("resampled_energy", """WITH h0 AS (SELECT j, CASE WHEN j = 0 THEN 1.0 ELSE sin(pi() * j / 2.0) / (pi() * j / 2.0) END AS sinc, sqrt(1 - (j / 20.0) * (j / 20.0)) AS a FROM (SELECT unnest(range(-20, 21)) AS j)),
i0 AS (SELECT j, sinc, (SELECT sum(pow(2.5 * a, 2 * m) / pow(gamma(m + 1.0), 2)) FROM (SELECT unnest(range(0, 40)) AS m)) AS w FROM h0),
h AS (SELECT j, sinc * w / (SELECT sum(sinc * w) FROM i0) AS t FROM i0), v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings)
SELECT vec_id, o.k::INT AS k, round(sum(x * t), 7) AS y FROM v, (SELECT unnest(range(32)) AS k) o JOIN h ON h.j = 2 * o.k - v.n GROUP BY vec_id, o.k""")
def resampled_energy(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return x.select("vec_id", F.posexplode(features.resampled(1, 2)("x")).alias("k", "y")).withColumn("y", F.round("y", 7))


@register("occupied_band", f"""WITH {_DFT}, u AS (SELECT vec_id, k, sum(power) OVER (PARTITION BY vec_id ORDER BY k) / sum(power) OVER (PARTITION BY vec_id) AS c FROM p)
SELECT vec_id, min(k) FILTER (c >= 0.005)::INT AS lo_bin, min(k) FILTER (c >= 0.995)::INT AS hi_bin FROM u GROUP BY 1""")
def occupied_band(spark, sf_dir):
    x = vectors(spark, sf_dir)
    p = x.select("vec_id", features.spectrum_power("x", F.transform("x", lambda v: F.lit(0.0))).alias("power"))
    return spectral.occupied_band(p, ["vec_id"])


@register("boxcar_peak", f"""WITH {_DFT}, u AS (SELECT vec_id, k, sum(power) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS e FROM p)
SELECT vec_id, centre::INT AS centre, round(e, 4) AS energy FROM (SELECT vec_id, k AS centre, e, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, k) AS rn FROM u WHERE k BETWEEN 4 AND 28) WHERE rn = 1""")
def boxcar_peak(spark, sf_dir):
    x = vectors(spark, sf_dir)
    p = x.select("vec_id", features.spectrum_power("x", F.transform("x", lambda v: F.lit(0.0))).alias("power"))
    return spectral.boxcar_peak(p, ["vec_id"], "power", 4, (4, 28)).withColumn("energy", F.round("energy", 4))


@register("band_energies", f"""WITH {_DFT}, b AS (SELECT vec_id, floor((k * 125.0) / 500.0)::BIGINT AS band, sum(power) AS e FROM p WHERE k * 125.0 >= 0 AND k * 125.0 < 4000 GROUP BY ALL)
SELECT vec_id, band, round(e, 5) AS energy, round(log10(e / sum(e) OVER (PARTITION BY vec_id) + 1e-12), 6) AS log_share FROM b""")
def band_energies(spark, sf_dir):
    x = vectors(spark, sf_dir)
    p = x.select("vec_id", features.spectrum_power("x", F.transform("x", lambda v: F.lit(0.0))).alias("power"))
    out = spectral.band_energies(p, ["vec_id"], "power", 125.0, (0.0, 4000.0), 8)
    return out.select("vec_id", "band", F.round("energy", 5).alias("energy"), r6(F.col("log_share")).alias("log_share"))


@register("band_over_median", f"""WITH {_DFT}, a AS (SELECT label, k, avg(power) AS m FROM p GROUP BY ALL), q AS (SELECT label, quantile_cont(m, 0.5) AS md FROM a GROUP BY 1)
SELECT label, min(k) FILTER (m > md * pow(10, 0.01))::INT AS lo_bin, max(k) FILTER (m > md * pow(10, 0.01))::INT AS hi_bin FROM a JOIN q USING (label) GROUP BY 1""")
def band_over_median(spark, sf_dir):
    x = vectors(spark, sf_dir)
    frames = x.select("label", F.col("vec_id").alias("frame"), features.spectrum_power("x", F.transform("x", lambda v: F.lit(0.0))).alias("power"))
    return spectral.band_over_median(spectral.mean_spectrum(frames, ["label"]), ["label"], "power", 0.1)


@register("level_dbfs", """SELECT vec_id, round(20 * log10(sqrt(avg(x * x)) + 1e-12), 6) AS level_dbfs, round(log10(sqrt(avg(2 * x * x)) + 1e-12), 6) AS log_rms, sqrt(avg(x * x)) > 1e-6 AS audible
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def level_dbfs(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    return e.select("vec_id", r6(C.level_dbfs(x)).alias("level_dbfs"), r6(C.log_rms_iq(x, F.reverse(x))).alias("log_rms"), C.is_audible(x).alias("audible"))


@register("quantisation", """SELECT l_orderkey, bool_and(abs(l_discount * 100 - round_even(l_discount * 100, 0)) <= 1e-6) AS hundredths, bool_and(abs(l_discount * 20 - round_even(l_discount * 20, 0)) <= 1e-6) AS twentieths FROM lineitem GROUP BY 1""")
def quantisation(spark, sf_dir):
    # the samples of one short part per row; an order has at most a few dozen lines
    l = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(C.is_quantised(F.array("l_discount"), 100)).alias("hundredths"), F.bool_and(C.is_quantised(F.array("l_discount"), 20)).alias("twentieths"))
    return l


@register("code_step", """WITH RECURSIVE d AS (SELECT l_suppkey, list(DISTINCT l_quantity::BIGINT * 6 ORDER BY l_quantity::BIGINT * 6) AS q FROM lineitem GROUP BY 1)
SELECT l_suppkey, list_reduce(q, lambda a, b: gcd(a, b)) AS step FROM d""")
def code_step(spark, sf_dir):
    codes = load(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity").cast("long") * 6).alias("q")).distinct()
    # distinct codes of a converter: at most 2^16 per capture
    return codes.groupBy("l_suppkey").agg(F.collect_list("q").alias("q")).select("l_suppkey", C.array_gcd(F.col("q")).alias("step"))


@register("level_profile", """WITH v AS (SELECT label, vec_id % 2 AS ch, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, ch, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, avg((abs(x) >= 0.3)::INT) AS clip, count(*) AS n, avg(x) AS dc FROM v GROUP BY ALL)
SELECT label, round(20 * log10(avg(rms) + 1e-12), 6) AS level_dbfs, round(max(peak), 6) AS peak, round(100 * sum(clip * n) / sum(n), 6) AS clipped_percent, round(max(abs(dc)), 6) AS dc_offset,
  round(max(20 * log10(rms + 1e-12)) - min(20 * log10(rms + 1e-12)), 6) AS channel_spread_db FROM c GROUP BY 1""")
def level_profile(spark, sf_dir):
    from ..operators.profiles import level_profile as profile
    e = load(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 2).alias("ch"), F.explode("embedding").alias("x"))
    out = profile(e, ["label"], "ch", "x", 0.3)
    return out.select("label", *[r6(F.col(c).cast("double")).alias(c) for c in out.columns[1:]])


# ------------------------------------------------------------------ activity
@register("noise_floor", f"WITH {_FRAMES} SELECT label, win, bin::INT AS bin, round(floor, 9) AS floor FROM fl")
def noise_floor(spark, sf_dir):
    return spectral.noise_floor(stored_frames(spark, sf_dir), ["label", "win"]).withColumn("floor", F.round("floor", 9))


_PFA = 0.03
_ON = f"""on0 AS (SELECT c.*, floor, power > {-math.log(_PFA) / math.log(2)!r} * floor AS up FROM c JOIN fl USING (label, win, bin)),
sides AS (SELECT label, win, frame, count(*) FILTER (up AND bin IN (30, 34)) = 2 AS both_up FROM on0 GROUP BY ALL),
oncell AS (SELECT label, win, frame, bin, power, floor FROM on0 JOIN sides USING (label, win, frame) WHERE CASE WHEN bin BETWEEN 31 AND 33 THEN both_up ELSE up END)"""


@register("cfar_cells", f"WITH {_FRAMES}, {_ON} SELECT label, win, frame::INT AS frame, bin::INT AS bin, round(power, 9) AS power FROM oncell")
def cfar_cells(spark, sf_dir):
    frames = stored_frames(spark, sf_dir)
    on = spectral.cfar_cells(frames, spectral.noise_floor(frames, ["label", "win"]), ["label", "win"], 32, _PFA)
    return on.select("label", "win", "frame", "bin", F.round("power", 9).alias("power"))


_BRIDGED = f"""ext AS (SELECT label, win, max(frame) AS last FROM c GROUP BY ALL),
near AS (SELECT DISTINCT o.label, o.win, o.frame + d AS frame, o.bin FROM oncell o JOIN ext USING (label, win), (SELECT unnest(range(-2, 3)) AS d) WHERE o.frame + d BETWEEN 0 AND last),
closed AS (SELECT n.label, n.win, n.frame + d AS frame, n.bin FROM near n, (SELECT unnest(range(-2, 3)) AS d) GROUP BY ALL HAVING count(*) = 5),
br AS (SELECT label, win, frame, bin FROM oncell UNION SELECT cl.label, cl.win, cl.frame, cl.bin FROM closed cl JOIN ext USING (label, win) WHERE cl.frame BETWEEN 2 AND last - 2),
cid AS (SELECT *, frame * 64 + bin AS id FROM br)"""
_BURSTS = f"""WITH RECURSIVE {_FRAMES}, {_ON}, {_BRIDGED},
r AS (SELECT label, win, id, id AS root FROM cid UNION SELECT b.label, b.win, b.id, r.root FROM r JOIN cid a ON a.label = r.label AND a.win = r.win AND a.id = r.id
  JOIN cid b ON b.label = a.label AND b.win = a.win AND abs(b.frame - a.frame) <= 1 AND abs(b.bin - a.bin) <= 1 WHERE r.root < b.id),
lab AS (SELECT label, win, id, min(root) AS root FROM r GROUP BY ALL),
cellx AS (SELECT lab.label, lab.win, root, c.frame, c.bin, c.power, fl.floor FROM lab JOIN c ON c.label = lab.label AND c.win = lab.win AND c.frame * 64 + c.bin = lab.id JOIN fl ON fl.label = c.label AND fl.win = c.win AND fl.bin = c.bin),
box AS (SELECT label, win, root, min(frame) AS f0, max(frame) AS f1, min(bin) AS b0, max(bin) AS b1, count(*) AS cells, max(power / floor) AS ratio FROM cellx GROUP BY ALL HAVING count(*) >= 3),
pb AS (SELECT label, win, root, bin, sum(greatest(power - floor, 0)) AS e FROM cellx GROUP BY ALL),
sh AS (SELECT label, win, root, bin, sum(e) OVER (PARTITION BY label, win, root ORDER BY bin) / sum(e) OVER (PARTITION BY label, win, root) AS s FROM pb),
occ AS (SELECT label, win, root, min(bin) FILTER (s >= 0.005) AS lo, min(bin) FILTER (s >= 0.995) AS hi FROM sh GROUP BY ALL)"""


def _found_bursts(spark, sf_dir) -> DataFrame:
    frames = stored_frames(spark, sf_dir)
    return activity.bursts_of_frames(frames, spectral.noise_floor(frames, ["label", "win"]), ["label", "win"], 1.0, 1.0, _PFA, 32)


@register("bursts", f"""{_BURSTS}
SELECT label, win, (row_number() OVER (PARTITION BY label, win ORDER BY root) - 1)::INT AS burst, f0::DOUBLE AS t0, (f1 + 1)::DOUBLE AS t1, (b0 - 32.5)::DOUBLE AS f_lo, (b1 - 31.5)::DOUBLE AS f_hi, cells,
  round(10 * log10(ratio), 6) AS snr_db, (lo - 32.5)::DOUBLE AS occ_lo, (hi - 31.5)::DOUBLE AS occ_hi FROM box JOIN occ USING (label, win, root)""")
def bursts(spark, sf_dir):
    return _found_bursts(spark, sf_dir).withColumn("snr_db", r6(F.col("snr_db")))


_EMITTERS = f"""{_BURSTS},
bu AS (SELECT label, win, root, cells, f0::DOUBLE AS t0, (f1 + 1 - f0)::DOUBLE AS len, (b0 - 32.5)::DOUBLE AS f_lo, (b1 - 31.5)::DOUBLE AS f_hi, 10 * log10(ratio) AS snr, (lo - 32.5)::DOUBLE AS olo, (hi - 31.5)::DOUBLE AS ohi FROM box JOIN occ USING (label, win, root)),
od AS (SELECT *, log2(greatest(ohi - olo, 1)) AS bw, log2(greatest(len, 1)) AS dur, row_number() OVER (PARTITION BY label, win ORDER BY cells DESC, root) AS rn FROM bu),
fold AS (SELECT label, win, 0::BIGINT AS rn, 0 AS root, 0::BIGINT AS emitter, []::DOUBLE[] AS bws, []::DOUBLE[] AS durs FROM (SELECT DISTINCT label, win FROM od)
  UNION ALL SELECT label, win, rn, root, CASE WHEN hit_pos IS NULL THEN len(bws) ELSE hit_pos - 1 END, CASE WHEN hit_pos IS NULL THEN list_append(bws, bw) ELSE bws END, CASE WHEN hit_pos IS NULL THEN list_append(durs, dur) ELSE durs END
  FROM (SELECT o.label, o.win, o.rn, o.root, o.bw, o.dur, f.bws, f.durs, nullif(list_position([abs(f.bws[i] - o.bw) <= 0.5 AND abs(f.durs[i] - o.dur) <= 0.5 for i in range(1, len(f.bws) + 1)], true), 0) AS hit_pos
        FROM fold f JOIN od o ON o.label = f.label AND o.win = f.win AND o.rn = f.rn + 1)),
g AS (SELECT bu.*, fold.emitter, (olo + ohi) / 2 AS c FROM bu JOIN fold ON fold.rn > 0 AND fold.label = bu.label AND fold.win = bu.win AND fold.root = bu.root),
mb AS (SELECT label, win, emitter, quantile_cont(ohi - olo, 0.5) AS bandwidth_hz FROM g GROUP BY ALL),
l AS (SELECT g.*, bandwidth_hz, t0 - lag(t0) OVER (PARTITION BY label, win, emitter ORDER BY t0, root) AS gap, c - lag(c) OVER (PARTITION BY label, win, emitter ORDER BY c, root) AS apart FROM g JOIN mb USING (label, win, emitter)),
em AS (SELECT label, win, emitter, bandwidth_hz, count(*) AS blobs, quantile_cont(len, 0.5) AS burst_s, 1 + count(*) FILTER (apart > 0.5 * bandwidth_hz) AS hop_set, max(f_hi) - min(f_lo) AS span_hz,
  quantile_cont(gap, 0.5) AS interval_s, CASE WHEN count(gap) > 1 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END AS interval_cv, least(1.0, sum(len) / {float(WINDOW_FRAMES)}) AS duty,
  quantile_cont(snr, 0.5) AS snr_db, max(len) > {WINDOW_FRAMES / 2} AS continuous FROM l GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, win ORDER BY blobs * burst_s DESC, emitter) - 1 AS rank FROM em)"""


@register("emitters", f"""{_EMITTERS} SELECT label, win, emitter::INT AS emitter, bandwidth_hz, blobs, burst_s, hop_set, span_hz, round(interval_s, 6) AS interval_s, round(interval_cv, 6) AS interval_cv,
  round(duty, 6) AS duty, round(snr_db, 6) AS snr_db, continuous, rank::INT AS rank FROM ranked""")
def emitters(spark, sf_dir):
    b = _found_bursts(spark, sf_dir).withColumn("duration_s", F.lit(float(WINDOW_FRAMES)))
    out = activity.emitters(activity.group_bursts(b, ["label", "win"], 1.0, 1.0), ["label", "win"])
    return out.withColumns({c: r6(F.col(c)) for c in ("interval_s", "interval_cv", "duty", "snr_db")})


def _vector_sql() -> str:
    values = {"log_bw": "log10(bandwidth_hz)", "log_burst": "log10(burst_s)", "hop_set": "hop_set::DOUBLE", "span_mhz": "span_hz / 1e6",
              "log_interval": "CASE WHEN interval_s > 0 THEN log10(interval_s) END", "interval_cv": "interval_cv", "duty": "duty", "continuous": "continuous::INT::DOUBLE"}
    return ", ".join(f"round(max({v}) FILTER (rank = {r}), 6) AS e{r}_{n}" for r in range(3) for n, v in values.items())


@register("emitter_vectors", f"""{_EMITTERS} SELECT w.label, w.win, coalesce(count(*) FILTER (blobs >= 5), 0)::DOUBLE AS n_emitters_5, {_vector_sql()}
  FROM (SELECT DISTINCT label, win FROM c) w LEFT JOIN ranked r ON r.label = w.label AND r.win = w.win GROUP BY w.label, w.win""")
def emitter_vectors(spark, sf_dir):
    frames = stored_frames(spark, sf_dir)
    b = _found_bursts(spark, sf_dir).withColumn("duration_s", F.lit(float(WINDOW_FRAMES)))
    found = activity.emitters(activity.group_bursts(b, ["label", "win"], 1.0, 1.0), ["label", "win"])
    out = activity.emitter_vectors(found, frames, ["label", "win"])
    return out.withColumns({c: r6(F.col(c)) for c in out.columns if c.startswith("e")})


@register("analyse_windows")
def analyse_windows(spark, sf_dir):
    """Samples to emitters in one go: frames of 16 samples at 3.2 MS/s."""
    w = windows_of(spark, sf_dir, 1600).withColumn("sample_rate_hz", F.lit(3.2e6))
    return activity.analyse(w, ["capture_id", "start"], pfa=0.03)


@register("wifi_bursts")
def wifi_bursts(spark, sf_dir):
    w = windows_of(spark, sf_dir, 3200).withColumn("sample_rate_hz", F.lit(40e6))
    b = activity.window_bursts(w, ["capture_id", "start"], pfa=0.2, nfft=16)
    return activity.with_wifi_flag(b).drop("head_i", "head_q")


# ------------------------------------------------------------------ features
@register("tile_snr", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y, unnest(range(64)) AS t FROM embeddings),
w AS (SELECT vec_id, t // 8 AS frame, t % 8 AS n, x, y FROM v), hw AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 7) AS w FROM range(8) r(n)),
tw AS (SELECT k, n, cos(2 * pi() * k * n / 8) * w AS c, sin(2 * pi() * k * n / 8) * w AS s FROM hw, (SELECT unnest(range(8)) AS k)),
p AS (SELECT vec_id, frame, k, pow(sum(x * c + y * s), 2) + pow(sum(y * c - x * s), 2) AS p FROM w JOIN tw USING (n) GROUP BY ALL),
m AS (SELECT vec_id, k, quantile_cont(p, 0.5) AS m FROM p GROUP BY ALL), z AS (SELECT vec_id, quantile_cont(m, 0.25) / ln(2) / (SELECT sum(w * w) FROM hw) AS noise FROM m GROUP BY 1),
t AS (SELECT vec_id, avg(x * x + y * y) AS total FROM v GROUP BY 1)
SELECT vec_id, round(noise, 9) AS noise, round(total, 9) AS total, round(greatest(total - noise, 1e-12 * total) / noise, 5) AS snr FROM z JOIN t USING (vec_id)""")
def tile_snr(spark, sf_dir):
    t = vectors(spark, sf_dir).select("vec_id", F.col("x").alias("i"), F.reverse("x").alias("q"), F.lit(1.0).alias("sample_rate_hz"))
    out = features.tile_snr(t, 8, ["vec_id"])
    return out.select("vec_id", F.round("noise", 9).alias("noise"), F.round("total", 9).alias("total"), F.round("snr", 5).alias("snr"))


def _tiles(spark, sf_dir, length: int, fs: float) -> DataFrame:
    return windows_of(spark, sf_dir, length).select("capture_id", "start", "i", "q", F.lit(fs).alias("sample_rate_hz"), F.lit(2.44e9).alias("center_frequency_hz"))


@register("rf_tile_features")
def rf_tile_features(spark, sf_dir):
    return features.tile_features(_tiles(spark, sf_dir, 1024, 25e6), keep=["capture_id", "start"])


@register("background_features")
def background_features(spark, sf_dir):
    return features.quiet_half_features(_tiles(spark, sf_dir, 1024, 14e6), keep=["capture_id", "start"])


@register("equalised_snr")
def equalised_snr(spark, sf_dir):
    t = _tiles(spark, sf_dir, 1024, 25e6)
    return features.tile_snr(features.equalised_tiles(t, 0.5, ["capture_id", "start"]), keep=["capture_id", "start", "changed"])


@register("band_tiles")
def band_tiles(spark, sf_dir):
    t = features.recentred_tiles(_tiles(spark, sf_dir, 1000, 4e6), 2.4405e9, 2e6)
    return t.select("capture_id", "start", "coverage", r6(C.log_rms_iq(F.col("i"), F.col("q"))).alias("log_rms"))


@register("steered_tiles")
def steered_tiles(spark, sf_dir):
    t = features.steered_tiles(_tiles(spark, sf_dir, 1000, 4e6), 1e6)
    return t.select("capture_id", "start", "centre_hz", r6(C.log_rms_iq(F.col("i"), F.col("q"))).alias("log_rms"))


@register("notched_tiles")
def notched_tiles(spark, sf_dir):
    t = features.notched_tiles(_tiles(spark, sf_dir, 1000, 4e6))
    return t.select("capture_id", "start", r6(C.log_rms_iq(F.col("i"), F.col("q"))).alias("log_rms"))


@register("tile_images")
def tile_images(spark, sf_dir):
    t = _tiles(spark, sf_dir, 640, 14e6)
    return t.select("capture_id", "start", features.tile_image("i", "q").alias("image")).select(
        "capture_id", "start", F.size("image").alias("bins"), F.size(F.col("image")[0]).alias("frames"), r6(F.array_max(F.flatten("image")).cast("double")).alias("peak"))


def _audio(spark, sf_dir, length: int = 3200, fs: float = 16000.0) -> DataFrame:
    return windows_of(spark, sf_dir, length).select("capture_id", "start", F.col("i").alias("x"), F.lit(fs).alias("sample_rate_hz"))


@register("audio_features")
def audio_features(spark, sf_dir):
    return features.audio_features(_audio(spark, sf_dir), ["capture_id", "start"]).withColumn("hf_share_db", features.high_frequency_share_db())


@register("mfcc_features")
def mfcc_features(spark, sf_dir):
    return features.mfcc_features(_audio(spark, sf_dir), ["capture_id", "start"])


@register("band_signature")
def band_signature(spark, sf_dir):
    return features.band_signature(_audio(spark, sf_dir), keep=["capture_id", "start"])


@register("harmonic_prominence")
def harmonic_prominence(spark, sf_dir):
    return features.harmonic_prominence(_audio(spark, sf_dir), ["capture_id", "start"])


@register("wide_band_features")
def wide_band_features(spark, sf_dir):
    x = _audio(spark, sf_dir, 1600, 20e9)
    return features.wide_band_features(x, ["capture_id", "start"], segment=1024, frame=100)


# ------------------------------------------------------------------ neighbours
@register("knn_one_class", """WITH pool AS (SELECT vec_id AS pid, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings WHERE label = 0),
st AS (SELECT n, avg(x) AS mu, stddev_pop(x) AS sd FROM pool GROUP BY 1), zp AS (SELECT pid, n, (x - mu) / sd AS z FROM pool JOIN st USING (n)),
zq AS (SELECT vec_id, n, (x - mu) / sd AS z FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings WHERE label <> 0) JOIN st USING (n)),
d AS (SELECT vec_id, pid, sqrt(sum(pow(zq.z - zp.z, 2))) AS d FROM zq JOIN zp USING (n) GROUP BY ALL), r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rn FROM d)
SELECT vec_id, round(-avg(d), 6) AS score FROM r WHERE rn <= 10 GROUP BY 1""")
def knn_one_class(spark, sf_dir):
    x = vectors(spark, sf_dir)
    out = neighbours.one_class_scores(x.where("label <> 0"), x.where("label = 0"), "vec_id", "vec_id", "x", 10)
    return out.withColumn("score", r6(F.col("score")))


@register("mixture_one_class")
def mixture_one_class(spark, sf_dir):
    x = vectors(spark, sf_dir)
    model = neighbours.DiagonalMixture(components=4, rounds=10).fit(x.where("label = 0"), "x", "vec_id")
    return model.score(x.where("label <> 0"), "x").select("vec_id", r6(F.col("score")).alias("score"))


# ------------------------------------------------------------------ the tile kernels on one vector per tile, with SQL
VECTOR_FS = 256_000.0        # 64 samples last 250 us
_TILE = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y, unnest(range(64)) AS t FROM embeddings)"
_HANN8 = "(0.5 - 0.5 * cos(2 * pi() * n / 7))"
# shifted 8-bin power cells of 8 frames
_CELLS8 = f"""w8 AS (SELECT k, n, cos(2 * pi() * k * n / 8) * {_HANN8} AS c, sin(2 * pi() * k * n / 8) * {_HANN8} AS s FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(8)) AS n)),
cell AS (SELECT vec_id, t // 8 AS frame, (k + 4) % 8 AS bin, pow(sum(x * c + y * s), 2) + pow(sum(y * c - x * s), 2) AS p FROM z JOIN w8 ON n = t % 8 GROUP BY ALL)"""
_DFT64 = f"""{_TILE}, tw AS (SELECT k, n, cos(2 * pi() * k * n / 64) AS c, sin(2 * pi() * k * n / 64) AS s FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(64)) AS n)),
p64 AS (SELECT vec_id, (k + 32) % 64 AS bin, ((k + 32) % 64 - 32) * 4000.0 AS f, pow(sum(x * c + y * s), 2) + pow(sum(y * c - x * s), 2) AS p FROM v JOIN tw ON n = t GROUP BY vec_id, k)"""


def vector_tiles(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.col("x").alias("i"), F.reverse("x").alias("q"), F.lit(VECTOR_FS).alias("sample_rate_hz"), F.lit(2.44e9).alias("center_frequency_hz"))


_SHAPE_PICKS = [k * 7 // 11 for k in range(12)]


@register("vector_tile_features", f"""WITH {_TILE}, mu AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my FROM v GROUP BY 1), r AS (SELECT vec_id, sqrt(avg(pow(x - mx, 2) + pow(y - my, 2))) + 1e-12 AS rms FROM v JOIN mu USING (vec_id) GROUP BY 1),
z AS (SELECT vec_id, t, (x - mx) / rms AS x, (y - my) / rms AS y FROM v JOIN mu USING (vec_id) JOIN r USING (vec_id)), {_CELLS8},
md AS (SELECT vec_id, quantile_cont(p, 0.5) AS m FROM cell GROUP BY 1), busy AS (SELECT cell.*, p > m * pow(10, 0.6) AS b FROM cell JOIN md USING (vec_id)),
sp AS (SELECT vec_id, bin, avg(p) AS m, max(b::INT) AS b FROM busy GROUP BY ALL),
sh AS (SELECT vec_id, bin, m, b, m / sum(m) OVER (PARTITION BY vec_id) AS s, sum(m) OVER (PARTITION BY vec_id ORDER BY bin) / sum(m) OVER (PARTITION BY vec_id) AS u, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC) - 1 AS rk FROM sp),
fa AS (SELECT vec_id, frame, sum(p) AS fp, sum(p * bin) / (sum(p) + 1e-30) AS cen, sum(b::INT) AS wid FROM busy GROUP BY ALL), fm AS (SELECT vec_id, quantile_cont(fp, 0.5) AS m FROM fa GROUP BY 1),
fl AS (SELECT fa.*, fp > 2 * m AS up, lag(fp > 2 * m) OVER w AS pup, lag(cen) OVER w AS pc FROM fa JOIN fm USING (vec_id) WINDOW w AS (PARTITION BY fa.vec_id ORDER BY frame)),
a1 AS (SELECT vec_id, {', '.join(f"round(log10(max(s) FILTER (rk = {p}) + 1e-12), 6) AS shape_q{k:02d}" for k, p in enumerate(_SHAPE_PICKS))},
  round((min(bin) FILTER (u >= 0.995) - min(bin) FILTER (u >= 0.005)) * {VECTOR_FS} / 8 / 1e6, 6) AS occupied_bw_mhz, round(avg(b), 6) AS active_bins_fraction, round(exp(avg(ln(m + 1e-30))) / (avg(m) + 1e-30), 6) AS spectral_flatness FROM sh GROUP BY 1),
a2 AS (SELECT vec_id, round(avg(up::INT), 6) AS duty_cycle, count(*) FILTER (up <> pup)::DOUBLE AS transitions, round(stddev_pop(fp) / (avg(fp) + 1e-30), 6) AS frame_power_cv, round(avg(abs(cen - pc)) / 8, 6) AS centroid_jump_mean,
  round(stddev_pop(cen) / 8, 6) AS centroid_spread, round(avg(wid) / 8, 6) AS frame_bw_mean, round(stddev_pop(wid) / 8, 6) AS frame_bw_std FROM fl GROUP BY 1),
a3 AS (SELECT vec_id, round(avg(pow(x * x + y * y, 2)) / (pow(avg(x * x + y * y), 2) + 1e-30), 6) AS amplitude_kurtosis, round(10 * log10(max(x * x + y * y) / (avg(x * x + y * y) + 1e-30)), 6) AS papr_db FROM z GROUP BY 1)
SELECT * FROM a1 JOIN a2 USING (vec_id) JOIN a3 USING (vec_id)""")
def vector_tile_features(spark, sf_dir):
    out = features.tile_features(vector_tiles(spark, sf_dir), 8, ["vec_id"])
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in features.TILE])


@register("vector_quiet_half", f"""WITH {_TILE}, z AS (SELECT * FROM v), {_CELLS8}, kept AS (SELECT * FROM cell WHERE bin NOT BETWEEN 3 AND 5), md AS (SELECT vec_id, quantile_cont(p, 0.5) AS m FROM kept GROUP BY 1),
q AS (SELECT kept.*, p <= m AS q FROM kept JOIN md USING (vec_id)), b AS (SELECT vec_id, bin, avg(p) FILTER (q) AS m, avg(q::INT) AS s FROM q GROUP BY ALL), f AS (SELECT vec_id, frame, avg(p) FILTER (q) AS m FROM q GROUP BY ALL),
c AS (SELECT vec_id, stddev_pop(p) FILTER (q) / avg(p) FILTER (q) AS v FROM q GROUP BY 1), bb AS (SELECT vec_id, stddev_pop(m) / avg(m) AS v, stddev_pop(s) AS s FROM b GROUP BY 1), ff AS (SELECT vec_id, stddev_pop(m) / avg(m) AS v FROM f GROUP BY 1)
SELECT vec_id, round(c.v, 6) AS bg_cell_cv, round(bb.v, 6) AS bg_freq_cv, round(ff.v, 6) AS bg_time_cv, round(bb.s, 6) AS bg_quiet_bin_spread FROM c JOIN bb USING (vec_id) JOIN ff USING (vec_id)""")
def vector_quiet_half(spark, sf_dir):
    out = features.quiet_half_features(vector_tiles(spark, sf_dir), 8, ["vec_id"])
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in features.QUIET])


@register("vector_notched", f"""WITH {_DFT64} SELECT vec_id, round(log10(sqrt(sum(p) FILTER (abs(f) >= 100000) / 4096) + 1e-12), 5) AS log_rms FROM p64 GROUP BY 1""")
def vector_notched(spark, sf_dir):
    t = features.notched_tiles(vector_tiles(spark, sf_dir))
    return t.select("vec_id", F.round(C.log_rms_iq(F.col("i"), F.col("q")), 5).alias("log_rms"))


@register("vector_recentred", f"""WITH {_DFT64} SELECT vec_id, 1.0::DOUBLE AS coverage, round(log10(sqrt(sum(p) FILTER (f >= 16000 - 64000 AND f < 16000 + 64000) / 4096) + 1e-12), 5) AS log_rms FROM p64 GROUP BY 1""")
def vector_recentred(spark, sf_dir):
    t = features.recentred_tiles(vector_tiles(spark, sf_dir), 2.44e9 + 16_000, 128_000.0)
    return t.select("vec_id", "coverage", F.round(C.log_rms_iq(F.col("i"), F.col("q")), 5).alias("log_rms"))


@register("vector_steered", f"""WITH {_DFT64}, nz AS (SELECT vec_id, bin, f, CASE WHEN abs(f) < 100000 THEN 0 ELSE p END AS p FROM p64), md AS (SELECT vec_id, quantile_cont(p, 0.5) AS m FROM nz GROUP BY 1),
e AS (SELECT nz.vec_id, bin, f, p, greatest(p - m, 0) AS e FROM nz JOIN md USING (vec_id)), b AS (SELECT *, sum(e) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS s FROM e),
best AS (SELECT vec_id, f AS cf, bin AS cb, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, bin) AS rn FROM b WHERE f >= -128000 + 16000 AND f <= 124000 - 16000)
SELECT vec_id, cf + 2.44e9 AS centre_hz, round(log10(sqrt(sum(p) FILTER (bin >= cb - 4 AND bin < cb + 4) / 4096) + 1e-12), 5) AS log_rms FROM e JOIN best USING (vec_id) WHERE rn = 1 GROUP BY vec_id, cf""")
def vector_steered(spark, sf_dir):
    t = features.steered_tiles(vector_tiles(spark, sf_dir), 32_000.0)
    return t.select("vec_id", "centre_hz", F.round(C.log_rms_iq(F.col("i"), F.col("q")), 5).alias("log_rms"))


@register("vector_images", f"""WITH {_TILE}, pos AS (SELECT frame, n, frame * 32 + n - 32 AS at_pos FROM (SELECT unnest(range(3)) AS frame), (SELECT unnest(range(64)) AS n)),
rf AS (SELECT frame, n, CASE WHEN at_pos < 0 THEN -at_pos WHEN at_pos > 63 THEN 126 - at_pos ELSE at_pos END AS t FROM pos),
tw AS (SELECT k, n, cos(2 * pi() * k * n / 64) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS c, sin(2 * pi() * k * n / 64) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS s FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(64)) AS n)),
lv AS (SELECT vec_id, frame, (k + 32) % 64 AS bin, log10(pow(sum(x * c + y * s), 2) + pow(sum(y * c - x * s), 2) + 1e-12) AS l FROM v JOIN rf USING (t) JOIN tw ON tw.n = rf.n GROUP BY vec_id, frame, k),
st AS (SELECT vec_id, avg(l) AS m, stddev_samp(l) AS sd FROM lv GROUP BY 1)
SELECT vec_id, frame::INT AS frame, count(*)::INT AS bins, round(sum((l - m) / (sd + 1e-6)), 2) AS total FROM lv JOIN st USING (vec_id) GROUP BY 1, 2""")
def vector_images(spark, sf_dir):
    image = vector_tiles(spark, sf_dir).select("vec_id", features.tile_image("i", "q").alias("m"))
    long = image.select("vec_id", F.posexplode("m").alias("bin", "row")).select("vec_id", "bin", F.posexplode("row").alias("frame", "l"))
    return long.groupBy("vec_id", "frame").agg(F.count("*").cast("int").alias("bins"), F.round(F.sum(F.col("l").cast("double")), 2).alias("total"))
