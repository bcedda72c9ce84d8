"""Quality classifier: a factorisation machine (operator 3).

A text becomes a sparse vector: its distinct words, hashed, and one-hot buckets of structure statistics and of the declared
length. The score is bias + linear part + half of sum over factors of (sum v x)^2 - sum (v x)^2, which gives all pairwise
interactions in time linear in the number of entries.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, load

SAMPLE_ROWS = 8_000                                 # labelled documents that are fitted on, at most
FOLDS = 5                                           # fold 0 of crc32(doc_id) is held out
WORDS = 1 << 14                                     # hash places of words
BUCKETS = 24                                        # places of one statistic
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 12, 128, 0.02, 1e-4, 7

_CLASS = np.zeros(256, np.int64)                    # 0 lower case or beyond ASCII, then as named
for _name, _k in (("0123456789", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (" \t\r\x0b\x0c", 3), ("\n", 4), (".,;:?'\"()-", 5), ("#$%&*+/<=>@[\\]^_`{|}~!", 6)):
    _CLASS[[ord(c) for c in _name]] = _k


def _bucket(share: float) -> int:
    return min(int(share * (BUCKETS - 1)), BUCKETS - 1)


def structure(data: bytes, words: list[bytes], distinct: int, declared: float | None) -> list[int]:
    """Bucket of every statistic; each depends on the whole text."""
    n, counts = max(len(data), 1), np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    lines = data.split(b"\n")
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    size = min(int(2 * np.log2(len(data) + 1)), BUCKETS - 1)
    meta = BUCKETS - 1 if declared is None or not declared >= 0 else min(int(2 * np.log2(declared + 1)), BUCKETS - 2)
    return [size, meta, *(_bucket(c / n) for c in counts[1:]), _bucket(min(8 * counts[6] / n, 1)), _bucket(distinct / max(len(words), 1)), _bucket(len(set(lines)) / len(lines)),
            _bucket(marked / max(len(words), 1)), _bucket(min(sum(map(len, words)) / max(len(words), 1) / 16, 1)), _bucket(sum(len(w) < 4 for w in words) / max(len(words), 1))]


STATISTICS = len(structure(b"", [], 0, None))
SIZE = WORDS + STATISTICS * BUCKETS


def vectorise(texts: pd.Series, declared: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, places and values of the sparse matrix; a null text counts as empty, a null length has its own bucket."""
    starts, places, values = [0], [], []
    for t, d in zip(texts, declared):
        data = (t or "").encode("utf-8", "surrogatepass")
        words = data.lower().split()
        hashed = np.unique(np.fromiter((zlib.crc32(w) for w in set(words)), np.int64) % WORDS)
        stats = WORDS + np.arange(STATISTICS) * BUCKETS + structure(data, words, len(set(words)), None if pd.isna(d) else float(d))
        places += [hashed, stats]
        values += [np.full(len(hashed), 1 / np.sqrt(len(hashed) or 1)), np.full(STATISTICS, 1 / np.sqrt(STATISTICS))]
        starts.append(starts[-1] + len(hashed) + STATISTICS)
    return np.array(starts), np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(values) if values else np.zeros(0)


class Machine:
    """Weights of the factorisation machine; its size depends on nothing but the constants above."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def _sums(self, starts: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = starts[:-1]                                               # every row has entries: the statistics
        vx = self.factors[places] * values[:, None]
        total = np.add.reduceat(vx, at) if len(at) else np.zeros((0, self.factors.shape[1]))
        squares = np.add.reduceat((vx * vx).sum(1), at) if len(at) else np.zeros(0)
        linear = np.add.reduceat(self.linear[places] * values, at) if len(at) else np.zeros(0)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares), total, vx

    def probabilities(self, starts: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._sums(starts, places, values)[0], -30, 30)))

    @staticmethod
    def fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        """AdaGrad over mini-batches in a fixed random order, on the logistic loss."""
        draw = np.random.default_rng(SEED)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), draw.normal(0, 0.05, (SIZE, FACTORS)))
        seen_linear, seen_factors, seen_bias = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = draw.permutation(len(y))
            for k in range(0, len(order), BATCH):
                batch = order[k:k + BATCH]
                lengths = np.array([len(rows[i][0]) for i in batch])
                starts = np.concatenate(([0], np.cumsum(lengths)))
                places, values = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
                z, total, vx = m._sums(starts, places, values)
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
                per = np.repeat(slope, lengths) * values
                used, back = np.unique(places, return_inverse=True)
                g = np.bincount(back, per, len(used)) + DECAY * m.linear[used]
                inner = per[:, None] * (np.repeat(total, lengths, axis=0) - vx)
                h = np.stack([np.bincount(back, inner[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * m.factors[used]
                b = slope.sum()
                seen_linear[used] += g * g
                seen_factors[used] += h * h
                seen_bias += b * b
                m.linear[used] -= 10 * RATE * g / np.sqrt(seen_linear[used])
                m.factors[used] -= RATE * h / np.sqrt(seen_factors[used])
                m.bias -= RATE * b / np.sqrt(seen_bias)
        return Machine(m.bias, m.linear.astype(np.float32), m.factors.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from at most ``rows`` labelled documents outside the held-out fold; without any, every score is 0.5."""
    def entries(text: pd.Series, declared: pd.Series) -> pd.DataFrame:
        starts, places, values = vectorise(text, declared)
        return pd.DataFrame({"places": np.split(places, starts[1:-1]) if len(text) else [], "values": np.split(values, starts[1:-1]) if len(text) else []})
    entries.__annotations__ = {"text": pd.Series, "declared": pd.Series, "return": pd.DataFrame}
    sample = labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), FOLDS) != 0, rows)
    found = sample.select("doc_id", "y", F.pandas_udf(entries, "places array<int>, values array<float>")("text", "n_chars").alias("x")).collect()     # at most `rows` sparse rows of at most SIZE entries
    found.sort(key=lambda r: r.doc_id)
    if not found:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    return Machine.fitted([(np.array(r.x.places, np.int64), np.array(r.x["values"], float)) for r in found], np.array([r.y for r in found], float))


def scored(docs: DataFrame, machine: Machine, name: str) -> DataFrame:
    """``docs`` with a double column ``name`` from 0 to 1; null and empty texts are scored as empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)         # SIZE x (FACTORS + 1) floats

    def score(text: pd.Series, declared: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probabilities(*vectorise(text, declared)).astype(float))
    score.__annotations__ = {"text": pd.Series, "declared": pd.Series, "return": pd.Series}
    declared = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.withColumn(name, F.pandas_udf(score, "double")("text", declared))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    found = scored(docs.select("doc_id", "text", "n_chars"), fit(docs, labels), "score")
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
