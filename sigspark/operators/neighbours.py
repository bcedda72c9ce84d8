"""Exact k-nearest-neighbour distances and one-class scores without comparing every query with every pool row.

The pool is cut into cells around pivots. For a query, the distances to the pivots and the k closest members of every
cell give an upper bound on its k-th distance; a cell whose nearest possible member lies beyond that bound cannot
matter. Remaining (query, cell) pairs meet in blocks of bounded size on both sides, so neither a crowded cell nor a
crowded query region fills one task. The result is exact.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage

POOL_BLOCK = 8192
QUERY_BLOCK = 4096


def moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population std, n) of an array column; one row reaches the driver."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    r = df.select(v.alias("v")).select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    n = int(r["count"])
    return r["mean"].toArray(), np.sqrt(r["variance"].toArray() * (n - 1) / max(n, 1)), n


def standardise(df: DataFrame, vector: str, mean: np.ndarray, std: np.ndarray) -> DataFrame:
    scale = np.where(std > 0, std, 1.0)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack([np.asarray(v, float) for v in x]) - mean) / scale))

    return df.withColumn(vector, run(vector))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(sq, 0))


def nearest(queries: DataFrame, pool: DataFrame, query_id: str, pool_id: str, vector: str, k: int, n_pivots: int | None = None,
            pool_block: int = POOL_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, distances): the k smallest Euclidean distances to pool rows, ascending."""
    n_pool = pool.count()
    if n_pool == 0:
        raise ValueError("empty pool")
    m = n_pivots or int(min(1024, max(1, math.isqrt(n_pool) // 2)))
    pivots = np.stack([np.asarray(r[0], float) for r in
                       pool.orderBy(F.xxhash64(pool_id), pool_id).limit(m).select(vector).collect()])        # m vectors

    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    def place(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "d": pd.Series([], dtype=float)})
        d = _distances(np.stack([np.asarray(v, float) for v in x]), pivots)
        c = d.argmin(axis=1)
        return pd.DataFrame({"cell": c.astype(np.int32), "d": d[np.arange(len(c)), c]})

    placed = pool.select(F.col(pool_id).alias("_pid"), F.col(vector).alias("_p"), place(vector).alias("_c")).select("_pid", "_p", "_c.cell", "_c.d")
    first_k = placed.select("cell", "d").withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("_r") <= k)
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("hi"), F.min("d").alias("lo")).collect()}   # m rows
    close = {r["cell"]: sorted(r["ds"]) for r in first_k.groupBy("cell").agg(F.collect_list("d").alias("ds")).collect()}                    # m * k numbers
    cells = sorted(stats)
    lo, hi = np.array([stats[c]["lo"] for c in cells]), np.array([stats[c]["hi"] for c in cells])
    near = np.full((len(cells), k), np.inf)
    for i, c in enumerate(cells):
        near[i, : len(close[c])] = close[c]
    centres, cell_ids = pivots[cells], np.array(cells, np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def candidates(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        d = _distances(np.stack([np.asarray(v, float) for v in x]), centres)
        bounds = (d[:, :, None] + near[None, :, :]).reshape(len(d), -1)
        kth = min(k, bounds.shape[1]) - 1
        bound = np.partition(bounds, kth, axis=1)[:, kth]
        least = np.maximum(np.maximum(d - hi, lo - d), 0)
        keep = least <= bound[:, None] * (1 + 1e-9) + 1e-9
        return pd.Series([cell_ids[row] for row in keep])

    asked = queries.select(F.col(query_id).alias("_qid"), F.col(vector).alias("_q"), F.explode(candidates(vector)).alias("cell"))
    asked_n = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}            # m rows
    p_parts = F.create_map(*[F.lit(v) for c in cells for v in (c, max(1, math.ceil(stats[c]["n"] / pool_block)))])
    q_parts = F.create_map(*[F.lit(v) for c in cells for v in (c, max(1, math.ceil(asked_n.get(c, 0) / query_block)))])

    def upto(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    blocks = ["cell", "pb", "qb"]
    left = (asked.withColumn("qb", F.pmod(F.xxhash64("_qid"), q_parts[F.col("cell")]).cast("int")).withColumn("pb", upto(p_parts[F.col("cell")])))
    right = (placed.withColumn("pb", F.pmod(F.xxhash64("_pid"), p_parts[F.col("cell")]).cast("int")).withColumn("qb", upto(q_parts[F.col("cell")])))
    id_type = queries.schema[query_id].dataType.simpleString()

    def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"_qid": pd.Series([], dtype=q["_qid"].dtype if len(q) else object), "d": pd.Series([], dtype=float)})
        a, b = np.stack([np.asarray(v, float) for v in q["_q"]]), np.stack([np.asarray(v, float) for v in p["_p"]])
        take = min(k, len(b))
        ids, out = [], []
        for at in range(0, len(a), 256):
            part = a[at:at + 256]
            best = np.argpartition(_distances(part, b), take - 1, axis=1)[:, :take]
            # the chosen few again without cancellation
            out.append(np.sqrt(((part[:, None, :] - b[best]) ** 2).sum(axis=2)).ravel())
            ids.append(np.repeat(q["_qid"].to_numpy()[at:at + 256], take))
        return pd.DataFrame({"_qid": np.concatenate(ids), "d": np.concatenate(out)})

    met = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(meet, f"_qid {id_type}, d double")
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("_qid").orderBy("d"))).where(F.col("_r") <= k)
    return best.groupBy(F.col("_qid").alias(query_id)).agg(F.array_sort(F.collect_list("d")).alias("distances"))


def one_class_scores(queries: DataFrame, pool: DataFrame, query_id: str, pool_id: str, vector: str, k: int = 10, **options) -> DataFrame:
    """(query_id, score): minus the mean distance to the k nearest pool rows after standardising with the pool."""
    mean, std, _ = moments(pool, vector)
    found = nearest(standardise(queries, vector, mean, std), standardise(pool, vector, mean, std), query_id, pool_id, vector, k, **options)
    return found.select(query_id, (-F.aggregate("distances", F.lit(0.0), lambda a, d: a + d) / F.size("distances")).alias("score"))


# ------------------------------------------------------------------ diagonal Gaussian mixture
class DiagonalMixture:
    """Mixture of axis-aligned Gaussians fitted by EM; one aggregation per round. Parameters are components x features."""

    def __init__(self, components: int = 8, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6, seed: int = 0):
        self.components, self.rounds, self.tolerance, self.floor, self.seed = components, rounds, tolerance, floor, seed

    def fit(self, df: DataFrame, vector: str, row_id: str) -> "DiagonalMixture":
        df = cut_lineage(df.select(row_id, vector))              # every round reads it again
        _, std, n = moments(df, vector)
        starts = df.orderBy(F.xxhash64(F.lit(self.seed), row_id), row_id).limit(self.components).select(vector).collect()
        self.means = np.stack([np.asarray(r[0], float) for r in starts])
        self.variances = np.tile(np.maximum(std ** 2, self.floor), (len(self.means), 1))
        self.weights = np.full(len(self.means), 1 / len(self.means))
        last = -np.inf
        for _ in range(self.rounds):
            sums, loglik = self._sums(df, vector)
            r = np.maximum(sums[:, 0], 1e-12)
            d = self.means.shape[1]
            self.means = sums[:, 1:1 + d] / r[:, None]
            self.variances = np.maximum(sums[:, 1 + d:] / r[:, None] - self.means ** 2, 0) + self.floor
            self.weights = r / r.sum()
            if abs(loglik / n - last) < self.tolerance:
                break
            last = loglik / n
        return self

    def _log_joint(self, x: np.ndarray) -> np.ndarray:
        z = ((x[:, None, :] - self.means) ** 2 / self.variances).sum(axis=2)
        return np.log(self.weights) - 0.5 * (z + np.log(2 * np.pi * self.variances).sum(axis=1))

    def _sums(self, df: DataFrame, vector: str) -> tuple[np.ndarray, float]:
        model = self

        def partial(batches):
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.asarray(v, float) for v in b[vector]])
                joint = model._log_joint(x)
                top = joint.max(axis=1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
                r = np.exp(joint - total[:, None])
                stats = np.concatenate([r.sum(axis=0)[:, None], r.T @ x, r.T @ (x * x)], axis=1)
                yield pd.DataFrame({"component": np.arange(len(stats)), "stats": list(stats), "loglik": [total.sum()] + [0.0] * (len(stats) - 1)})

        width = 1 + 2 * self.means.shape[1]
        parts = df.select(vector).mapInPandas(partial, "component int, stats array<double>, loglik double")
        rows = parts.groupBy("component").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(width)]).alias("stats"), F.sum("loglik").alias("loglik")).collect()
        out = np.zeros((len(self.means), width))
        for r in rows:
            out[r["component"]] = r["stats"]
        return out, sum(r["loglik"] for r in rows)

    def score(self, df: DataFrame, vector: str, output: str = "score") -> DataFrame:
        model = self

        @F.pandas_udf(T.DoubleType())
        def loglik(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            joint = model._log_joint(np.stack([np.asarray(v, float) for v in x]))
            top = joint.max(axis=1, keepdims=True)
            return pd.Series(top[:, 0] + np.log(np.exp(joint - top).sum(axis=1)))

        return df.withColumn(output, loglik(vector))
