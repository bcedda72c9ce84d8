"""Seeded samples, caps, quotas and top-k. Order is always a hash of seed and key, never the arrival order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .replicates import PRIME
from .scan import ordered

MAX_DRAWN = 1024                                    # training units of one draw


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows per key. Spark prunes to n rows per key in every input partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def capped_sample(df: DataFrame, keys: list[str], row_key: str, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """At most n rows per key (a group, a source, a folder), chosen by seeded hash order."""
    chosen = F.xxhash64(F.lit(seed), F.col(row_key)) if order is None else order
    return first_n(df, keys, [chosen, F.col(row_key)], n)


def running_quota(df: DataFrame, keys: list[str], order: list[str], amount: str, quota: float,
                  target_rows: int | None = None) -> DataFrame:
    """Take rows in order until the quota is met: a row is kept while the sum of the rows before it is below it."""
    scan = ordered(df, keys, order, target_rows).running({"_before": (F.sum, F.col(amount))}, inclusive=False)
    return scan.frame().where(F.coalesce(F.col("_before"), F.lit(0)) < quota).drop("_before")


def _pick(rep: Column, slot: Column, n: Column) -> Column:
    """``replicates.picks`` as a column expression."""
    p = F.lit(PRIME).cast("long")
    r = (F.pmod(rep, p) + 1) * F.lit(69621) % p
    h = ((F.pmod(slot, p) + 1) * F.lit(48271) + F.floor(slot / p) * F.lit(40692) % p + r) % p
    a = h * (h + F.lit(16807)) % p
    b = a * ((a + r) % p) % p
    c = b * (b + F.lit(12345)) % p
    return (c * p + b) % n


def training_draws(units: DataFrame, held_out: DataFrame, unit: str, k: int, draws: int, seed: int = 0) -> DataFrame:
    """(held_out, draw, unit): k training units per held-out unit and draw, each set drawn anew and without replacement;
    held-out units with fewer than k others are left out.

    Units are numbered in sorted order. The j-th pick is a place among the units not yet taken, moved past the taken ones
    below it; the held-out unit counts as taken from the start. So a draw is computed from (seed, k, draw, held-out unit)
    alone, draws are independent between held-out units and values of k, and no (held-out, unit) grid is formed.
    """
    if not 0 < k <= MAX_DRAWN:
        raise ValueError(f"k must be from 1 to {MAX_DRAWN}")
    names = units.select(unit).where(F.col(unit).isNotNull()).distinct()
    n = names.count()
    numbered = cut_lineage(ordered(names, [], [unit], n_rows=n).row_number("_at").frame().select((F.col("_at") - 1).alias("_at"), unit))
    targets = (held_out.select(F.col(unit).alias("held_out")).distinct().join(numbered.withColumnRenamed(unit, "held_out"), "held_out", "left")
               .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))))
    taken = F.when(F.col("_at").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_at"))
    own = F.coalesce(F.col("_at"), F.lit(n) + F.pmod(F.xxhash64("held_out"), F.lit(PRIME)))
    rep = F.lit(seed * 1_000_003 + k * 1009) + F.col("draw").cast("long") * 65537

    def take(so_far: Column, j: Column) -> Column:
        free = _pick(rep, own * MAX_DRAWN + j, F.lit(n).cast("long") - F.size(so_far))
        return F.array_append(so_far, F.aggregate(F.array_sort(so_far), free, lambda place, t: place + F.when(t <= place, 1).otherwise(0).cast("long")))
    chosen = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), taken, take)
    drawn = (targets.where(F.lit(n) - F.size(taken) >= k)
             .select("held_out", "draw", F.explode(F.slice(chosen, F.size(taken) + 1, k)).alias("_at")))
    return drawn.join(numbered, "_at").select("held_out", "draw", unit)
