"""Derived tables kept under a fingerprint of everything they depend on, and result sinks."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(inputs: dict[str, DataFrame]) -> dict[str, list]:
    """Order-free content fingerprint of each input: one pass, one row per table."""
    out = {}
    for name, df in sorted(inputs.items()):
        cols = sorted(df.columns)
        h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if dict(df.dtypes)[c].startswith("map") else F.col(c) for c in cols])
        # xor cancels equal pairs, so the count and a second, summed hash stand beside it
        r = df.select(h.alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)),
                                        F.coalesce(F.sum(F.pmod("h", F.lit(2147483647))), F.lit(0))).first()
        out[name] = [cols, r[0], r[1], r[2]]
    return out


def key(name: str, params: dict, inputs: dict[str, DataFrame], version: str = "1") -> str:
    text = json.dumps([name, version, params, fingerprint(inputs)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def materialize(spark: SparkSession, folder: str, name: str, params: dict, inputs: dict[str, DataFrame],
                build: Callable[[], DataFrame], version: str = "1") -> DataFrame:
    """Reuse the table if one with this fingerprint was completely written, else build and write it.

    ``inputs`` are the catalog tables a result depends on (captures, artifacts with their checksums), not the samples,
    since fingerprinting reads them in full. ``version`` names the code; raise it when the computation changes.
    """
    path = f"{folder.rstrip('/')}/{name}-{key(name, params, inputs, version)}"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    build().write.mode("overwrite").parquet(path)           # committed by the job; a failed job leaves no readable table
    return spark.read.parquet(path)


def append_results(results: DataFrame, path: str, test: str) -> None:
    """One JSON record per experiment row with its name and time."""
    (results.withColumn("test", F.lit(test)).withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
     .write.mode("append").json(path))


def max_feature_difference(current: DataFrame, cached: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(rows, missing, max_abs_difference): recomputed features of sampled captures against the stored table."""
    b = cached.select(*keys, F.lit(True).alias("_found"), *[F.col(f).alias(f"_b_{f}") for f in features])
    gap = F.greatest(*[F.abs(F.col(f) - F.col(f"_b_{f}")) for f in features], F.lit(0.0))
    return current.join(b, keys, "left").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("_found").isNull(), 1).otherwise(0)).alias("missing"),
                                             F.max(gap).alias("max_abs_difference"))


def staleness(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows in only one of two versions of a derived table; empty means up to date."""
    cols = rebuilt.columns
    return (stored.select(*cols).exceptAll(rebuilt).withColumn("only_in", F.lit("stored"))
            .unionByName(rebuilt.exceptAll(stored.select(*cols)).withColumn("only_in", F.lit("rebuilt"))))
