"""The driver's Parquet tables, and how each one stands in for a domain table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a score table: group = user, label a function of the user so that groups are label-pure."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("group_id"), (F.col("user_id") % 3 == 0).alias("y"), F.col("value").alias("score"),
                    "ts", "event_type")


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels: truth = quality, prediction from length, group = source and quality (label-pure)."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.concat_ws("/", "source", F.col("quality").cast("string")).alias("group_id"),
                    F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("predicted"),
                    (F.length("text") % 2).cast("int").alias("other"), "toxic")


def r6(c: Column) -> Column:
    return F.round(c, 6)
