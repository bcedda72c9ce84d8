"""Small helpers shared by the text operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, or that with underscores behind it, such that no column of ``tables`` has it in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; what is read twice must not be computed twice with other row numbers."""
    return cut_lineage(df)


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, y, text, n_chars): the bounded sample a classifier is fitted on.

    Rows are taken in the order of a hash of doc_id. Null ids, labels and texts are left out; a doc_id with several labels
    counts with the largest one, a doc_id with several texts with the smallest.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    text = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [F.lit(None).cast("long").alias("n_chars")]))
    return (text.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")       # at most `rows` narrow rows
            .groupBy("doc_id", "y").agg(F.min(F.struct("text", "n_chars")).alias("t"))
            .select("doc_id", "y", "t.text", "t.n_chars"))


def same_row_once(rows: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """``rows`` whose (doc_id, ``key``) is in ``decided`` (columns doc_id and key), each (doc_id, key) once.

    Ids that occur once, the usual case, are told by the id and never shuffle their text; only for rows of repeated ids the
    key is made and compared.
    """
    kept_id, again_id, own, wanted_key = (free_name(c, rows) for c in ("_kept", "_again", "_key", "_wanted"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = settle(ids.where("n > 1").select("doc_id"))
    kept = rows.join(decided.select(F.col("doc_id").alias(kept_id)).distinct(), F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    if again.isEmpty():
        return kept
    twice = again.select(F.col("doc_id").alias(again_id))
    match = F.col("doc_id").eqNullSafe(F.col(again_id))
    wanted = decided.select(F.col("doc_id").alias(kept_id), F.col("key").alias(wanted_key))
    repeated = kept.join(twice, match, "left_semi").withColumn(own, key)
    repeated = repeated.join(wanted, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(wanted_key)), "left_semi")
    return kept.join(twice, match, "left_anti").unionByName(repeated.dropDuplicates(["doc_id", own]).drop(own))
