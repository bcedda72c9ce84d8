"""Corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark passages, pieces.

Every stage takes the documents its predecessor kept, all columns as they were; the last returns the encoded documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import block_naming, decontaminate, sentence_pieces, simhash, toxicity
from sigspark.llm.common import load
from sigspark.session import scratch_path


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return block_naming.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more is in a benchmark window go."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and digests of ids and decoded text."""
    pieces = sentence_pieces.Pieces.of_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.digests(sentence_pieces.decode(sentence_pieces.encode(docs, pieces), pieces), "ids")


STAGES = [("toxicity", non_toxic), ("exact duplicates", exact_dedup), ("near duplicates", near_dedup), ("benchmark passages", decontaminated), ("pieces", encoded)]
ORACLE_SQL = None                                   # the fitted classifier, SimHash and the pieces have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
