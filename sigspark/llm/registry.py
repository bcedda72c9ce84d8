"""Registered queries of the text operators and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_naming, collocations, decontaminate, language, licences, pseudonyms, quality, sentence_pieces, simhash, token_files, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_pseudonyms": pseudonyms.op2_pseudonyms,
    "op3_quality": quality.op3_quality,
    "op4_simhash_dedup": simhash.op4_simhash_dedup,
    "op5_sentence_pieces": sentence_pieces.op5_sentence_pieces,
    "op6_language": language.op6_language,
    "op7_token_files": token_files.op7_token_files,
    "op8_licences": licences.op8_licences,
    "op9_exact_dedup": block_naming.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_collocations": collocations.op11_collocations,
    "op12_warc": warc.op12_warc,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE: dict[str, str] = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op9_exact_dedup": block_naming.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
