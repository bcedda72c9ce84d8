"""Language identification by compression (operator 6).

Each language has a zstandard raw-content dictionary made of sample texts. A text is compressed with every dictionary; the
one that gives the fewest bytes names the language. A narrow lead over the second is flagged as rejected.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_of, load

FOLDS, HELD_OUT = 4, 2                              # fold 2 of crc32(doc_id) is held out
SAMPLE_TEXTS, TEXT_BYTES = 100, 16_384              # sample texts of a language, and the longest text that is taken as one
DICTIONARY_BYTES = 96_000
LEVEL = 6
MARGIN = 0.02                                       # lead over the second language, as a share of its size
UNKNOWN = "und"


def dictionaries(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Raw content per language, most frequent language first. Null and blank texts and null languages are not learned from.

    The sample is bounded: ``texts`` documents a language in hash order, texts over TEXT_BYTES only after all others, and
    DICTIONARY_BYTES in all. Cost and memory are linear in the number of languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    order = Window.partitionBy("lang").orderBy((F.octet_length("text") > TEXT_BYTES), F.xxhash64("doc_id"), "doc_id")
    # only ids and places pass the window; it keeps `texts` rows per language and task before the shuffle
    first = known.select("lang", "doc_id", F.row_number().over(order).alias("place")).where(F.col("place") <= texts)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    chosen = known.select("lang", "doc_id", "text").join(F.broadcast(first), ["lang", "doc_id"]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    rows = chosen.join(F.broadcast(counts), "lang").select("lang", "place", "n", F.substring(F.encode(F.lower("text"), "utf-8"), 1, TEXT_BYTES).alias("data")).collect()
    found: dict[str, bytes] = {}
    for lang in sorted({(-r.n, r.lang) for r in rows}):
        pieces, size = [], 0
        for r in sorted((r for r in rows if r.lang == lang[1]), key=lambda r: r.place):
            if size < DICTIONARY_BYTES:
                pieces.append(bytes(r.data))
                size += len(r.data) + 1
        found[lang[1]] = b"\n".join(reversed(pieces))[-DICTIONARY_BYTES:]       # the first samples stand nearest to the text
    return found


class Identifier:
    """Compressors of all languages; made once in each worker."""

    def __init__(self, content: dict[str, bytes]):
        self.content, self._machines = content, None

    def __getstate__(self):
        return {"content": self.content, "_machines": None}

    def _compressors(self):
        if self._machines is None:
            self._machines = []
            for data in self.content.values():
                kept = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                kept.precompute_compress(level=LEVEL)
                self._machines.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._machines

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 (0.5: no lead at all) and whether the lead is too narrow."""
        if text is None or not self.content or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        sizes = np.array([len(m.compress(data)) for m in self._compressors()], float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return next(iter(self.content)), 1.0, False
        second = np.delete(sizes, best).min()
        lead = (second - sizes[best]) / second
        return list(self.content)[best], float(1 / (1 + np.exp(-40 * lead))), bool(lead < MARGIN)


def identified(docs: DataFrame, content: dict[str, bytes], name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` (lang, score, rejected). Null texts and texts without a letter are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(Identifier(content))      # DICTIONARY_BYTES a language

    def identify(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.identify(t) for t in text], columns=["lang", "score", "rejected"])
    identify.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    return docs.withColumn(name, F.pandas_udf(identify, "lang string, score double, rejected boolean")("text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), dictionaries(docs), "found")
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")
