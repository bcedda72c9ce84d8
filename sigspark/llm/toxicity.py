"""Toxicity by a weighted lexicon and Aho-Corasick (operator 10).

The text is folded first: letter case, accents, look-alike letters of other scripts, full-width forms, and digits or signs
that stand for a letter inside a word. The lexicon (word beginnings and whole words) and its weights come from labelled
documents; an Aho-Corasick automaton finds all entries in one pass over the whole text. Hits inside an exception phrase do
not count. Two sums of weights, plain and divided by length, go through a logistic curve fitted on the same documents.
"""
from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, free_name, labelled_sample, load

SAMPLE_ROWS = 20_000                                # labelled documents that are fitted on, at most
FOLDS = 5                                           # fold 0 of crc32(doc_id) is held out
ENTRIES = 5_000                                     # lexicon entries, strongest first
MIN_TOXIC, MIN_LIFT = 5, 12.0                       # toxic documents with the entry; odds against other documents
STEMS = (4, 5, 6)                                   # letters of a word beginning

# Letters of other scripts that look like Latin ones, and signs that stand for letters inside a word.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ʟ": "l",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "taking out the trash", "clown fish", "pond scum", "pathetic fallacy", "loser bracket")

_INSIDE = re.compile(r"(?<=[^\W\d_])[01345789@$!|+]{1,3}(?=[^\W\d_])|(?<![^\W_])[01345789]{1,2}(?=[^\W\d_])")
_OTHER = re.compile(r"[^a-z]+")
_MARKED = re.compile(r"[0-9@$!|+]")
_LETTERS = {c: None for c in range(0x300, 0x370)} | str.maketrans(LOOKALIKES)      # combining marks go
_SIGNS = str.maketrans(STANDS_FOR)


def fold(text: str | None) -> str:
    """Words of a-z with one space before, between and after; null and texts without letters give one space."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).lower().translate(_LETTERS)
    if _MARKED.search(t):
        t = _INSIDE.sub(lambda m: m[0].translate(_SIGNS), t)
    inner = _OTHER.sub(" ", t).strip()
    return f" {inner} " if inner else " "


@dataclass
class Model:
    """Lexicon entries start with a space; an entry that ends with one is a whole word, any other a word beginning."""
    lexicon: dict[str, float]
    centre: np.ndarray
    weights: np.ndarray
    exceptions: tuple[str, ...] = EXCEPTIONS
    machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"machine": None}

    def _machine(self):
        if self.machine is None:
            found: dict[str, tuple[float, bool]] = {e: (w, False) for e, w in self.lexicon.items()}
            found |= {fold(e): (0.0, True) for e in self.exceptions}
            self.machine = ahocorasick.Automaton()
            for entry, (weight, harmless) in found.items():
                self.machine.add_word(entry, (len(entry), weight, harmless))
            self.machine.make_automaton() if found else None
        return self.machine

    def features(self, text: str | None) -> list[float]:
        """Sum of the strongest weight of each word hit, and that sum by the root of the number of words."""
        t = fold(text)
        machine = self._machine()
        best: dict[int, float] = {}
        harmless = []
        for end, (long, weight, excepted) in machine.iter(t) if len(machine) else ():
            start = end - long + 1
            if excepted:
                harmless.append((start, end))
            else:
                best[start] = max(best.get(start, weight), weight)
        total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in harmless))      # the space at b begins the next word
        return [np.log1p(total), total / np.sqrt(t.count(" ") or 1)]

    def scores(self, texts: pd.Series) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-(self.centre[0] + (x @ self.weights))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; the first weight is the intercept."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return w


def _entries(text: pd.Series) -> pd.Series:
    """Distinct words and word beginnings of each text."""
    out = []
    for t in text:
        words = set(fold(t).split())
        out.append([f" {w} " for w in words] + list({f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}))
    return pd.Series(out)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> Model:
    """A model from at most ``rows`` labelled documents outside the held-out fold; without any, every score is 0."""
    sample = labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), FOLDS) != 0, rows).select("y", "text").persist()
    try:
        n = sample.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
        if not n["n"] or not n["toxic"] or n["toxic"] == n["n"]:
            return Model({}, np.array([np.inf if n["n"] and n["toxic"] == n["n"] else -np.inf]), np.zeros(2))
        seen = (sample.select("y", F.explode(F.pandas_udf(_entries, "array<string>")("text")).alias("entry")).groupBy("entry")
                .agg(F.sum("y").alias("toxic"), F.count("*").alias("all")).where(F.col("toxic") >= MIN_TOXIC))
        odds = ((F.col("toxic") + 0.5) / (n["toxic"] + 1)) / ((F.col("all") - F.col("toxic") + 0.5) / (n["n"] - n["toxic"] + 1))
        strong = seen.withColumn("lift", odds).where(F.col("lift") >= MIN_LIFT).orderBy(F.desc(F.col("toxic") * F.log("lift")), "entry").limit(entries)
        model = Model({r.entry: float(np.log(r.lift)) for r in strong.collect()}, np.zeros(1), np.zeros(2))

        def measured(text: pd.Series) -> pd.Series:
            return pd.Series([model.features(t) for t in text])
        measured.__annotations__ = {"text": pd.Series, "return": pd.Series}
        found = sample.select("y", F.pandas_udf(measured, "array<double>")("text").alias("x")).collect()      # two numbers per sampled row
    finally:
        sample.unpersist()
    w = _logistic(np.array([r.x for r in found]), np.array([r.y for r in found], float))
    return Model(model.lexicon, w[:1], w[1:])


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a double column ``name`` from 0 to 1. Null and empty texts have no hits and get the score of a text without any."""
    shared = docs.sparkSession.sparkContext.broadcast(model)           # at most ENTRIES entries

    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(text))
    score.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return docs.withColumn(name, F.pandas_udf(score, "double")("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged. Null and empty texts score as texts without
    a listed word; repeated rows are judged alike; an empty table stays empty."""
    score = free_name("_score", docs)
    return scored(docs, fit(docs, labels), score).where(F.col(score) < threshold).drop(score)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    found = scored(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
