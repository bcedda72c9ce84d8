"""Benchmark decontamination with a generalised suffix automaton (operator 1).

The automaton holds the word sequences of all test items. Training words stream through it; its state is always the longest
piece of an item that ends at the current word. Where that length reaches a window, the window's words are hit and the
items of the state are noted. Documents stay where they are: the pass adds columns and shuffles nothing.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, load

WINDOW, PARTS = 13, 20
SHARD_WORDS = 1_000_000                             # item words in one automaton, which is what a broadcast holds
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lowered; words are runs of a-z, 0-9 and everything beyond ASCII. Null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


class Automaton:
    """Generalised suffix automaton over word numbers; ``ends`` gives the windows that end in a state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.ends: dict[int, dict[int, frozenset[str]]] = {}
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        numbered = [(item, [self.number.setdefault(x, len(self.number)) for x in w]) for item, w in items if w]
        for _, sequence in numbered:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        marks: dict[int, dict[int, set[str]]] = {}
        for item, sequence in numbered:
            wide = min(window, len(sequence))
            for state, long in self._run(sequence):
                if long >= wide:
                    while self.length[self.link[state]] >= wide:
                        state = self.link[state]
                    marks.setdefault(state, {}).setdefault(wide, set()).add(item)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):          # links first
            above = self.ends.get(self.link[state], {}) if state else {}
            own = marks.get(state, {})
            if above or own:
                self.ends[state] = {w: frozenset(own.get(w, ())) | above.get(w, frozenset()) for w in {*own, *above}}

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state of exactly length[p] + 1 behind the edge; made from the longer one if need be."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = short
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol)
        return new

    def _run(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matched length after every symbol."""
        state = long = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                long = self.length[state]
            if symbol in self.next[state]:
                state, long = self.next[state][symbol], long + 1
            yield state, long

    def hits(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans covered by windows, and the items of those windows."""
        numbers = np.fromiter(map(self.number.get, document, iter(lambda: -1, None)), np.int64, len(document))
        spans: list[list[int]] = []
        found: set[str] = set()
        known = np.flatnonzero(np.diff(np.concatenate(([0], numbers >= 0, [0]))))
        for start, stop in known.reshape(-1, 2).tolist():                                 # runs of words that items have
            if stop - start < self.shortest:
                continue
            for at, (state, long) in enumerate(self._run(numbers[start:stop].tolist()), start + 1):
                wide = 0
                for w, items in self.ends.get(state, {}).items():
                    if w <= long:
                        wide = max(wide, w)
                        found |= items
                if wide:
                    if spans and spans[-1][1] >= at - wide:
                        spans[-1] = [min(spans[-1][0], at - wide), at]
                    else:
                        spans.append([at - wide, at])
        return merged(spans), found


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of about ``limit`` words; one group at a time is on the driver."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = -(-size // limit)
    for k in range(shards):
        yield [(r.item, words(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).toLocalIterator()]


SCHEMA = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def _scan(automaton) -> Callable:
    def scan(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, old_spans, old_items in zip(text, before["spans"], before["items"]):
            w = words(t)
            spans, items = automaton.value.hits(w) if automaton else ([], set())
            if len(old_spans):
                spans = merged([*spans, *((s["start"], s["stop"]) for s in old_spans)])
            out.append((len(w), [{"start": a, "stop": b} for a, b in spans], sorted(items.union(old_items))))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])
    scan.__annotations__ = {"text": pd.Series, "before": pd.DataFrame, "return": pd.DataFrame}
    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, spans (word positions, merged) and items (ids as sorted strings).

    Null or empty texts have no words, null or empty items no windows; repeated items count once. Without items nothing is
    hit. Rows are neither moved nor lost. Items beyond ``shard_words`` words go through further passes of the same kind.
    """
    empty = F.from_json(F.lit('{"n_words":0,"spans":[],"items":[]}'), SCHEMA)
    scanned = docs.withColumn(name, empty)
    context = docs.sparkSession.sparkContext
    automata = [context.broadcast(Automaton(shard, window)) for shard in _shards(benchmark, shard_words)] or [None]
    for automaton in automata:
        scanned = scanned.withColumn(name, F.pandas_udf(_scan(automaton), SCHEMA)(F.col("text"), F.col(name)))
    return scanned


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated(found: Column, parts: int = PARTS) -> Column:
    """One word in ``parts`` or more is hit."""
    return (hit_words(found) > 0) & (parts * hit_words(found) >= found["n_words"])


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    table, places, at = data.translate(LETTERS), [], 0
    for w in table.split():
        at = table.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, parts: int = PARTS, cut: bool = False) -> DataFrame:
    """``docs`` without documents of which windows cover one word in ``parts`` or more; the rest is unchanged.

    With ``cut`` those documents stay, and lose the covered spans instead. Null and empty texts have no words and stay; repeated
    rows are judged alike; an empty table stays empty, and an empty benchmark changes nothing.
    """
    name = free_name("_found", docs)
    found = contamination(docs, benchmark, name, window)
    bad = contaminated(F.col(name), parts)
    if not cut:
        return found.where(~bad).drop(name)

    def removed(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(text, spans)])
    removed.__annotations__ = {"text": pd.Series, "spans": pd.Series, "return": pd.Series}
    return found.withColumn("text", F.when(bad, F.pandas_udf(removed, "string")("text", F.col(name)["spans"])).otherwise(F.col("text"))).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"), "found")
    found = F.col("found")
    return docs.select("doc_id", found["n_words"].alias("n_words"), hit_words(found).alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", found["items"]), 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


OP1_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g
            from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
grams as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as g
          from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) where len(w) >= n)),
hits as (select r, item_id, n, i from grams join windows using (n, g)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, n, i from hits)) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from hits) group by r)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from d left join covered using (r) left join named using (r)
"""
