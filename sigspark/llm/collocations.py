"""Phrase collocations from sorted count streams (operator 11).

The layout is that of external stream estimation. A task cuts its texts into runs of bounded size and writes each run's
windows of up to four words, sorted and counted, as one chunk per range of the prefix order. A range's chunks meet in one task,
are merged, and one pass over the merged stream gives the count of every phrase that begins there: a phrase of k words is a run
of windows with equal first k words. What crosses the end of a range is added up afterwards. From there on only phrases of the
least count and their parts travel: no part of a phrase is rarer than the phrase. They lie as two streams, in prefix order
(sorted by the first part of each cut) and in suffix order (sorted by the rest), and the count stream is merge-joined with
both in lockstep for left and right counts, and with the largest counts of one-word extensions on either side. Joins are
sort-merge joins by hint; no task builds a hash table of counts.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, settle

LONGEST = 4                                         # words of a phrase, at most
RUN_BYTES = 8 << 20                                 # text that a task sorts at once
RANGE_BYTES = 16 << 20                              # text per range of the prefix order, which bounds what one task merges
SAMPLES = 20                                        # sampled windows per range, from which the driver takes the cut points
BUCKETS = 32                                        # of the candidates of a language, before its first rows are taken
SCALE = 2_000_000

# What separates pieces, what separates words of a piece, what is lower-cased.
PIECE_BREAKS, WORD_BREAKS, UPPER, LOWER = ".,;:!?\n\x0b\x0c\r", " \t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in WORD_BREAKS]], _KIND[[ord(c) for c in PIECE_BREAKS]] = 1, 2
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
_BREAK = re.compile(f"[{PIECE_BREAKS}]")
_CHUNK = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("vocabulary", pa.binary()), ("cells", pa.binary())])
_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

Cuts = dict[str, tuple[list[int], list[tuple[bytes, ...]]]]         # by language: numbers of the ranges and the windows they begin with


def _runs(langs: list[str], texts: list[str | None], limit: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of about ``limit`` bytes; texts of one language after one another, with a break between. A longer text is divided at a break."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(langs, texts):
        at = 0
        while text is not None and at < len(text):
            cut = _BREAK.search(text, at + limit) if len(text) - at > limit else None
            part = text[at:cut.end() if cut else len(text)].encode("utf-8", "surrogatepass")
            at = cut.end() if cut else len(text)
            held.setdefault(lang, []).append(part)
            size[lang] = size.get(lang, 0) + len(part)
            if size[lang] >= limit:
                yield lang, b"\n".join(held.pop(lang))
                del size[lang]
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _windows(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """Sorted distinct words, and for each word of ``text`` in order the ranks of it and the next three, from 1; 0 beyond the piece."""
    data = _FOLDED[np.frombuffer(text, np.uint8)]
    kind = _KIND[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])]).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    first = rank[words.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int32)
    breaks = np.flatnonzero(kind == 2)
    piece = np.searchsorted(breaks, starts)
    ranks = np.zeros((LONGEST, len(first)), np.int32)
    ranks[0] = first
    for j in range(1, min(LONGEST, len(first))):
        ranks[j, :-j] = np.where(piece[j:] == piece[:-j], first[j:], 0)
    return words.dictionary.take(order), ranks


def _keys(ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``ranks`` (of ``size`` words) as two longs that sort as they do."""
    high, low = (np.multiply(ranks[j], size + 1, dtype=np.int64) for j in (0, 2))
    high += ranks[1]
    low += ranks[3]
    return high, low


def _sorted_counts(high: np.ndarray, low: np.ndarray, size: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of these keys in order, as columns of ranks, and how often each occurs (the sum of ``counts``)."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    total = np.diff(np.concatenate((new, [len(order)]))) if counts is None else np.add.reduceat(counts[order], new, dtype=np.int64)
    del order
    ranks = np.empty((LONGEST, len(new)), np.int32)
    ranks[0], ranks[1] = np.divmod(high[new], size + 1)
    ranks[2], ranks[3] = np.divmod(low[new], size + 1)
    return ranks, total


def _pack(values: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values)


def _unpack(values: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(values)


def _chunks(lang: str, text: bytes, cuts: Cuts) -> Iterator[tuple[str, int, bytes, bytes]]:
    """The sorted windows of one run as (lang, range, words, cells); cells are four rows of ranks among the chunk's words and one of counts, uint32."""
    words, ranks = _windows(text)
    if not ranks.shape[1]:
        return
    ranks, counts = _sorted_counts(*_keys(ranks, len(words)), len(words))
    numbers, points = cuts.get(lang, ([0], [()]))
    window = lambda i: tuple(words[int(r) - 1].as_py() for r in ranks[:, i] if r)
    ends = [bisect_left(range(len(counts)), p, key=window) for p in points[1:]]
    for number, start, stop in zip(numbers, [0, *ends], [*ends, len(counts)]):
        if start < stop:
            used, local = np.unique(ranks[:, start:stop], return_inverse=True)
            none = used[0] == 0
            cells = np.vstack([local.reshape(LONGEST, -1) + (0 if none else 1), counts[None, start:stop]]).astype("<u4")
            yield lang, number, _pack(b"\n".join(words.take(pa.array(used[none * 1:] - 1)).to_pylist())), _pack(cells.tobytes())


def _merged(vocabularies: list[bytes], cells: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of a range as one stream: sorted words, distinct windows in order, counts."""
    own = [pa.array(_unpack(v).split(b"\n"), pa.binary()) for v in vocabularies]
    words = pc.unique(pa.concat_arrays(own))
    words = words.take(pc.sort_indices(words))
    high, low, counts = [], [], []
    for vocabulary, packed in zip(own, cells):
        rank = np.concatenate(([0], pc.index_in(vocabulary, words).to_numpy() + 1)).astype(np.int32)
        cell = np.frombuffer(_unpack(packed), "<u4").reshape(LONGEST + 1, -1)
        for key, to in zip(_keys(rank[cell[:LONGEST]], len(words)), (high, low)):
            to.append(key)
        counts.append(cell[LONGEST].copy())                         # not a view, which would hold the whole chunk
    joined = [_joined(parts) for parts in (high, low, counts)]
    return words, *_sorted_counts(joined.pop(0), joined.pop(0), len(words), joined.pop(0))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts after one another; the list is emptied, so that they are not held twice."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _phrase_counts(table: pa.Table, least: int) -> pa.Table:
    """Phrases of a (language, range) with their counts: those of ``least`` at least, and the first and last run of each
    length whatever their count, for they may go on in the neighbouring ranges. The row of 0 words counts all."""
    words, ranks, counts = _merged(table["vocabulary"].to_pylist(), table["cells"].to_pylist())
    found = [(pa.array([""]), 0, np.array([counts.sum()]))]
    changed = np.zeros(ranks.shape[1], bool)
    changed[0] = True
    for k in range(LONGEST):
        changed[1:] |= ranks[k, 1:] != ranks[k, :-1]
        at = np.flatnonzero(changed)
        total = np.add.reduceat(counts, at)
        kept = total >= least
        kept[[0, -1]] = True
        kept &= ranks[k, at] > 0
        columns = [words.take(pa.array(ranks[j, at[kept]] - 1)) for j in range(k + 1)]
        phrases = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if k else columns[0]
        found.append((phrases.cast(pa.string()), k + 1, total[kept]))
    langs = pa.array([table["lang"][0].as_py()] * sum(len(p) for p, _, _ in found), pa.string())
    return pa.Table.from_arrays([langs, pa.concat_arrays([p for p, _, _ in found]), pa.array(np.concatenate([np.full(len(p), k, np.int32) for p, k, _ in found])),
                                 pa.array(np.concatenate([f for _, _, f in found]).astype(np.int64))], schema=_COUNT)


def _cut_points(texts: DataFrame, range_bytes: int) -> Cuts:
    """Where the ranges of the prefix order begin: about one cut per ``range_bytes`` of text, from SAMPLES windows for each. The
    sample decides what a task gets, never a result; a window that many runs share stays in one range."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = math.ceil(total / range_bytes)
    if ranges <= 1:
        return {}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _runs(batch["lang"].to_pylist(), batch["text"].to_pylist(), RUN_BYTES):
                words, ranks = _windows(text)
                if ranks.shape[1]:
                    places = np.arange(0, ranks.shape[1], 97)                       # neighbours overlap; a few of a text say enough
                    names = [b"\n".join(words[int(r) - 1].as_py() for r in ranks[:, i] if r) for i in places]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array(names, pa.binary())], names=["lang", "window"])
    share = max(1, total // (ranges * (128 << 10)))
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("lang", "text").mapInArrow(sampled, "lang string, window binary")
    rows = sorted((r["lang"].encode("utf-8", "surrogatepass"), tuple(bytes(r["window"]).split(b"\n")), r["lang"]) for r in chosen.orderBy(F.xxhash64("window", "lang"), "window").limit(SAMPLES * ranges).collect())
    cuts: Cuts = {}
    last = None
    for number in range(1, ranges):
        _, window, lang = rows[number * len(rows) // ranges] if rows else (b"", (), "")
        if rows and (lang, window) != last:
            last = lang, window
            numbers, points = cuts.setdefault(lang, ([0], [()]))
            numbers.append(number)
            points.append(window)
    return cuts


def phrase_counts(docs: DataFrame, least: int, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to LONGEST words that occur ``least`` times or more; 0 words: all word occurrences of the language."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    cuts = docs.sparkSession.sparkContext.broadcast(_cut_points(texts, range_bytes))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _runs(batch["lang"].to_pylist(), batch["text"].to_pylist(), run_bytes):
                for chunk in _chunks(lang, text, cuts.value):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(chunk, _CHUNK)], schema=_CHUNK)

    def merge(table: pa.Table) -> pa.Table:
        return _phrase_counts(table, least)
    chunks = texts.select("lang", "text").mapInArrow(cut_up, "lang string, range int, vocabulary binary, cells binary")
    parts = chunks.groupBy("lang", "range").applyInArrow(merge, "lang string, phrase string, words int, f long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def _first(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, first: int = 2000, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` best phrases of 2 to 4 words of each language.

    Texts are lower-cased (A-Z), cut at PIECE_BREAKS into pieces and those at spaces and tabs into words. a counts the phrase, l
    and r the two parts of its lowest-scoring cut, n all words of the language, and the score is 2 000 000 a / (l + r), floored;
    of equal scores the shortest first part counts. A phrase is left out where one that contains it has ``inside`` per cent of its
    count or more: the one-word extensions suffice, since no longer phrase is more frequent. Null languages are "und", null and
    empty texts have no words, repeated rows count again, no rows give no rows, further columns are ignored.
    """
    counts = settle(phrase_counts(docs, least, run_bytes, range_bytes))
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
           .select("lang", "phrase", "a", "k", _first(F.col("phrase"), F.col("k")).alias("before"), _first(F.col("phrase"), F.col("k") - F.col("words")).alias("after")))
    prefix_order = cut.join(known.withColumnsRenamed({"part": "before", "part_f": "l"}).hint("merge"), ["lang", "before"])
    both = prefix_order.join(known.withColumnsRenamed({"part": "after", "part_f": "r"}).hint("merge"), ["lang", "after"])
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = (both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    sides = F.array(_first(F.col("phrase"), F.col("words") - 1), _first(F.col("phrase"), 1 - F.col("words")))
    longer = phrases.where("words > 2").select("lang", F.explode(sides).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = (scored.join(longer.hint("merge"), ["lang", "phrase"], "left")
            .where(F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {inside}")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("bucket"))
    few = rows.withColumn("own", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("own") <= first)     # BUCKETS * first rows of a language at most
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
    from documents where text is not null),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
totals as (select lang, count(*) as n from places group by lang),
spans as (select lang, w, i, unnest([1, 2, 3, 4]) as m from places),
counts as (
    select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, count(*) as f
    from spans where i + m - 1 <= len(w) group by 1, 2, 3 having count(*) >= 30),
cand as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from counts where m > 1),
cuts as (select *, unnest(range(1, m)) as k from cand),
scored as (
    select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, cast((cast(c.a as hugeint) * 2000000) // (cast(x.f as hugeint) + y.f) as bigint) as score
    from cuts c join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
    join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
    select lang, m, a, array_to_string(w[i:i + q - 1], ' ') as phrase
    from (select *, unnest(range(1, m - q + 2)) as i from (select *, unnest(range(2, m)) as q from cand))),
longer as (select lang, phrase, max(a) as longer from inner_parts group by 1, 2),
kept as (
    select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase
    where o.longer is null or 100 * cast(o.longer as hugeint) < 80 * cast(b.a as hugeint))
select lang, rank, phrase, a, l, r, n, score from (
    select k.lang, row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from kept k join totals t on t.lang = k.lang)
where rank <= 2000
"""
