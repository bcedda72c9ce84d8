"""SentencePiece encoding and decoding as a relational lattice (operator 5).

Text is cut into units that no piece can cross. Each distinct unit is encoded once for the corpus: its substrings of bounded
length are exploded and equi-joined with the piece table, the edges are grouped by unit, and a higher-order aggregate folds
them. For a unigram model the fold is Viterbi: the best score of every end position. A BPE model's scores are merge ranks,
and the segmentation with the best sum of ranks is not the model's encoding; there the fold takes the edges by (rank, start)
and merges where exactly two current symbols meet. Ranks never fall along the merges of a piece (checked when the table is
made), so one pass in that order gives the library's result.

Documents meet the encoded units in blocks: a block's texts are shuffled once, compressed, and of its units only the distinct
ones that are not among a bounded number of common ones travel. The unit goes alone through the lattice; what comes back to a
block is a long per unit, the ends of its symbols as bits. Nothing that grows with the corpus is broadcast.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SPACE = "▁"
BLOCK_BYTES = 4 << 20                               # text of one block
ZSTD_BYTES = 100_000                                # of common units, as a dictionary for compressing texts on their way
COMMON_UNITS, SAMPLE_BYTES = 300_000, 32 << 20      # units that are broadcast, at most, and the text they are chosen from
SHORT = 62                                          # longest unit whose boundaries fit the bits of a long
LETTER = r"[A-Za-z\u00AA-\u02FF\u0370-\u1FFF]"        # one class that Java and Python read alike


@dataclass(frozen=True)
class Pieces:
    """A piece table. ``score`` is the rank of the merge for BPE (lower first) and the log probability for unigram."""
    kind: str                                       # bpe or unigram
    pieces: tuple[tuple[str, int, float], ...]      # piece, id, score
    byte_ids: tuple[int, ...]                       # id of each byte value
    prefix: bool = True                             # a space before the first word
    control: tuple[int, ...] = (0, 1, 2)

    def __post_init__(self):
        if self.kind == "bpe":
            rank = {p: s for p, _, s in self.pieces}
            for piece in rank:
                if len(piece) > 1:
                    symbols, taken = _merged(piece, rank)
                    if len(symbols) > 1 or any(a > b for a, b in zip(taken, taken[1:])):
                        raise ValueError(f"the merges of {piece!r} do not rise to it; one pass by rank would not be the model's encoding")

    @staticmethod
    def of_model(path: str) -> Pieces:
        """The table of a BPE model file with byte fallback, read with the public library."""
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        return Pieces("bpe", tuple((model.id_to_piece(i), i, -model.get_score(i)) for i in usual), tuple(byte_ids[b] for b in range(256)),
                      control=tuple(i for i in range(len(model)) if model.is_control(i) or model.is_unknown(i)))

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    def cuts(self) -> str:
        """Pattern of places inside a text that no piece crosses, judged by the pairs of neighbours inside pieces."""
        pairs = {pair for p, _, _ in self.pieces for pair in zip(p, p[1:])}
        plain = [chr(c) for c in range(128) if not chr(c).isalpha() and chr(c) != " "]
        letter = re.compile(LETTER).match
        after = [c for c in plain if not any(b == c and letter(a) for a, b in pairs)]
        before = [c for c in plain if not any(a == c and letter(b) for a, b in pairs)]
        places = [] if any(b == SPACE and a != SPACE for a, b in pairs) else [f"(?<=[^{SPACE}])(?={SPACE})"]
        listed = lambda cs: "".join(f"\\x{ord(c):02x}" for c in cs)
        places += [f"(?<={LETTER})(?=[{listed(after)}])"] * bool(after) + [f"(?<=[{listed(before)}])(?={LETTER})"] * bool(before)
        return "|".join(places) or r"(?!)"


def _merged(unit: str, rank: dict[str, float]) -> tuple[list[str], list[float]]:
    """BPE of one unit with a heap: symbols, and the ranks taken in order. Time n log n in the unit's length."""
    text, stop, left = unit, list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    alive, taken, todo = [True] * len(unit), [], []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(text):
            r = rank.get(text[a:stop[b]])
            if r is not None:
                heapq.heappush(todo, (r, a, b, stop[b]))
    for i in range(len(unit) - 1):
        offer(i, i + 1)
    while todo:
        r, a, b, end = heapq.heappop(todo)
        if not (alive[a] and b < len(text) and alive[b] and stop[a] == b and stop[b] == end):
            continue
        alive[b], stop[a] = False, end
        if end < len(text):
            left[end] = a
        taken.append(r)
        offer(left[a], a)
        offer(a, end)
    return [text[i:stop[i]] for i in range(len(unit)) if alive[i]], taken


def _viterbi(unit: str, score: dict[str, float], longest: int, unknown: float) -> list[str]:
    best: list[tuple[float, int]] = [(0.0, 0)]
    for stop in range(1, len(unit) + 1):
        found = [(best[a][0] + score[unit[a:stop]], -a) for a in range(max(0, stop - longest), stop) if unit[a:stop] in score]
        if unit[stop - 1] not in score:
            found.append((best[stop - 1][0] + unknown, 1 - stop))
        s, a = max(found)
        best.append((s, -a))
    out, stop = [], len(unit)
    while stop:
        out.append(unit[best[stop][1]:stop])
        stop = best[stop][1]
    return out[::-1]


def normalised(text: Column, prefix: bool = True) -> Column:
    """Spaces as their sign, one before the first word; null and empty texts as null."""
    t = F.when(F.length(text) > 0, text)
    return F.concat(F.lit(SPACE if prefix else ""), F.replace(t, F.lit(" "), F.lit(SPACE)))


def units(text: Column, pieces: Pieces) -> Column:
    """Units of the normalised text in order; null and empty texts have none."""
    return F.coalesce(F.split(normalised(text, pieces.prefix), pieces.cuts(), -1), F.array().cast("array<string>"))


def encoded_units(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, mask) of ``distinct`` (a column unit of at most SHORT characters, no repeats): bit k of the mask says that a symbol
    ends before character k. Units in which no longer piece occurs may be left out; all their characters are symbols."""
    spark = distinct.sparkSession
    ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces.pieces}))}
    bpe = pieces.kind == "bpe"
    rows = [(p, ranks[s], float(s)) for p, _, s in pieces.pieces if len(p) > 1 or not bpe]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, rank int, score double"))        # the model: fixed size
    length, least = F.char_length("unit"), 2 if bpe else 1
    # outer, so that no filter on the length is pushed below the exchange that `distinct` shares with others
    starts = distinct.withColumn("start", F.explode_outer(F.when(length >= least, F.sequence(F.lit(0), length - least)))).where("start is not null")
    spans = starts.withColumn("long", F.explode(F.sequence(F.lit(least), F.least(F.lit(max(pieces.longest, least)), length - F.col("start")))))
    spans = spans.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("long")))
    stop = F.col("start") + F.col("long")
    if bpe:                                                         # rank, start and stop in one long, which also sorts by them
        edge = F.shiftleft(F.col("rank").cast("long"), 12) + (F.col("start") * 64 + stop)
        edges = spans.join(table, "piece").groupBy("unit").agg(F.collect_list(edge).alias("edges"))
        return edges.select("unit", _merge_fold(F.col("edges"), F.col("unit")).alias("mask"))
    edge = F.struct(stop.alias("stop"), "start", F.coalesce("score", F.lit(_unknown(pieces))).alias("score"))
    edges = spans.join(table, "piece", "left").where("rank is not null or long = 1").groupBy("unit").agg(F.collect_list(edge).alias("edges"))
    return edges.select("unit", _viterbi_fold(F.col("edges"), F.col("unit")).alias("mask"))


def _unknown(pieces: Pieces) -> float:
    return min((s for _, _, s in pieces.pieces), default=0.0) - 10.0


def _on(mask: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", mask, place).bitwiseAND(F.lit(1).cast("long")) == 1


def _between(mask: Column, start: Column, stop: Column) -> Column:
    """Boundaries strictly inside."""
    one = F.lit(1).cast("long")
    inside = (F.call_function("shiftleft", one, stop) - F.call_function("shiftleft", one, start + 1))
    return mask.bitwiseAND(inside)


def _merge_fold(edges: Column, unit: Column) -> Column:
    """BPE: boundaries are the bits of a long; an edge merges where both its ends are boundaries and one lies between."""
    one = F.lit(1).cast("long")
    everywhere = F.call_function("shiftleft", one, F.char_length(unit) + 1) - 1

    def step(mask: Column, e: Column) -> Column:
        start, stop = F.shiftright(e, 6).bitwiseAND(F.lit(63).cast("long")).cast("int"), e.bitwiseAND(F.lit(63).cast("long")).cast("int")
        inner = _between(mask, start, stop)
        return F.when(_on(mask, start) & _on(mask, stop) & (F.bit_count(inner) == 1), mask.bitwiseXOR(inner)).otherwise(mask)
    return F.aggregate(F.array_sort(edges), everywhere, step)


def _viterbi_fold(edges: Column, unit: Column) -> Column:
    """Unigram: the best way to every end position; of equal scores the longer last piece. Then back along the best edges."""
    kind = "array<struct<score:double,start:int>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"))).cast(kind)

    def step(best: Column, e: Column) -> Column:
        new = F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"))
        return F.when(F.size(best) == e["stop"], F.concat(best, F.array(new)).cast(kind)).when(new["score"] > F.get(best, e["stop"])["score"], F.concat(F.slice(best, 1, F.size(best) - 1), F.array(new)).cast(kind)).otherwise(best)
    best = F.aggregate(F.array_sort(edges), first, step)
    one = F.lit(1).cast("long")
    begin = F.struct(F.char_length(unit).alias("at"), F.lit(0).cast("long").alias("mask"))

    def back(ways: Column) -> Column:
        def follow(s: Column, _: Column) -> Column:
            return F.when(s["at"] < 0, s).otherwise(F.struct(F.get(ways, s["at"])["start"].alias("at"), s["mask"].bitwiseOR(F.call_function("shiftleft", one, s["at"])).alias("mask")))
        return F.aggregate(F.sequence(F.lit(0), F.char_length(unit)), begin, follow)["mask"]
    return F.get(F.transform(F.array(best), back), F.lit(0))


@lru_cache(1 << 16)
def _between_bits(mask: int) -> list[slice]:
    ends = [k for k in range(1, mask.bit_length()) if mask >> k & 1]
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


class _Reader:
    """What a task knows of a model: ids of units, from their masks or, for long ones, by merging here."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cut, self.lead = pieces, re.compile(pieces.cuts()).split, SPACE if pieces.prefix else ""
        self.names = {p: np.uint32(i).tobytes() for p, i, _ in pieces.pieces}
        self.scores = {p: s for p, _, s in pieces.pieces}
        self.by_words = self.lead == SPACE and self.cut(f"a{SPACE}a") == ["a", f"{SPACE}a"]      # texts can be cut at single spaces first
        self.may_cut = re.compile(f"[\x00-\x40\\[-`{{-\x7f{SPACE}]").search                         # no cut is beside letters alone

    def _joined(self, symbols: list[str]) -> bytes:
        names, spelled = self.names, self.pieces.byte_ids
        try:
            return b"".join([names[s] for s in symbols])
        except KeyError:
            return b"".join([names[s] if s in names else np.array([spelled[b] for b in s.encode("utf-8", "surrogatepass")], "<u4").tobytes() for s in symbols])

    def ids(self, unit: str, mask: int | None) -> bytes:
        """little-endian uint32 of a unit whose mask has come back; null: every character is a symbol."""
        return self._joined(list(unit) if mask is None else [unit[s] for s in _between_bits(mask)])

    def long_ids(self, unit: str) -> bytes:
        return self._joined(_merged(unit, self.scores)[0] if self.pieces.kind == "bpe" else _viterbi(unit, self.scores, self.pieces.longest, _unknown(self.pieces)))

    def even(self, text: str) -> bool:
        """Words between single spaces, each a space and letters or signs: such a text is cut word by word."""
        return self.by_words and text[:1] not in ("", " ") and "  " not in text and SPACE not in text

    def units(self, text: str) -> list[str]:
        return self.cut(self.lead + text.replace(" ", SPACE)) if text else []

    def by_first(self, ids: dict[str, bytes]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """``ids`` of units by word, for units that are a space and a word as it stands in even texts, and of all others by unit."""
        whole = {u[1:]: i for u, i in ids.items() if self.by_words and u[:1] == SPACE}
        return whole, {u: i for u, i in ids.items() if not (self.by_words and u[:1] == SPACE)}

    def units_of_word(self, word: str) -> list[str]:
        return self.cut(SPACE + word) if self.may_cut(word) else [SPACE + word]


def _tasks(docs: DataFrame) -> int:
    """Partitions of a shuffle whose rows cost far more than their bytes tell, so they are not to be coalesced."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _common(docs: DataFrame, pieces: Pieces, total: int) -> dict[str, bytes]:
    """The most frequent units of a hash sample of about SAMPLE_BYTES, encoded. Which they are changes what travels, never the result."""
    share = max(1, total // SAMPLE_BYTES)
    counted = (docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select(F.explode(units(F.col("text"), pieces)).alias("unit"))
               .groupBy("unit").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.char_length("unit") <= SHORT)).orderBy(F.desc("n"), "unit").limit(COMMON_UNITS))
    chosen = counted.select("unit").repartition(_tasks(docs), "unit")
    found = chosen.join(encoded_units(chosen, pieces).hint("shuffle_hash"), "unit", "left").toArrow()           # COMMON_UNITS short rows at most
    reader = _Reader(pieces)
    return {u: reader.ids(u, m) for u, m in zip(found["unit"].to_pylist(), found["mask"].to_pylist())}


def encode(docs: DataFrame, pieces: Pieces, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: array of ints, empty for null and empty texts. Repeated rows give repeated rows; other
    columns are ignored; doc_id may be of any type.

    The COMMON_UNITS most frequent units reach all tasks by a broadcast, which that number bounds. Of all others a block asks for
    its distinct ones: the unit goes alone through the lattice, and what comes back to (block, place) is one long, where the symbols end.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    frequent = _common(docs, pieces, total)
    shared = docs.sparkSession.sparkContext.broadcast(_Reader(pieces).by_first(frequent))
    sample = " ".join(frequent)[-ZSTD_BYTES:].replace(SPACE, "").encode("utf-8", "surrogatepass")
    kind = docs.schema["doc_id"].dataType.simpleString()
    readers: list[_Reader] = []                                     # one in a task, for all its blocks

    def own_reader() -> _Reader:
        if not readers:
            readers.append(_Reader(pieces))
        return readers[0]

    def known() -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(sample) > 8 else None

    def pack(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6, dict_data=known())
        for batch in texts:
            packed = [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["block"], pa.array(packed, pa.binary())], names=["doc_id", "block", "data"])

    def texts_of(data: pa.ChunkedArray) -> Iterator[str]:
        release = zstandard.ZstdDecompressor(dict_data=known())
        for d in data:
            yield release.decompress(d.as_py()).decode("utf-8", "surrogatepass") if d.is_valid else ""

    def cut_up(data: pa.ChunkedArray, reader: _Reader) -> tuple[dict[str, bytes], dict[str, list[str]], dict[str, bytes], list[str], list[str]]:
        """Of a block: ids of its common words, units of all other distinct words of even texts, ids of the common ones among these and the
        units of other texts, and those that are not common: the ones that are asked for, in order, and the long ones."""
        by_word, by_unit = shared.value
        words: set[str] = set()
        found: set[str] = set()
        for text in texts_of(data):
            if reader.even(text):
                words.update(text.split(" "))
            else:
                found.update(reader.units(text))
        other = words.difference(by_word)
        parts = {w: reader.units_of_word(w) for w in other}
        known, rare = {}, []
        for u in found.union(*parts.values()):
            ids = by_word.get(u[1:]) if by_word and u[:1] == SPACE else by_unit.get(u)
            if ids is None:
                rare.append(u)
            else:
                known[u] = ids
        return {w: by_word[w] for w in words.difference(other)}, parts, known, sorted(u for u in rare if len(u) <= SHORT), [u for u in rare if len(u) > SHORT]

    def listed(block: pa.Table) -> pa.Table:
        names = cut_up(block["data"], own_reader())[3]
        slots = np.arange(len(names), dtype=np.int64) + (block["block"][0].as_py() << 32)
        return pa.Table.from_arrays([pa.array(names, pa.string()), pa.array(slots)], names=["unit", "slot"])

    def look_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        reader = own_reader()
        of_words, parts, own, names, long_units = cut_up(texts["data"], reader)
        own.update((u, reader.long_ids(u)) for u in long_units)
        for place, mask in zip(found["place"].to_pylist(), found["mask"].to_pylist()):
            own[names[place]] = reader.ids(names[place], mask)
        of_words.update((w, own[us[0]] if len(us) == 1 else b"".join([own[u] for u in us])) for w, us in parts.items())
        of_word, of_unit = of_words.__getitem__, own.__getitem__
        ids = [b"".join(map(of_word, t.split(" ")) if reader.even(t) else map(of_unit, reader.units(t))) for t in texts_of(texts["data"])]
        ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
        return pa.Table.from_arrays([texts["doc_id"], pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    blocked = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "text")
    packed = blocked.mapInArrow(pack, f"doc_id {kind}, block long, data binary")
    asked = packed.groupBy("block").applyInArrow(listed, "unit string, slot long").where("unit is not null").repartition(_tasks(docs), "unit")
    distinct = asked.groupBy("unit").agg(F.min("slot").alias("slot")).where("slot >= 0")           # both columns, so that the exchange of `asked` is used twice
    encoded = encoded_units(distinct.select("unit"), pieces)
    back = asked.join(encoded.hint("shuffle_hash"), "unit", "left").select(F.shiftright("slot", 32).alias("b"), F.col("slot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place"), "mask")
    return packed.groupBy("block").cogroup(back.groupBy("b")).applyInArrow(look_up, f"doc_id {kind}, ids array<int>")


def _spelled(ids: Column, spelling: list[bytes]) -> Column:
    """The bytes of all ids after one another; the spellings are one constant array."""
    table = F.split(F.lit(",".join(b.hex() for b in spelling)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with the columns text, made of ``ids``, and ids_crc32, over the ids as little-endian uint32.

    Null ids give nulls; bytes that are no UTF-8 give U+FFFD; control ids give nothing. No Python: the tasks that encode have
    their Python workers already.
    """
    spelled = {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces.pieces} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
    places = range(max([*spelled, *pieces.control]) + 1)
    text = F.make_valid_utf8(_spelled(F.col("ids"), [spelled.get(i, b"") for i in places]).cast("string"))
    return (encoded.withColumn("text", F.substring(text, F.lit(2), F.length(text)) if pieces.prefix else text)
            .withColumn("ids_crc32", F.crc32(_spelled(F.col("ids"), [i.to_bytes(4, "little") for i in places]))))


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, ``more``, n_tokens, ids_crc32, text_sha256) of encoded and decoded documents."""
    return decoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.of_model(public_tokenizers.path("piece_bpe_32k.model"))
    return digests(decode(encode(load(spark, sf_dir, "documents"), pieces), pieces))
