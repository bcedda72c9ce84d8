"""Token files: independent zstandard frames with a seek table (operator 7).

A file holds frames of whole documents in ascending doc_id order. A frame, once decompressed, is: number of documents
(uint32), then for every document a flag (uint8, 1: the id is null), doc_id (int64) and number of tokens (uint32), then all
tokens (uint32); everything little-endian. After the frames come two skippable frames: the document index (first flag and
doc_id of every frame) and, last, the seek table of the public seekable format: compressed size, decompressed size and
checksum (low half of XXH64 of the content) of every frame. A reader needs the tail of the file and the frames it asks for.
"""
from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import load, settle

END_ID = 2
FRAME_TOKENS = 1 << 17                              # a frame is closed once it holds as many; a document is never divided
LEVEL = 3
CACHE = 400_000                                     # pieces of text whose ids a worker remembers

# Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80

_DOC = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("tokens", "<u4")])
_FIRST = np.dtype([("null", "u1"), ("doc_id", "<i8")])
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


# Fixed values of the vocabulary: its own split, for Latin text, and how it writes bytes.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9À-ÖØ-öø-ɏ]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
_LATIN = re.compile("[\x00-\x7fÀ-ɏ]*").fullmatch
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([\x00-\x7fÀ-ɏ]*)").fullmatch
_OTHER_SPACE = re.compile(r"[^\S \n]").search
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
_SPACE_SIGN = _BYTE_SIGNS[32]


class _Memory(dict):
    """Ids of pieces; a piece that is missing is looked for in the generation before, or made."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.older.get(piece) or self.make(piece)
        return ids


class Encoder:
    """The tokenizers library behind a memory of pieces.

    A space between two characters that are not white space starts a new pre-token whatever stands around it, so a text may be
    cut there and its pieces encoded apart. A piece of Latin text that is not in memory is split as the vocabulary's file says
    and each pre-token goes to the library's model; any other piece goes through the library whole. Two generations of
    CACHE pieces are remembered. With ``added``, as the library's default is, a text that holds the content of an added token
    goes through the library whole; without, such content is ordinary text.
    """
    _cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self._added = re.compile("|".join(map(re.escape, contents))).search if contents else None
        self.model = self.tokenizer.model
        self.known = _Memory(self._word, {})
        self._short = lru_cache(1 << 16)(self._pre_token)
        self._rest = lru_cache(1 << 12)(self._new)

    def _pre_token(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(_BYTE_SIGNS))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, text: str) -> bytes:
        if not _LATIN(text):
            return self._whole(text)
        return b"".join([self._short(t) if len(t) < 6 else self._pre_token(t) for t in _SPLIT.findall(text)])

    def _word(self, piece: str) -> bytes:
        """Ids of a space and ``piece``. Of Latin text the letters it begins with are one pre-token, whatever follows; often it is a sign or two."""
        found = _WORD(piece)
        if found is None:
            return self._new(" " + piece)
        word, rest = found.groups()
        if rest:
            return (self.known.get(word) or self.known.older.get(word) or self._letters(word)) + (self._rest(rest) if len(rest) < 4 else self._new(rest))
        return self._letters(word)

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            return self._pre_token(" " + word)
        return array("I", [t.id for t in self.model.tokenize(_SPACE_SIGN + word)]).tobytes()

    def _pieces(self, text: str) -> list[str]:
        even = not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ") and not (any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() else _OTHER_SPACE(text))
        return text.split(" ") if even else self._cut.split(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32; null counts as empty."""
        if len(self.known) > CACHE:
            self.known.older = {}
            self.known = _Memory(self._word, self.known)
        return [self._text(t or "") for t in texts]

    def _text(self, text: str) -> bytes:
        if self._added and self._added(text):
            return self._whole(text)
        head, *pieces = self._pieces(text)
        return self._new(head) + b"".join(map(self.known.__getitem__, pieces))


@lru_cache(2)
def _encoder(path: str, added: bool = False) -> Encoder:
    """One encoder per worker, whatever tasks it runs."""
    return Encoder(path, added)


def _in_parts(texts: pd.Series, limit: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``limit`` characters, with the place of the first."""
    start, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield start, part
            start, part, size = k + 1, [], 0
    if part:
        yield start, part


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class FileWriter:
    """Writes under a name of its own and renames at the end, so a repeated or lost task leaves one whole file."""

    def __init__(self, path: str, frame_tokens: int):
        self.fs, self.path = _filesystem(path)
        self.hidden, self.limit = f"{self.path}.{uuid.uuid4().hex}.part", frame_tokens
        self.out = self.fs.open_output_stream(self.hidden)
        self.entries, self.firsts, self.docs, self.ids, self.held = [], [], [], [], 0
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids) // 4))
        self.ids.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.limit:
            self._frame()

    def _frame(self) -> None:
        docs = np.array(self.docs, _DOC)
        plain = b"".join([struct.pack("<I", len(docs)), docs.tobytes(), *self.ids])
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.firsts.append((docs["null"][0], docs["doc_id"][0]))
        self.n_docs += len(docs)
        self.n_tokens += self.held
        self.docs, self.ids, self.held = [], [], 0

    def close(self) -> tuple[int, int]:
        if self.docs:
            self._frame()
        index = np.array(self.firsts, _FIRST).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return self.n_docs, self.n_tokens


class FileReader:
    """Reads the tail once, then single frames."""

    def __init__(self, path: str):
        fs, inner = _filesystem(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, at), _ENTRY)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        self.firsts = np.frombuffer(self.file.read_at(n * _FIRST.itemsize, int(self.offsets[-1]) + 8), _FIRST)

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of one frame; a wrong checksum is an error."""
        plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.entries["packed"][k]), int(self.offsets[k])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["checksum"][k]:
            raise ValueError(f"frame {k} does not have the checksum of its entry")
        n = struct.unpack_from("<I", plain)[0]
        docs = np.frombuffer(plain, _DOC, n, 4)
        ids, at = np.frombuffer(plain, "<u4", offset=4 + n * _DOC.itemsize), 0
        for null, doc_id, tokens in docs.tolist():
            yield None if null else doc_id, ids[at:at + tokens]
            at += tokens

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this id; only frames that can hold it are decompressed."""
        key = (0, 0) if doc_id is None else (1, doc_id)
        firsts = [(0, 0) if null else (1, d) for null, d in self.firsts.tolist()]
        return [ids for k in range(len(firsts)) if firsts[k] <= key and (k + 1 == len(firsts) or firsts[k + 1] >= key) for d, ids in self.frame(k) if d == doc_id]

    def close(self) -> None:
        self.file.close()


MANIFEST = "file string, part long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, frame_tokens: int = FRAME_TOKENS, added: bool = False) -> DataFrame:
    """Writes ``docs`` to ``folder`` and returns the manifest (file, part, n_docs, n_tokens), parts in ascending doc_id order.

    Null ids come first; equal ids are ordered by a hash of their text, so they may be divided too. Null and empty texts have
    the end id only. With ``added`` the contents of the tokenizer's added tokens get their ids, as the library gives them by
    default; without, they are ordinary text. An empty table writes no file. Further columns are ignored. Paths may be of any file system that
    pyarrow opens, and must be reachable from every executor.
    """
    fs, inner = _filesystem(folder)
    fs.create_dir(inner, recursive=True)
    end = struct.pack("<I", END_ID)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for batch in batches:
            if writer is None and len(batch):
                part = int(batch["part"].iloc[0])
                writer = FileWriter(f"{folder}/part-{part:08d}.tok", frame_tokens)
            nulls, doc_ids = batch["null"].tolist(), batch["doc_id"].tolist()
            for start, texts in _in_parts(batch["text"]):
                found = _encoder(tokenizer, added).encode([None if not isinstance(t, str) else t for t in texts])
                for null, doc_id, ids in zip(nulls[start:], doc_ids[start:], found):
                    writer.add(None if null else doc_id, ids + end)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pd.DataFrame([(f"{folder}/part-{part:08d}.tok", part, n_docs, n_tokens)], columns=["file", "part", "n_docs", "n_tokens"])

    ordered = (docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", F.col("doc_id").isNull().alias("null"), F.xxhash64("text").alias("tie"))
               .select((~F.col("null")).alias("known"), "doc_id", "tie", "text", "null")
               .repartitionByRange("known", "doc_id", "tie").sortWithinPartitions("known", "doc_id", "tie").withColumn("part", F.spark_partition_id().cast("long")))
    return settle(ordered.select("doc_id", "text", "null", "part").mapInPandas(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) per document of the files: start counts the ids of all documents before it, over all files; ids
    are binary, little-endian uint32."""
    # one row per file: the running total over files is small whatever the documents are
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, at in zip(batch["file"], batch["before"]):
                reader, at = FileReader(file), int(at)
                for k in range(len(reader.entries)):
                    found = list(reader.frame(k))
                    starts = at + np.concatenate(([0], np.cumsum([len(i) for _, i in found])))
                    yield pd.DataFrame({"doc_id": pd.array([d for d, _ in found], "Int64"), "start": starts[:-1], "ids": [i.tobytes() for _, i in found]})
                    at = int(starts[-1])
                reader.close()
    files = max(1, manifest.count())                          # few files or many, each is a task of its own
    return placed.repartition(files, "part").mapInPandas(read, "doc_id long, start long, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(load(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), added=True)

    return read_token_files(manifest).select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
