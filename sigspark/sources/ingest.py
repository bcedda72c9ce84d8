"""Landing files as tables: WAV and raw I/Q into sample blocks, archive listings, text rows, hashes.

Small files come through Spark's ``binaryFile`` source. Files of any size are given as a table of paths; tasks read the byte
ranges they need on any file system that pyarrow opens.
"""
from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BLOCK_SAMPLES
from .files import PIECE, Opened, n_tasks, open_input
from .publication import Publication

WAV_HEAD = 4096
HELD_BYTES, HELD_ROWS = 4 << 20, 1000               # of archive members, until a task hands them over
WAV_COLUMNS = "valid boolean, format string, channels int, sample_rate_hz double, bits int, data_bytes long, data_start int, duration_s double"
# WAVE format tags
WAV_FORMATS = {1: "pcm", 3: "float", 65534: "extensible"}


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


# ------------------------------------------------------------------ WAV
def walk_wav(read_at, size: int) -> dict:
    """Header facts of a WAVE file of ``size`` bytes; anything else is ``valid: False``.

    ``read_at(nbytes, offset)`` is asked for chunk heads only, so chunks before the samples are stepped over, not read. RF64
    files carry the length of their samples in ``ds64``. Samples that a cut-off file lacks still count in ``data_bytes``.
    """
    bad, head = {"valid": False}, read_at(12, 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return bad
    at, fmt, long_size = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read_at(8, at))
        if name == b"ds64" and len(body := read_at(16, at + 8)) == 16:
            long_size = struct.unpack_from("<Q", body, 8)[0]
        elif name == b"fmt " and len(body := read_at(min(length, 40), at + 8)) >= 16:
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body, 0)
            if tag == 65534 and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]              # the real tag opens the sub-format id
            fmt = (WAV_FORMATS.get(tag, str(tag)), channels, rate, bits)
        elif name == b"data":
            if fmt is None or not fmt[1] or not fmt[2] or fmt[3] < 8:
                return bad
            kind, channels, rate, bits = fmt
            length = long_size if length == 0xFFFFFFFF and long_size is not None else length
            return {"valid": True, "format": kind, "channels": channels, "sample_rate_hz": float(rate), "bits": bits,
                    "data_bytes": length, "data_start": at + 8, "duration_s": length / (channels * bits // 8) / rate}
        at += 8 + length + (length & 1)
    return bad


def parse_wav_head(head: bytes) -> dict:
    """The same from the first bytes of a file."""
    return walk_wav(lambda n, at: head[at:at + n], len(head))


def _wav_rows(paths, facts: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in WAV_COLUMNS.split(", ")]
    return pd.DataFrame({"path": paths, **{n: pd.Series([r.get(n) for r in facts], dtype=object) for n in names}})


def wav_catalog(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, header columns). Only the first 4 KiB cross into Python: use
    :func:`wav_file_catalog` where other chunks may stand before the samples."""
    heads = files.select("path", F.substring("content", 1, WAV_HEAD).alias("head"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _wav_rows(b["path"], [parse_wav_head(bytes(h)) for h in b["head"]])

    return heads.mapInPandas(read, f"path string, {WAV_COLUMNS}")


def wav_file_catalog(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """paths (path) of files -> (path, size_bytes, header columns) by positioned reads of chunk heads."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, facts = [], []
            for path in b["path"]:
                with open_input(path) as fh:
                    sizes.append(fh.size())
                    facts.append(walk_wav(fh.read_at, fh.size()))
            yield _wav_rows(b["path"], facts).assign(size_bytes=sizes)[["path", "size_bytes", *[c.split()[0] for c in WAV_COLUMNS.split(", ")]]]

    return paths.select("path").repartition(n_tasks(paths, tasks), "path").mapInPandas(read, f"path string, size_bytes long, {WAV_COLUMNS}")


def wav_file_plan(catalog: DataFrame, block: int = BLOCK_SAMPLES, tasks: int | None = None) -> DataFrame:
    """Catalog rows with a capture_id -> one row per block: (capture_id, path, block_index, offset, bytes, format, channels, bits).

    Frames are those the file really has, so a cut-off file ends early. Blocks are spread over tasks, neighbours together.
    """
    frame = F.floor(F.col("channels") * F.col("bits") / 8)
    held = F.least("data_bytes", F.col("size_bytes") - F.col("data_start"))
    whole = catalog.where("valid").withColumns({"_frame": frame, "_n": F.floor(held / frame)}).where("_n > 0")
    blocks = whole.withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))))
    first = F.col("block_index") * block
    plan = blocks.select("capture_id", "path", "block_index", (F.col("data_start") + first * F.col("_frame")).alias("offset"),
                         (F.least(F.lit(block), F.col("_n") - first) * F.col("_frame")).alias("bytes"), "format", "channels", "bits")
    return plan.repartition(n_tasks(plan, tasks), "path", F.floor(F.col("block_index") / 16)).sortWithinPartitions("path", "block_index")


def wav_file_blocks(plan: DataFrame, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Plan rows -> signal blocks; one positioned read of at most ``block`` frames a row, one channel per result row."""
    def read(batches):
        opened = Opened()
        for b in map(pa.RecordBatch.to_pandas, batches):
            for r in b.itertuples(index=False):
                x = decode_samples(opened(r.path).read_at(int(r.bytes), int(r.offset)), r.format, int(r.bits), int(r.channels))
                yield _frame([row for c, ch in enumerate(x) for row in _block_rows(r.capture_id, str(c + 1), ch, None, block, int(r.block_index) * block)])
        opened.close()

    return plan.select("capture_id", "path", "block_index", "offset", "bytes", "format", "channels", "bits").mapInArrow(read, _BLOCKS)


def decode_samples(raw: bytes, kind: str, bits: int, channels: int) -> np.ndarray:
    """(channels, n) float32; integers are scaled to [-1, 1)."""
    frame = channels * bits // 8
    raw = raw[: len(raw) // frame * frame]
    if kind == "float":
        x = np.frombuffer(raw, {32: "<f4", 64: "<f8"}[bits]).astype(np.float32)
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4").ravel() / 2.0 ** 31).astype(np.float32)     # value * 256 keeps the sign
    elif bits in (16, 32):
        x = (np.frombuffer(raw, {16: "<i2", 32: "<i4"}[bits]) / 2.0 ** (bits - 1)).astype(np.float32)
    else:
        raise ValueError(f"unsupported {bits}-bit {kind}")
    return x.reshape(-1, channels).T


_BLOCKS = "capture_id string, channel string, block_index long, start long, n int, i array<float>, q array<float>"


def _block_rows(capture: str, channel: str, i: np.ndarray, q: np.ndarray | None, size: int, base: int = 0) -> Iterator[dict]:
    for at in range(0, len(i), size):
        part = slice(at, at + size)
        yield {"capture_id": capture, "channel": channel, "block_index": (base + at) // size, "start": base + at,
               "n": len(i[part]), "i": i[part], "q": None if q is None else q[part]}


def _frame(rows: list[dict]) -> pa.RecordBatch:
    """Block rows as an Arrow batch: samples go in as they lie in memory, never one by one."""
    def lists(name: str) -> pa.ListArray:
        held = [r[name] for r in rows]
        ends = np.cumsum([0, *[0 if x is None else len(x) for x in held]], dtype=np.int32)
        values = np.concatenate([np.empty(0, np.float32), *[x for x in held if x is not None]], dtype=np.float32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([x is None for x in held], pa.bool_()))

    kinds = {"capture_id": pa.string(), "channel": pa.string(), "block_index": pa.int64(), "start": pa.int64(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays([*[pa.array([r[c] for r in rows], t) for c, t in kinds.items()], lists("i"), lists("q")], [*kinds, "i", "q"])


def wav_blocks(files: DataFrame, block: int = BLOCK_SAMPLES) -> DataFrame:
    """files (capture_id, content) of valid WAVs -> signal blocks, one channel per row, q NULL."""
    def read(batches):
        for b in map(pa.RecordBatch.to_pandas, batches):
            for capture, content in zip(b["capture_id"], b["content"]):
                content = bytes(content)
                h = parse_wav_head(content[:WAV_HEAD])
                if not h["valid"]:
                    continue
                raw = content[h["data_start"]: h["data_start"] + h["data_bytes"]]
                x = decode_samples(raw, h["format"], h["bits"], h["channels"])
                yield _frame([r for c, row in enumerate(x) for r in _block_rows(capture, str(c + 1), row, None, block)])

    return files.select("capture_id", "content").mapInArrow(read, _BLOCKS)


def iq_blocks(files: DataFrame, kind: str = "float32", scale: float = 1.0, block: int = BLOCK_SAMPLES) -> DataFrame:
    """files (capture_id, content) of interleaved I/Q (float32 or int16) -> signal blocks."""
    dtype = {"float32": "<f4", "int16": "<i2"}[kind]

    def read(batches):
        for b in map(pa.RecordBatch.to_pandas, batches):
            for capture, content in zip(b["capture_id"], b["content"]):
                raw = bytes(content)
                x = np.frombuffer(raw[: len(raw) // (2 * np.dtype(dtype).itemsize) * 2 * np.dtype(dtype).itemsize], dtype)
                pairs = (x.reshape(-1, 2) / scale).astype(np.float32)
                yield _frame(list(_block_rows(capture, "IQ", pairs[:, 0], pairs[:, 1], block)))

    return files.select("capture_id", "content").mapInArrow(read, _BLOCKS)


def iq_file_blocks(plan: DataFrame, block: int = BLOCK_SAMPLES, kind: str = "float32", scale: float = 1.0) -> DataFrame:
    """Raw I/Q files of any size: plan (capture_id, path, block_index) rows of :func:`iq_file_plan`, one positioned read per row."""
    dtype = {"float32": "<f4", "int16": "<i2"}[kind]
    frame = 2 * np.dtype(dtype).itemsize

    def read(batches):
        opened = Opened()
        for b in map(pa.RecordBatch.to_pandas, batches):
            for capture, path, k in zip(b["capture_id"], b["path"], b["block_index"]):
                raw = opened(path).read_at(block * frame, int(k) * block * frame)
                pairs = (np.frombuffer(raw[: len(raw) // frame * frame], dtype).reshape(-1, 2) / scale).astype(np.float32)
                yield _frame(list(_block_rows(capture, "IQ", pairs[:, 0], pairs[:, 1], block, int(k) * block)))
        opened.close()

    return plan.select("capture_id", "path", "block_index").mapInArrow(read, _BLOCKS)


def iq_file_plan(files: DataFrame, block: int = BLOCK_SAMPLES, tasks: int | None = None, kind: str = "float32") -> DataFrame:
    """files (capture_id, path, size_bytes) -> one row per block, spread over tasks so a huge file is read in parallel."""
    frame = {"float32": 8, "int16": 4}[kind]
    last = F.floor((F.floor(F.col("size_bytes") / frame) - 1) / block)
    return (files.where(F.col("size_bytes") >= frame).select("capture_id", "path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block_index"))
            .repartition(n_tasks(files, tasks), "path", F.floor(F.col("block_index") / 16)).sortWithinPartitions("path", "block_index"))


# ------------------------------------------------------------------ archives
_MEMBERS = "archive string, member string, size_bytes long, crc32 string, mtime string, offset long, packed_bytes long, method int"
_MEMBER_NAMES = [c.split()[0] for c in _MEMBERS.split(", ")]


def _directory_place(read_at, size: int) -> tuple[int, int, int]:
    """(start, length, shift) of a zip file's central directory from the end of the file.

    ``shift`` is what stands before the archive, as in self-extracting files: it is added to stored offsets.
    """
    tail_at = max(0, size - 65_557)                              # 22 bytes and the longest comment
    tail = read_at(size - tail_at, tail_at)
    ends = [m.start() for m in re.finditer(rb"PK\x05\x06", tail) if m.start() + 22 <= len(tail)]
    left = {at: len(tail) - at - 22 - struct.unpack_from("<H", tail, at + 20)[0] for at in ends}
    # the signature may stand inside a comment: the record whose comment ends with the file is the one
    at = next((at for at in reversed(ends) if left[at] == 0), next((at for at in reversed(ends) if left[at] > 0), None))
    if at is None:
        raise ValueError("no end of central directory")
    length, start = struct.unpack_from("<II", tail, at + 12)
    end = tail_at + at
    locator = read_at(20, end - 20) if end >= 20 else b""
    if locator[:4] == b"PK\6\7":                                 # Zip64
        place = struct.unpack_from("<Q", locator, 8)[0]
        record = read_at(56, place)
        if record[:4] != b"PK\6\6":                              # the stored place does not know what stands before the archive
            place = end - 20 - 56
            record = read_at(56, place)
        if record[:4] != b"PK\6\6":
            raise ValueError("no Zip64 end of central directory")
        length, start = struct.unpack_from("<QQ", record, 40)
        end = place
    return end - length, length, end - length - start


def _directory(archive: str, read_at, size: int) -> Iterator[dict]:
    """Members of one archive. The directory is read in pieces, never as a whole."""
    at, left, shift = _directory_place(read_at, size)
    piece = b""
    while left or piece:
        if left and (len(piece) < 46 or len(piece) < 46 + sum(struct.unpack_from("<HHH", piece, 28))):
            more = read_at(min(left, 1 << 20), at)
            if not more:
                raise ValueError(f"{archive}: central directory is cut off")
            piece, at, left = piece + more, at + len(more), left - len(more)
            continue
        if piece[:4] != b"PK\1\2" or len(piece) < 46:
            raise ValueError(f"{archive}: damaged central directory")
        flags, method, clock, day, crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<HHHHIIIHHH", piece, 8)
        offset = struct.unpack_from("<I", piece, 42)[0]
        name, extra = piece[46:46 + n_name], piece[46 + n_name:46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:                                         # Zip64: only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n:]
        piece = piece[46 + n_name + n_extra + n_note:]
        if not name.endswith(b"/"):
            stamp = (1980 + (day >> 9), day >> 5 & 15, day & 31, clock >> 11, clock >> 5 & 63, 2 * (clock & 31))
            yield {"archive": archive, "member": name.decode("utf-8" if flags & 0x800 else "cp437"), "size_bytes": full, "crc32": f"{crc:08x}",
                   "mtime": "%04d-%02d-%02dT%02d:%02d:%02d" % stamp, "offset": offset + shift, "packed_bytes": packed, "method": method}


def _in_rows(items: Iterator[dict], n: int = 10_000) -> Iterator[pd.DataFrame]:
    while rows := list(itertools.islice(items, n)):
        yield pd.DataFrame(rows, columns=_MEMBER_NAMES)


def zip_members(archives: DataFrame, junk: str = "__MACOSX") -> DataFrame:
    """archives (path[, content]) -> one row per member with its place in the archive. Without ``content`` the file's tail and
    central directory are read by position, Zip64 included; nothing else of the archive is."""
    inline = "content" in archives.columns

    def read(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                if inline:
                    held = bytes(r.content)
                    yield from _in_rows(_directory(r.path, lambda n, at, held=held: held[at:at + n], len(held)))
                else:
                    with open_input(r.path) as fh:
                        yield from _in_rows(_directory(r.path, fh.read_at, fh.size()))

    listed = archives.select("path", *(["content"] if inline else [])).mapInPandas(read, _MEMBERS)
    return listed.where(~F.col("member").contains(junk))


def _unpacked(read_at, offset: int, packed: int, method: int, piece: int) -> Iterator[bytes]:
    """Content of one member in pieces of at most ``piece`` bytes."""
    head = read_at(30, offset)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header where the directory points")
    at = offset + 30 + sum(struct.unpack_from("<HH", head, 26))
    end = at + packed
    if method not in (0, 8):
        raise ValueError(f"compression method {method} is not supported")
    inflate = zlib.decompressobj(-15) if method == 8 else None
    while at < end:
        raw = read_at(min(piece, end - at), at)
        if not raw:
            raise ValueError("archive is cut off")
        at += len(raw)
        while inflate and raw:
            out = inflate.decompress(raw, piece)
            if out:
                yield out
            raw = inflate.unconsumed_tail
        if inflate is None:
            yield raw
    if inflate:
        while out := inflate.decompress(inflate.unconsumed_tail, piece):
            yield out
        if not inflate.eof:
            raise ValueError("compressed data is cut off")


def zip_pieces(members: DataFrame, piece: int = PIECE, tasks: int | None = None) -> DataFrame:
    """Rows of :func:`zip_members` -> (archive, member, part, content): one member in numbered pieces of at most ``piece`` bytes.

    Members are read by offset, so tasks share an archive and no row holds more than a piece. A task hands pieces over as soon as
    it holds HELD_BYTES of them, small members many at a time. Size and checksum are compared
    with the directory; a difference is an error. An empty member has one empty piece.
    """
    def read(batches):
        opened, names, held, size_held = Opened(), ["archive", "member", "part", "content"], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (pa.string(), pa.string(), pa.int32(), pa.binary()))], names)

        for b in batches:
            for r in b.to_pylist():
                crc, size, part = 0, 0, 0
                pieces = _unpacked(opened(r["archive"]).read_at, r["offset"], r["packed_bytes"], r["method"], piece)
                for part, content in enumerate(pieces if r["size_bytes"] else itertools.chain(pieces, [b""]), 1):
                    crc, size = zlib.crc32(content, crc), size + len(content)
                    held.append((r["archive"], r["member"], part - 1, content))
                    size_held += len(content)
                    if size_held >= HELD_BYTES or len(held) >= HELD_ROWS:
                        yield batch()
                        held, size_held = [], 0
                if size != r["size_bytes"] or f"{crc:08x}" != r["crc32"]:
                    raise ValueError(f"{r['archive']}: {r['member']} does not match its directory entry")
        if held:
            yield batch()
        opened.close()

    spread = members.select(*_MEMBER_NAMES).repartition(n_tasks(members, tasks), "archive", "member").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(read, "archive string, member string, part int, content binary")


def zip_contents(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """members (archive, member), or whole rows of :func:`zip_members` -> (archive, member, content). For members that fit a row;
    longer ones are read with :func:`zip_pieces`."""
    if "offset" not in members.columns:
        listed = zip_members(members.select(F.col("archive").alias("path")).distinct(), junk="\0")
        members = listed.join(members.select("archive", "member").distinct(), ["archive", "member"], "left_semi")
    return zip_pieces(members, (1 << 31) - 1, tasks).drop("part")


# ------------------------------------------------------------------ text rows
def text_samples(lines: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """Comma-separated numbers -> int16-safe codes and whether the conversion is lossless.

    (key, codes array<int>, n, lo, hi, lossless): every value must be a whole number within the int16 range.
    """
    numbers = F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda t: t.try_cast("double"))
    out = lines.select(*key, numbers.alias("_x"))
    ok = F.forall("_x", lambda v: v.isNotNull() & (v == F.round(v)) & v.between(-32768, 32767))
    return out.select(*key, F.transform("_x", lambda v: v.try_cast("int")).alias("codes"), F.size("_x").alias("n"),
                      F.array_min("_x").alias("lo"), F.array_max("_x").alias("hi"), ok.alias("lossless"))


# ------------------------------------------------------------------ hashes
def hash_inventory(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime, sha256, crc32) of ``binaryFile`` rows. Spark's file sources leave out empty files and cannot
    hold files above 2 GB; use :func:`hash_paths` where either occurs, or where unchanged files must not be read at all. Files whose (path, size, mtime) stand in the manifest are not hashed again;
    manifest rows of files that changed or went away are left out."""
    current = files.select("path", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"))
    if manifest is None:
        todo, kept = files, None
    else:
        same = ["path", "size", "mtime"]
        kept = manifest.join(current, same, "left_semi").select("path", "size", "mtime", "sha256", "crc32")
        # a scan that holds content reads it for all rows, whatever the join drops: this form saves hashing, not reading
        todo = (files.withColumn("size", F.col("length")).withColumn("mtime", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss"))
                .join(manifest.select(*same), same, "left_anti"))
    fresh = todo.select("path", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"),
                        F.sha2("content", 256).alias("sha256"), F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0").alias("crc32"))
    return fresh if kept is None else kept.unionByName(fresh)


def hash_paths(listing: DataFrame, manifest: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The same inventory from a listing (path, size, mtime) of files on any file system pyarrow opens, in pieces of 16 MB.

    The listing is compared with the manifest first, so only new and changed files are opened.
    """
    import hashlib

    same = ["path", "size", "mtime"]
    todo = listing.select(*same) if manifest is None else listing.select(*same).join(manifest.select(*same), same, "left_anti")

    def read(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                sha, crc = hashlib.sha256(), 0
                with open_input(r.path) as fh:
                    while piece := fh.read(PIECE):
                        sha.update(piece)
                        crc = zlib.crc32(piece, crc)
                rows.append((r.path, r.size, r.mtime, sha.hexdigest(), f"{crc:08x}"))
            yield pd.DataFrame(rows, columns=[*same, "sha256", "crc32"])

    fresh = todo.repartition(n_tasks(todo, tasks), "path").mapInPandas(read, "path string, size long, mtime string, sha256 string, crc32 string")
    if manifest is None:
        return fresh
    return fresh.unionByName(manifest.join(listing.select(*same), same, "left_semi").select(*same, "sha256", "crc32"))


INVENTORY = "path string, size long, mtime string, sha256 string, crc32 string, read_in long, gone_in long"


def update_inventory(box: Publication, name: str, listing: DataFrame, tasks: int | None = None) -> dict:
    """Bring the published inventory in line with a listing (path, size, mtime) of files; returns its manifest entry.

    A path is opened only where (path, size, mtime) is not in the version before; ``read_in`` is the version that read it. A path
    that is no longer listed keeps its last row, with ``gone_in`` as a tombstone, until it is listed again. Nothing changed: no new
    version. Paths must be listed once.
    """
    spark, known = listing.sparkSession, box.entry(name)
    version = known["version"] + 1 if known else 1
    before = box.read(name, "files", verify=False) if known else spark.createDataFrame([], INVENTORY)
    same, present = ["path", "size", "mtime"], before.where("gone_in IS NULL")
    kept = present.join(listing.select(*same), same, "left_semi")
    fresh = hash_paths(listing.select(*same).join(present.select(*same), same, "left_anti"), tasks=tasks)
    fresh = fresh.withColumns({"read_in": F.lit(version).cast("long"), "gone_in": F.lit(None).cast("long")})
    gone = before.join(listing.select("path"), "path", "left_anti").withColumn("gone_in", F.coalesce("gone_in", F.lit(version)))
    rows = kept.select(*before.columns).unionByName(fresh).unionByName(gone.select(*before.columns))
    return box.publish(name, {"files": rows}, replace=True)
