"""WARC archives by a deterministic sharded writer (operator 12).

Payload digests are made first, and of each group of equal payloads one record is chosen by a join of narrow rows. The pages,
their payloads compressed for the way, meet that choice and are sorted into ranges of (page id, digest, copy). One task writes a
range: it regenerates every header and digest from the payload itself, rolls to the next file once the compressed size of the
current one reaches the limit, writes under a temporary name and renames at the end. Only files that the manifest lists count,
each with its size and digest, so a task that is lost or runs twice leaves either the same bytes under the same name or a file
nobody reads. Everything in a file follows from the rows: record ids are hashes, the date is a parameter.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import lookup_join
from ..session import scratch_path
from .common import load, settle

FILE_BYTES = 64 << 20                               # compressed size at which a file ends
SHARD_BYTES = 32 << 20                              # of payload, as packed for the way, which one task writes
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20

# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OWN = "X-Page-"                                     # prefix of this library's extension fields


def _digest(data: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {copy}')}>"


def _fields(pairs: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode("utf-8", "surrogatepass")


def _clean(value: str | None) -> str | None:
    """A header value on one line; control characters become %XX."""
    return None if value is None else "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: tuple[int | None, int] | None, date: str = DATE) -> bytes:
    """One record, compressed as a gzip member of its own. ``refers_to`` is (page id, copy) of the response that a revisit stands for."""
    digest = _digest(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http + (b"" if refers_to else payload)
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", _record_id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)), ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", PROFILE if refers_to else None), ("WARC-Refers-To", _record_id(refers_to[0], digest, refers_to[1]) if refers_to else None),
            (OWN + "ID", "" if page_id is None else page_id), (OWN + "Refers-To", refers_to and ("" if refers_to[0] is None else refers_to[0])), (OWN + "Payload-Length", len(payload))]
    return gzip.compress(VERSION.encode() + b"\r\n" + _fields(head) + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _info(name: str) -> bytes:
    text = _fields([("software", "sigspark"), ("format", "WARC File Format 1.1")])
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(text)),
            ("WARC-Block-Digest", f"sha1:{_digest(text)}")]
    return gzip.compress(VERSION.encode() + b"\r\n" + _fields(head) + b"\r\n" + text + b"\r\n\r\n", 6, mtime=0)


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class ShardWriter:
    """Files of one range: ``{folder}/part-{shard}-{number}.warc.gz``. ``done`` has (file, shard, number, records, bytes, sha1)."""
    folder: str
    shard: int
    limit: int
    done: list[tuple] = field(default_factory=list)
    _out: object = None

    def add(self, packed: bytes) -> None:
        if self._out is None:
            name = f"part-{self.shard:06d}-{len(self.done):04d}.warc.gz"
            self._fs, inner = _filesystem(f"{self.folder}/{name}")
            self._final, self._hidden = inner, f"{inner}.{uuid.uuid4().hex}.part"
            self._out, self._sum, self._size, self._records, self._name = self._fs.open_output_stream(self._hidden, compression=None), hashlib.sha1(), 0, 0, name
            self._write(_info(name))
        self._write(packed)
        self._records += 1
        if self._size >= self.limit:
            self.close()

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self._sum.update(data)
        self._size += len(data)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._fs.move(self._hidden, self._final)
            self.done.append((f"{self.folder}/{self._name}", self.shard, len(self.done), self._records, self._size, self._sum.hexdigest()))
            self._out = None


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after another; only one is held."""
    unpack, out = zlib.decompressobj(31), []
    data = stream.read(READ_BYTES)
    while data:
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []
        data = data or stream.read(READ_BYTES)
    if out:
        raise ValueError("the last record is cut off")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; a wrong block digest or length is an error."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if version != VERSION or rest[len(block):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


def _decided(digests: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, copy, refers_id, refers_copy) per row of ``digests`` (page_id, digest, size, n): equal rows are numbered
    by copy. Of equal payloads of ``least`` bytes or more, the last by (page_id, copy) is the response; null ids come first."""
    groups = digests.groupBy("digest").agg(F.sum("n").alias("weight"), F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "n")).alias("last"))
    chosen = groups.where("weight > 1").select("digest", "weight", F.col("last.page_id").alias("refers_id"), (F.col("last.n") - 1).alias("refers_copy"))
    found = lookup_join(digests, chosen, ["digest"], "weight", "left")
    return found.withColumn("revisits", F.col("refers_copy").isNotNull() & (F.col("size") >= least))


MANIFEST = "file string, shard int, number int, records long, bytes long, sha1 string"


def write_warc(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to ``folder`` and returns the manifest (file, shard, number, records, bytes, sha1),
    which is also written to ``folder``/manifest.

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of ``least`` bytes or more the one
    with the largest page_id is a response and the others revisit it; shorter ones are all responses. Null ids sort first,
    rows equal in id and payload are copies 0, 1, ... of which the last may be the response, an empty table writes no file, and further columns are
    ignored. A folder that has a manifest is refused. Files may lie in any file system pyarrow opens and all executors reach.
    """
    spark = pages.sparkSession
    fs, inner = _filesystem(folder)
    if fs.get_file_info(f"{inner}/manifest").type != pyarrow.fs.FileType.NotFound:
        raise ValueError(f"{folder} has a manifest already")
    fs.create_dir(inner, recursive=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            payloads = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(map(_digest, payloads), pa.string()), pa.array([len(p) for p in payloads], pa.int64()), pa.array(map(press.compress, payloads), pa.binary())],
                                             names=["page_id", "url", "digest", "size", "data"])
    packed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(pack, "page_id long, url string, digest string, size long, data binary")
    digests = settle(packed.groupBy("page_id", "digest", "size").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("bytes")))
    shards = max(1, -(-int(digests.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    decided = _decided(digests.drop("bytes"), least).select(F.col("page_id").alias("known_id"), F.col("digest").alias("known_digest"), "revisits", "refers_id", "refers_copy")
    rows = packed.join(decided.hint("merge"), F.col("page_id").eqNullSafe(F.col("known_id")) & (F.col("digest") == F.col("known_digest")))
    order = [F.asc_nulls_first("page_id"), "digest", "url"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, last, copy = None, None, 0
        release = zstandard.ZstdDecompressor()
        for batch in batches:
            for shard, page_id, url, digest, data, revisits, to, to_copy in zip(*[c.to_pylist() for c in batch.columns]):
                writer = writer or ShardWriter(folder, shard, file_bytes)
                copy = copy + 1 if last == (page_id, digest) else 0
                last = page_id, digest
                response = not revisits or (to, to_copy) == (page_id, copy)
                writer.add(record(page_id, url, release.decompress(data), copy, None if response else (to, to_copy), date))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done)], schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))
    placed = (rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("shard"), "page_id", "url", "digest", "data", "revisits", "refers_id", "refers_copy"))
    manifest = settle(placed.mapInArrow(write, MANIFEST))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the records in the files of a manifest;
    the payload of a revisit is null. Files, blocks and payloads are held against their digests."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, size, sha1 in zip(batch["file"], batch["bytes"], batch["sha1"]):
                fs, inner = _filesystem(file)
                seen = hashlib.sha1()
                with fs.open_input_stream(inner, compression=None) as stream:
                    while data := stream.read(READ_BYTES):
                        seen.update(data)
                if seen.hexdigest() != sha1 or fs.get_file_info(inner).size != size:
                    raise ValueError(f"{file} is not the file that the manifest lists")
                with fs.open_input_stream(inner, compression=None) as stream:
                    rows, held = [], 0
                    for member in members(stream):
                        fields, block = parsed(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and (_digest(payload) != digest or len(payload) != int(fields[OWN + "Payload-Length"])):
                            raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload of its digest")
                        number = lambda name: int(fields[name]) if fields.get(name) else None
                        rows.append((number(OWN + "ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(OWN + "Payload-Length"), digest, number(OWN + "Refers-To"), payload))
                        held += len(member)
                        if held > 16 * READ_BYTES:
                            yield _frame(rows)
                            rows, held = [], 0
                    yield _frame(rows)
    files = max(1, manifest.count())
    return manifest.repartition(files, "file").mapInPandas(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"], dtype=object)
    return found.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(load(spark, sf_dir, "pages"), scratch_path(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
