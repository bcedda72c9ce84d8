import io
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.sources import files, ingest
from sigspark.sources.publication import Publication


def paths(spark, *found):
    return spark.createDataFrame([(str(p),) for p in found], "path string")


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


FMT = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)


def test_chunks_before_the_samples_are_stepped_over(spark, tmp_path):
    x = np.arange(-500, 500, dtype="<i2")
    chunks = chunk(b"LIST", bytes(9_001)) + chunk(b"fmt ", FMT) + chunk(b"bext", bytes(70_000))
    plain = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + chunks + chunk(b"data", x.tobytes())
    long_form = b"RF64\xff\xff\xff\xffWAVE" + chunk(b"ds64", struct.pack("<QQQI", 0, 2000, 500, 0)) + chunks + b"data\xff\xff\xff\xff" + x.tobytes()
    for name, raw in (("a.wav", plain), ("b.wav", long_form), ("c.wav", plain[:-1000]), ("d.wav", b""), ("e.wav", plain[:30]), ("f.wav", b"no sound at all, but text")):
        (tmp_path / name).write_bytes(raw)
    reads = []

    def read_at(n, at):
        reads.append(n)
        return plain[at:at + n]
    assert ingest.walk_wav(read_at, len(plain))["data_bytes"] == 2000 and sum(reads) < 100
    found = ingest.wav_file_catalog(paths(spark, *sorted(tmp_path.iterdir())), 3).withColumn("capture_id", F.regexp_extract("path", r"(\w)\.wav", 1)).cache()
    assert {r["capture_id"]: (r["valid"], r["data_bytes"]) for r in found.collect()} == {
        "a": (True, 2000), "b": (True, 2000), "c": (True, 2000), "d": (False, None), "e": (False, None), "f": (False, None)}
    plan = ingest.wav_file_plan(found, 64, 3)
    assert plan.agg(F.max("bytes")).first()[0] == 256                   # 64 frames of two 16-bit channels
    got = ingest.wav_file_blocks(plan, 64).groupBy("capture_id", "channel").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("start", "i"))).alias("b")).collect()
    for r in got:
        want = x[int(r["channel"]) - 1::2][: 250 if r["capture_id"] == "c" else 500] / 2.0 ** 15
        assert r["n"] == len(want) and np.array_equal(np.concatenate([b["i"] for b in r["b"]]), want.astype(np.float32))
    assert len(got) == 6


def test_iq_of_two_sample_types(spark, tmp_path):
    x = np.arange(-1000, 1000, dtype="<i2")
    (tmp_path / "x.iq").write_bytes(x.tobytes() + b"\1")               # half a sample at the end is left out
    table = spark.createDataFrame([("c", str(tmp_path / "x.iq"), 4001)], "capture_id string, path string, size_bytes long")
    got = ingest.iq_file_blocks(ingest.iq_file_plan(table, 300, 2, "int16"), 300, "int16", 4.0).orderBy("start").collect()
    assert [r["n"] for r in got] == [300, 300, 300, 100]
    assert np.array_equal(np.concatenate([r["q"] for r in got]), x[1::2] / 4)
    assert ingest.iq_file_plan(table.withColumn("size_bytes", F.lit(3).cast("long")), 300, 2, "int16").count() == 0


def archive(**contents):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, content) in enumerate(contents.items()):
            z.writestr(name, content, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)[k % 2])
        z.mkdir("folder")
        z.comment = b"the end PK\5\6 of it" + bytes(30)                # the signature inside a comment
    return out.getvalue()


def test_archives_are_read_from_their_tail(spark, tmp_path):
    noise = np.random.default_rng(0).bytes(300_000)
    plain = archive(a=b"12345", b=b"x" * 500_000, c=noise, d=noise, e=b"", f=b"", **{"é": b"name"})
    (tmp_path / "plain.zip").write_bytes(plain)
    (tmp_path / "behind.zip").write_bytes(b"#!/bin/sh\n" * 100 + plain)
    with zipfile.ZipFile(tmp_path / "wide.zip", "w") as z, z.open("a", "w", force_zip64=True) as fh:
        fh.write(b"12345")
    many = 66_000                                                       # more members than a plain directory can count
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(many):
            z.writestr(zipfile.ZipInfo(str(k)), b"")
    (tmp_path / "empty.zip").write_bytes(archive())
    members = ingest.zip_members(paths(spark, *sorted(tmp_path.iterdir()))).cache()
    per_file = {os.path.basename(r["archive"]): r["count"] for r in members.groupBy("archive").count().collect()}
    assert per_file == {"plain.zip": 7, "behind.zip": 7, "wide.zip": 1, "many.zip": many}
    few = members.where("archive NOT LIKE '%many%'")
    want = {"a": b"12345", "b": b"x" * 500_000, "c": noise, "d": noise, "e": b"", "f": b"", "é": b"name"}
    got = {(os.path.basename(r["archive"]), r["member"]): bytes(r["content"]) for r in ingest.zip_contents(few, 3).collect()}
    assert got == {(f, m): c for f in ("plain.zip", "behind.zip") for m, c in want.items()} | {("wide.zip", "a"): b"12345"}
    parts = ingest.zip_pieces(few, 1000, 3).groupBy("archive", "member").agg(F.max(F.octet_length("content")).alias("widest"), F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p"))
    for r in parts.collect():
        assert r["widest"] <= 1000 and b"".join(bytes(p["content"]) for p in r["p"]) == want[r["member"]]


def test_only_the_tail_of_an_archive_is_read():
    raw, reads = archive(a=bytes(1_000_000), b=b"1"), []

    def read_at(n, at):
        reads.append((at, n))
        return raw[at:at + n]
    assert [m["member"] for m in ingest._directory("x", read_at, len(raw))] == ["a", "b"]
    assert min(at for at, _ in reads) >= len(raw) - 65_557


def test_damaged_archives_raise(spark, tmp_path):
    raw = bytearray(archive(a=b"12345"))
    raw[raw.index(b"12345")] ^= 1
    (tmp_path / "x.zip").write_bytes(raw)
    with pytest.raises(Exception, match="does not match its directory entry"):
        ingest.zip_contents(ingest.zip_members(paths(spark, tmp_path / "x.zip")), 1).collect()
    for bad in (b"", b"no archive", bytes(archive(a=b"1")[:-70])):
        with pytest.raises(ValueError):
            list(ingest._directory("x", lambda n, at, bad=bad: bad[at:at + n], len(bad)))


def test_listing_finds_every_level_and_empty_files(spark, tmp_path):
    for name in ("a", "b/c", "b/d/e/f"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() if name != "b/c" else b"")
    (tmp_path / "hollow").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["path"]: r["size"] for r in files.list_files(spark, [root], 2).collect()}
        assert got == {f"{root}/a": 1, f"{root}/b/c": 0, f"{root}/b/d/e/f": 7}
    with pytest.raises(Exception, match="nowhere"):
        files.list_files(spark, [str(tmp_path / "nowhere")], 2)


def test_inventory_opens_only_what_changed(spark, tmp_path):
    folder, box = tmp_path / "in", Publication(spark, str(tmp_path / "out"))
    folder.mkdir()
    for name in "abc":
        (folder / name).write_bytes(name.encode())

    def update():
        return ingest.update_inventory(box, "files", files.list_files(spark, [str(folder)], 2), 2)

    def rows():
        return {r["path"][-1]: (r["sha256"][:4], r["read_in"], r["gone_in"]) for r in box.read("files", "files").collect()}
    update()
    assert rows() == {"a": ("ca97", 1, None), "b": ("3e23", 1, None), "c": ("2e7d", 1, None)}
    stat = os.stat(folder / "a")
    (folder / "a").write_bytes(b"?")                                    # same size and time: a reader would see other content
    os.utime(folder / "a", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert update()["version"] == 1 and rows()["a"] == ("ca97", 1, None)
    (folder / "b").write_bytes(b"bb")
    os.rename(folder / "c", tmp_path / "c")
    assert update()["version"] == 2
    assert rows() == {"a": ("ca97", 1, None), "b": ("3b64", 2, None), "c": ("2e7d", 1, 2)}
    (folder / "d").write_bytes(b"")
    assert update()["version"] == 3 and rows()["c"] == ("2e7d", 1, 2) and rows()["d"] == ("e3b0", 3, None)
    os.rename(tmp_path / "c", folder / "c")
    assert update()["version"] == 4 and rows()["c"] == ("2e7d", 4, None)


def test_unchanged_files_are_dropped_before_any_content(spark):
    listing = spark.createDataFrame([("x", 1, "1")], "path string, size long, mtime string")
    known = listing.withColumns({"sha256": F.lit("s"), "crc32": F.lit("c")})
    plan = ingest.hash_paths(listing, known, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and plan.index("MapInPandas") < plan.index("LeftAnti")     # the readers stand above the anti join
    assert ingest.hash_paths(listing, known, 2).first()["sha256"] == "s"                    # there is no file x


def test_samples_that_are_no_numbers_come_as_they_are(spark, tmp_path):
    x = np.array([1, -1, np.nan, 2, np.inf, np.nan], "<f4")
    (tmp_path / "x.iq").write_bytes(x.tobytes())
    table = spark.createDataFrame([("c", str(tmp_path / "x.iq"), 24)], "capture_id string, path string, size_bytes long")
    for got in (ingest.iq_file_blocks(ingest.iq_file_plan(table, 2, 2), 2), ingest.iq_blocks(spark.createDataFrame([("c", bytearray(x.tobytes()))], "capture_id string, content binary"), block=2)):
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        rows = got.orderBy("start").collect()
        assert [r["n"] for r in rows] == [2, 1]
        assert np.array_equal(np.concatenate([np.array([r["i"], r["q"]], float).T for r in rows]), x.reshape(-1, 2), equal_nan=True)


def test_a_task_holds_one_small_file(spark, tmp_path):
    """40 MB in one task are packed into files of 16 MB, since what goes into a file is held until it is written."""
    def write(out, keys, contents):
        for key, content in zip(keys, contents):
            out.write(content)
            yield key, len(content)
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("key"), F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8").alias("content"))
    held = files.write_files(rows, str(tmp_path / "out"), ".bin", "id long, n long", write).groupBy("path").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in held) == 40 << 20 and max(r["n"] for r in held) <= 17 << 20


def test_members_are_handed_over_by_number_and_size(tmp_path, monkeypatch):
    """Small members share a batch, large ones do not gather, and a run of empty ones ends too."""
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for k in range(25):
            z.writestr(f"{k:02d}", b"" if k < 10 else b"1" if k < 20 else bytes(600))
    raw, read = (tmp_path / "x.zip").read_bytes(), {}

    class Rows:
        def __getattr__(self, name):
            return lambda *args: read.setdefault(name, args) and self
    monkeypatch.setattr(ingest, "n_tasks", lambda *_: 1)
    monkeypatch.setattr(ingest, "HELD_ROWS", 8)
    monkeypatch.setattr(ingest, "HELD_BYTES", 1000)
    ingest.zip_pieces(Rows())
    listed = [m | {"archive": str(tmp_path / "x.zip")} for m in ingest._directory("x", lambda n, at: raw[at:at + n], len(raw))]
    batches = list(read["mapInArrow"][0](iter([ingest.pa.RecordBatch.from_pylist(listed)])))
    assert [b.num_rows for b in batches] == [8, 8, 6, 2, 1] and sum(len(c) for b in batches for c in b.column("content").to_pylist()) == 10 + 5 * 600
