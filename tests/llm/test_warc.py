"""WARC archives: round trips, choice of responses, rolled files, damage."""
import base64
import glob
import gzip
import hashlib
import os

import pytest

from sigspark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, revisits boolean, n long"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(k, f"http://h/{k}", h, "d", True, 5) for k, h in enumerate(["<p>a", "<p>b", "<p>a", "", None, "<p>a", "x" * 200_000, "é" * 3, "line\r\n\r\nWARC/1.1\r\n"])] + [
    (None, None, "<p>a", None, None, None), (None, "u", "only null", None, None, None), (None, "u", "only null", None, None, None), (50, "bad\r\nurl: x", "<p>c", "", None, 0), (50, "", "<p>c", "", None, 0), (50, "v", "<p>d", "", None, 0)]


def expected(rows, least):
    out, groups = [], {}
    for page, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(page)
    for html, pages in groups.items():
        pages.sort(key=lambda p: (p is not None, p or 0))
        for k, page in enumerate(pages):
            lone = k == len(pages) - 1 or len(html.encode()) < least
            out.append((page, len(html.encode()), b32(html), "response" if lone else "revisit", None if lone else pages[-1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, file_bytes, shard_bytes", [(0, 1 << 20, 1 << 20), (4, 1, 1 << 20), (5, 900, 200)])
def test_round_trip(spark, tmp_path, least, file_bytes, shard_bytes):
    manifest = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "w"), least, file_bytes, shard_bytes)
    found = warc.read_warc(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(ROWS, least)
    assert all(hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest) for r in found if r.record_type == "response")
    files = sorted(glob.glob(str(tmp_path / "w" / "*.warc.gz")))
    assert files == sorted(r.file for r in manifest.collect()) and not glob.glob(str(tmp_path / "w" / "*.part"))
    assert sum(gzip.decompress(open(f, "rb").read()).count(b"WARC-Type: re") for f in files) == len(ROWS)
    if file_bytes == 1:
        assert len(files) == len(ROWS)


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    pages, seen = spark.createDataFrame(ROWS, SCHEMA), []
    for k in (1, 7):
        folder = str(tmp_path / str(k))
        warc.write_warc(pages.repartition(k), folder, file_bytes=2000)
        seen.append({os.path.basename(f): open(f, "rb").read() for f in glob.glob(folder + "/*.warc.gz")})
    assert seen[0] == seen[1]


def test_damage_and_foreign_files(spark, tmp_path):
    folder = str(tmp_path / "w")
    manifest = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), folder)
    with open(folder + "/part-000099-0000.warc.gz", "wb") as left_over:
        left_over.write(b"of a lost task")
    assert warc.read_warc(manifest).count() == len(ROWS)
    with pytest.raises(ValueError):
        warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), folder)
    file = manifest.first().file
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 1
    with open(file, "wb") as out:
        out.write(data)
    with pytest.raises(Exception, match="not the file that the manifest lists"):
        warc.read_warc(manifest).count()


def test_records_are_checked():
    import io
    good = warc.record(1, "u", b"abc", 0, None)
    (member,) = warc.members(io.BytesIO(good))
    assert warc.parsed(member)[1].endswith(b"\r\n\r\nabc")
    with pytest.raises(ValueError):
        warc.parsed(member.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-9])))
    two = list(warc.members(io.BytesIO(good + warc.record(2, None, b"", 0, (7, 0)))))
    assert len(two) == 2 and warc.parsed(two[1])[0]["X-Page-Refers-To"] == "7"


def test_empty_table(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_warc(manifest).count() == 0
