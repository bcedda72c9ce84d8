"""Files on any file system that pyarrow opens: listing by tasks, positioned reads, writers that commit through a manifest."""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

PIECE = 16 << 20


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path inside it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def open_input(path: str):
    """A file for positioned reads: ``read_at(nbytes, offset)`` and ``size()``."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


class Opened:
    """The file last asked for stays open: neighbouring plan rows name the same file."""

    def __init__(self):
        self.path, self.file = None, None

    def __call__(self, path: str):
        if path != self.path:
            self.close()
            self.file, self.path = open_input(path), path
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def n_tasks(df: DataFrame, tasks: int | None) -> int:
    """Tasks for rows that each stand for much reading: the session's shuffle partitions where none are given."""
    return tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def list_files(spark: SparkSession, roots: list[str], tasks: int | None = None) -> DataFrame:
    """(path, size, mtime) of all files below the folders, empty ones included; a root that does not exist is an error.

    One job a level: every folder is read by a task, and only the number of folders left reaches the driver.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                fs, inner = filesystem(path)
                head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                found = fs.get_file_info(pyarrow.fs.FileSelector(inner))
                if found:
                    yield pd.DataFrame([(head + i.path, i.type == pyarrow.fs.FileType.Directory, i.size or 0, str(i.mtime_ns)) for i in found],
                                       columns=["path", "folder", "size", "mtime"])

    todo, levels = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "path string"), []
    while True:
        level = cut_lineage(todo.repartition(n_tasks(todo, tasks), "path").mapInPandas(read, "path string, folder boolean, size long, mtime string"))
        levels.append(level.where(~F.col("folder")).select("path", "size", "mtime"))
        todo = level.where("folder").select("path")
        if todo.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def write_files(rows: DataFrame, folder: str, suffix: str, columns: str, write: Callable, max_bytes: int = 16 << 20) -> DataFrame:
    """Pack rows (key, content binary) into files of about ``max_bytes`` content, as much as a task holds; the returned manifest names those that count.

    ``write(stream, keys, contents)`` writes one file and yields one tuple of ``columns`` per key. The manifest is stored below
    the folder before it is returned. A task that is repeated writes under new names, which no manifest row carries.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = filesystem(folder)
        fs.create_dir(f"{inner}/data", recursive=True)

        def flush(keys: list, contents: list[bytes]) -> pd.DataFrame:
            name = f"data/{uuid.uuid4().hex}{suffix}"
            with fs.open_output_stream(f"{inner}/{name}", compression=None) as out:
                made = list(write(out, keys, contents))
            return pd.DataFrame([(f"{folder}/{name}", *m) for m in made], columns=["path", *names])

        keys, contents, size = [], [], 0
        for b in batches:
            for key, content in zip(b["key"], b["content"]):
                keys.append(key)
                contents.append(b"" if content is None else bytes(content))
                size += len(contents[-1])
                if size >= max_bytes:
                    yield flush(keys, contents)
                    keys, contents, size = [], [], 0
        if keys:
            yield flush(keys, contents)

    rows.select("key", "content").mapInPandas(pack, f"path string, {columns}").write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")
