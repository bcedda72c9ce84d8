"""Tables that appear all at once, under ids that are never reused, and are checked whenever they are read.

A publication writes its tables to a folder of its own and then one small manifest, ``manifests/<id>/<version>.json``, that
names the folder and states rows and content hashes. The manifest is written beside its place and renamed; the rename fails if
the version exists, so of two writers one wins and the other raises. A writer that dies before the rename leaves files that no
manifest names: readers go on seeing the version before, and the id can be published again. Versions are never changed or
removed; retirement is a further version.
"""
from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from .materialize import fingerprint


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S+00:00")


class Publication:
    """Published tables under one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -------------------------------------------------------------- manifests
    def _open(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def _folder(name: str) -> str:
        return f"{re.sub(r'[^A-Za-z0-9._-]', '_', name)[:60]}-{hashlib.sha256(name.encode()).hexdigest()[:16]}"

    def _names(self, path: str) -> list[str]:
        at, fs = self._open(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _manifest(self, folder: str, name: str) -> dict:
        at, fs = self._open(f"{self.root}/manifests/{folder}/{name}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> dict:
        """Write the manifest of a new version; FileAlreadyExistsException if another writer was first."""
        folder = f"{self.root}/manifests/{self._folder(entry['id'])}"
        beside, fs = self._open(f"{self.root}/staged/{uuid.uuid4().hex}.json")
        place, _ = self._open(f"{folder}/{entry['version']:012d}.json")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        fs.mkdirs(place.getParent())
        jvm = self.spark._jvm
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, place, no_overwrite)
        return entry

    def history(self, name: str) -> list[dict]:
        """All versions of an id, the oldest first."""
        folder = self._folder(name)
        return [self._manifest(folder, m) for m in self._names(f"{self.root}/manifests/{folder}") if m.endswith(".json")]

    def entry(self, name: str) -> dict | None:
        """The latest version of an id, which may be its retirement."""
        folder = self._folder(name)
        found = [m for m in self._names(f"{self.root}/manifests/{folder}") if m.endswith(".json")]
        return self._manifest(folder, found[-1]) if found else None

    def entries(self) -> list[dict]:
        """The latest version of every id: one manifest each is read."""
        latest = [(f, [m for m in self._names(f"{self.root}/manifests/{f}") if m.endswith(".json")]) for f in self._names(f"{self.root}/manifests")]
        return sorted((self._manifest(f, m[-1]) for f, m in latest if m), key=lambda e: e["id"])

    # -------------------------------------------------------------- tables
    def publish(self, name: str, tables: dict[str, DataFrame], info: dict | None = None, replace: bool = False, check: Callable[[dict[str, DataFrame]], None] | None = None) -> dict:
        """Write the tables and commit them as the next version of ``name``.

        The same content again is a no-op. Other content under a published id is an error unless ``replace``; a retired id is
        an error always. ``check`` is given the tables as written and raises where they must not appear.
        """
        known = self.entry(name)
        if known and known["retired"]:
            raise ValueError(f"{name} was retired; retired ids are never reused")
        version = known["version"] + 1 if known else 1
        folder = f"{self.root}/tables/{self._folder(name)}/{version:012d}-{uuid.uuid4().hex[:12]}"
        for table, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{table}")
        written = {t: self.spark.read.parquet(f"{folder}/{t}") for t in tables}
        at, fs = self._open(folder)
        if check:
            try:
                check(written)
            except Exception:
                fs.delete(at, True)
                raise
        content = {t: fingerprint({t: df})[t] for t, df in written.items()}     # of what was written, not of a second run
        if known and (known["content"] == content or not replace):
            fs.delete(at, True)                                         # what this call wrote and no manifest names
            if known["content"] == content:
                return known
            raise ValueError(f"{name} exists with other content; retire it or use a new id")
        return self._commit({"id": name, "version": version, "folder": folder.removeprefix(f"{self.root}/"), "content": content, "info": info or {}, "created": _now(), "retired": None, "reason": None})

    def retire(self, name: str, reason: str) -> dict:
        known = self.entry(name)
        if known is None or known["retired"]:
            raise KeyError(name)
        return self._commit(known | {"version": known["version"] + 1, "retired": _now(), "reason": reason})

    def path(self, entry: dict, table: str) -> str:
        return f"{self.root}/{entry['folder']}/{table}"

    def read(self, name: str, table: str, verify: bool = True) -> DataFrame:
        """A table of the latest version. ``verify`` reads it once more to compare its content with the manifest; KeyError for an
        unknown or retired id, ValueError for changed content."""
        known = self.entry(name)
        if known is None or known["retired"] or table not in known["content"]:
            raise KeyError(name)
        stored = self.spark.read.parquet(self.path(known, table))
        if verify and fingerprint({table: stored})[table] != known["content"][table]:
            raise ValueError(f"{name}: {table} no longer matches its manifest")
        return stored
