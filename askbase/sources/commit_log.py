"""Numbered manifests under a folder: one small JSON file per version.

A version is published by creating its file only if it is not there yet, so of
several writers that saw the same latest version one wins and the others are
told.  On HDFS-like stores that is a rename to a name that must be free; on a
file system that all machines mount it is a hard link.  (Stores without an atomic
rename need a single writer.)  Readers see a version whole or not at all.

The manifests are written by the driver and hold names of data folders, never
data.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self._fs = root.getFileSystem(self._conf)
        self.path = self._fs.makeQualified(root).toString()
        self._dir = self._path(f"{self.path}/_commits")

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _file(self, version: int) -> str:
        return f"{self.path}/_commits/{version:020d}.json"

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        if not self._fs.exists(self._dir):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._dir)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> tuple[int, dict | None]:
        """(version, manifest) of the newest version; (0, None) where nothing was published."""
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (0, None)

    def published(self, version: int) -> bool:
        return self._fs.exists(self._path(self._file(version)))

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
        finally:
            stream.close()

    def publish(self, version: int, manifest: dict) -> bool:
        """Create ``version``; False if another writer has created it."""
        self._fs.mkdirs(self._dir)
        draft = self._path(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode("utf-8")))
        finally:
            out.close()
        target = self._path(self._file(version))
        try:
            if self._fs.getScheme() != "file":
                return not self._fs.exists(target) and self._fs.rename(draft, target)
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        finally:
            self._fs.delete(draft, False)

    def data_folders(self) -> list[str]:
        """Names of the data folders on disk, published or not."""
        data = self._path(f"{self.path}/data")
        return [f.getPath().getName() for f in self._fs.listStatus(data)] if self._fs.exists(data) else []

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)
