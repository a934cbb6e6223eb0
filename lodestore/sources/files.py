"""Small driver-side files through the Hadoop file system, so that any store Spark can reach will do."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lodestore.schema import Conflict, NotFound

#: Stores without an atomic move, but with a conditional write that their connector offers.
_OBJECT_STORES = {"s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss"}


class Files:
    """Storage for metadata: get, create if absent, numbered versions, list, delete. Data files are read and written by Spark.

    Nothing is ever overwritten. ``create`` is the one point of agreement between writers: a file comes into
    being whole and once. On a local disk that is a hard link, on object stores a write on condition that
    the object is absent (for connectors that know one; others check first, which two writers can both
    pass), and elsewhere a move that fails if its target is there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._scheme = self._fs.getUri().getScheme()

    def url(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.url(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def get(self, name: str) -> bytes:
        path = self._path(name)
        if not self._fs.exists(path):
            raise NotFound(name)
        stream = self._fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def get_range(self, name: str, start: int, length: int) -> bytes:
        return self.get(name)[start : start + length]

    @staticmethod
    def _fill(stream, data: bytes) -> None:
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """The whole file, or Conflict if there is one of that name."""
        path = self._path(name)
        if self._scheme in _OBJECT_STORES:
            try:
                builder = self._fs.createFile(path).overwrite(False).recursive()
                self._fill(builder.opt("fs.option.create.conditional.overwrite", "true").build(), data)
            except Py4JJavaError as e:
                if self._fs.exists(path):
                    raise Conflict(name) from e
                raise
            return
        beside = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        self._fill(self._fs.create(beside, False), data)
        try:
            if self._scheme == "file":
                local = lambda p: self._fs.makeQualified(p).toUri().getPath()
                os.link(local(beside), local(path))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(beside, path, options)
                beside = None
        except (FileExistsError, Py4JJavaError) as e:
            if self._fs.exists(path):
                raise Conflict(name) from e
            raise
        finally:
            if beside is not None:
                self._fs.delete(beside, False)

    def list(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path) if not s.getPath().getName().startswith((".", "_")))

    def delete(self, name: str) -> bool:
        """True if something was there."""
        return self._fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        path = self._path(name)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    # Numbered versions of one value: a reader sees the old one or the new one, never none.

    def versions(self, folder: str) -> list[int]:
        return [int(n[:-5]) for n in self.list(folder) if n.endswith(".json") and n[:-5].isdigit()]

    def newest(self, folder: str) -> tuple[int, dict | None]:
        """The number and value of the newest version; (0, None) if there is none."""
        while True:
            n = max(self.versions(folder), default=0)
            try:
                return n, self.get_json(f"{folder}/{n:020d}.json") if n else None
            except NotFound:  # let go while it was looked up: there is a newer one
                continue

    def advance(self, folder: str, after: int, value: dict, keep: int | None = None) -> None:
        """The version after ``after``, or Conflict if another writer made it; of older ones all but ``keep`` go."""
        self.create(f"{folder}/{after + 1:020d}.json", json.dumps(value, sort_keys=True).encode())
        if keep is not None:
            for n in self.versions(folder):
                if n <= after + 1 - keep:
                    self.delete(f"{folder}/{n:020d}.json")

    def get_json(self, name: str):
        return json.loads(self.get(name))
