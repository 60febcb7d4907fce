"""Small files on any file system that Spark knows."""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from ..errors import Conflict


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        where = urlparse(self._fs.makeQualified(self._path(self.root)).toString())
        self.local = where.path if where.scheme == "file" else None

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, folder: str) -> list[str]:
        if self.local is not None:
            try:
                return sorted(n for n in os.listdir(f"{self.local}/{folder}") if not n.startswith("."))
            except FileNotFoundError:
                return []
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(folder))) if not s.getPath().getName().startswith("."))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(self.at(name))).getLength()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self._fs.getFileStatus(self._path(self.at(name))).getModificationTime() / 1000

    def free(self) -> tuple[int, int]:
        """Bytes left and bytes in all of the file system."""
        s = self._fs.getStatus(self._path(self.root))
        return s.getRemaining(), s.getCapacity()

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(f"{self.local}/{name}", encoding="utf-8", errors="replace", newline="") as f:
                return f.read()
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not be there yet; of several writers one wins."""
        if self.local is not None:
            path = f"{self.local}/{name}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, path)
            except FileExistsError as e:
                raise Conflict(f"{name} was published by another writer") from e
            finally:
                os.unlink(draft)
            return
        try:
            out = self._fs.create(self._path(self.at(name)), False)
        except Exception as e:
            if self.exists(name):
                raise Conflict(f"{name} was published by another writer") from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def remove(self, name: str) -> None:
        if self.local is not None and os.path.isfile(f"{self.local}/{name}"):
            os.unlink(f"{self.local}/{name}")
            return
        self._fs.delete(self._path(self.at(name)), True)
