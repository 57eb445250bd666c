"""Folders that all machines of a cluster share."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class SharedFolder:
    """A folder on any file system that Hadoop knows, as all machines see it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        """Names in the folder or one below it, in order; none if it is missing."""
        at = self._at(below)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def claim(self, name: str) -> bool:
        """Create an empty file; False if it exists.  Of several callers one succeeds."""
        if self._local:  # Hadoop's local file system looks first and creates then
            path = urlparse(self.path).path + "/" + name
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        if self.exists(name):
            return False
        try:
            self._fs.create(self._at(name), False).close()
        except Exception:  # noqa: BLE001 - someone else was faster, or the storage is away
            if not self.exists(name):
                raise
            return False
        return True
