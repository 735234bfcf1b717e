"""Small files beside tables: markers and notes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Small files of the store's file system, written whole or not at all."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def read(self, path: str) -> str | None:
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> str:
        """Write unless the file is there; returns what it holds."""
        held = self.read(path)
        if held is not None:
            return held
        fs, where = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{where.getParent()}/_{where.getName()}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.rename(part, where)
        return self.read(path)

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
