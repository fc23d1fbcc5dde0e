"""Small files and folders on any Hadoop file system, through the session's own client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """False if the file is there already."""
        try:
            self._put(name, data, False)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True

    def replace(self, name: str, data: bytes) -> None:
        """Readers see the old bytes or the new ones."""
        new = f".{name}.{uuid.uuid4().hex}"
        self._put(new, data, True)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        context.rename(context.makeQualified(self._path(new)), context.makeQualified(self._path(name)), array)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        """Bytes of a file or of all that is in a folder."""
        return self._fs.getContentSummary(self._path(name)).getLength()

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self.exists(name) else []
