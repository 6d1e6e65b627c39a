"""Whole files by path or URI: through Arrow in tasks, through Hadoop's file systems (which Spark itself writes to) on the driver."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import SparkSession


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path. Local paths are taken as they are: blanks, % and # have no meaning in them."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def absolute(path: str) -> str:
    """Relative local paths from the driver's working folder, which neither tasks nor the JVM need share."""
    return path if "://" in path or path.startswith(("file:", "/")) else os.path.abspath(path)


class DriverFiles:
    """The few calls that the driver makes on files of a run."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        """Names in the folder, in order; none if there is no such folder."""
        p, system = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []

    def changed(self, path: str) -> float:
        """Seconds since the epoch."""
        p, system = self._at(path)
        return system.getFileStatus(p).getModificationTime() / 1000

    def exists(self, path: str) -> bool:
        p, system = self._at(path)
        return system.exists(p)

    def read(self, path: str) -> bytes:
        p, system = self._at(path)
        stream = system.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create_new(self, path: str, data: bytes) -> bool:
        """Whether the file could be made: of several writers of one path one alone can, and nobody sees half a file."""
        part, system = self._at(f"{path}.{uuid.uuid4().hex}.part")
        stream = system.create(part)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf).rename(part, self._at(path)[0], options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        finally:
            system.delete(part, False)
        return True

    def delete(self, path: str) -> None:
        p, system = self._at(path)
        system.delete(p, True)
