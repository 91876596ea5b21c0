"""Small files and folders on the file system that driver and executors share: local paths, or any that Hadoop knows."""

from __future__ import annotations

import contextlib
import os
import shutil
import time

from pyspark.sql import SparkSession


def shared(spark: SparkSession, root: str) -> "Local | Hadoop":
    """Access by the scheme of ``root``: none or file: is local, anything else goes through Hadoop's FileSystem."""
    return Hadoop(spark, root) if "://" in root and not root.startswith("file:") else Local()


class Local:
    """The operating system's files; creation is exclusive and renaming atomic."""

    @staticmethod
    def _at(path: str) -> str:
        return "/" + path[5:].lstrip("/") if path.startswith("file:") else path

    def make(self, path: str) -> None:
        os.makedirs(self._at(path), exist_ok=True)

    def exists(self, path: str) -> bool:
        return os.path.exists(self._at(path))

    def read(self, path: str) -> str | None:
        with contextlib.suppress(FileNotFoundError), open(self._at(path)) as f:
            return f.read()
        return None

    def create(self, path: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            fd = os.open(self._at(path), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(fd, "w") as f:
            f.write(text)
        return True

    def move(self, a: str, b: str) -> bool:
        """Rename over what is there; False if there is nothing to rename."""
        try:
            os.replace(self._at(a), self._at(b))
        except FileNotFoundError:
            return False
        return True

    def age(self, path: str) -> float | None:
        with contextlib.suppress(FileNotFoundError):
            return time.time() - os.path.getmtime(self._at(path))
        return None

    def names(self, path: str) -> list[str]:
        with contextlib.suppress(FileNotFoundError):
            return sorted(os.listdir(self._at(path)))
        return []

    def delete(self, path: str) -> None:
        p = self._at(path)
        if os.path.isdir(p):
            shutil.rmtree(p, ignore_errors=True)
        else:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(p)


class Hadoop:
    """The same through Hadoop: HDFS and object stores, as far as these create and rename atomically."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        try:
            out = self.fs.create(self._path(path), False)
        except Exception as e:
            if self.exists(path):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def move(self, a: str, b: str) -> bool:
        if not self.exists(a):
            return False
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        over[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(b).toUri(), self.conf).rename(self._path(a), self._path(b), over)
        return True

    def age(self, path: str) -> float | None:
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000 if self.exists(path) else None

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
