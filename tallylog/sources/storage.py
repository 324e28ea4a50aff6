"""Small files of a folder that several processes use, on the driver: local or mounted folders, and any Hadoop file system.

Paths without a scheme are resolved as Spark does, against the default file system, so the
driver's look at a folder and the executors' are the same.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark resolves it."""
    if "://" not in path and not path.startswith("file:") and not path.startswith("/"):
        path = os.path.abspath(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def mounted(spark: SparkSession, path: str) -> str | None:
    """The local path of a file or folder that Python can open, on driver and executors; None for other file systems."""
    whole = qualified(spark, path)
    return whole.removeprefix("file:").replace("//", "/", 1) if whole.startswith("file:") else None


def storage(spark: SparkSession, root: str) -> LocalFolder | HadoopFolder:
    own = mounted(spark, root)
    return LocalFolder(own) if own is not None else HadoopFolder(spark, qualified(spark, root))


class LocalFolder:
    """Files by name below a local or mounted folder."""

    def __init__(self, root: str):
        self.root, self.url = Path(root), f"file://{root}"
        self.root.mkdir(parents=True, exist_ok=True)

    def read(self, name: str) -> bytes | None:
        try:
            return (self.root / name).read_bytes()
        except FileNotFoundError:
            return None

    def create(self, name: str, data: bytes) -> bool:
        """Write a file that isn't there yet, whole or not at all; False if it is there."""
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        part.write_bytes(data)
        try:
            os.link(part, path)
        except FileExistsError:
            return False
        finally:
            part.unlink()
        return True

    def replace(self, name: str, data: bytes) -> None:
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        part.write_bytes(data)
        os.replace(part, path)

    def rename(self, name: str, other: str) -> bool:
        """Move a file away; False if another process was faster."""
        try:
            os.rename(self.root / name, self.root / other)
        except FileNotFoundError:
            return False
        return True

    def names(self, folder: str) -> list[str]:
        path = self.root / folder
        return sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) if path.exists() else []

    def delete(self, name: str) -> None:
        path = self.root / name
        if path.is_dir():
            shutil.rmtree(path, ignore_errors=True)
        else:
            path.unlink(missing_ok=True)

    def exists(self, name: str) -> bool:
        return (self.root / name).exists()


class HadoopFolder:
    """The same on a Hadoop file system, whose create without overwriting is its compare-and-swap."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.url = spark._jvm, root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.url}/{name}" if name else self.url)

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, name: str, data: bytes) -> None:
        stream = self.fs.create(self._path(name), False)
        try:
            stream.write(data)
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        part = f"{name}.{uuid.uuid4().hex}.part"
        self._write(part, data)
        # a rename without overwriting fails where the target is there
        try:
            self._move(part, name, "NONE")
        except Exception:
            self.delete(part)
            if not self.exists(name):
                raise
            return False
        return True

    def _move(self, name: str, other: str, how: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = getattr(kind, how)
        self.context.rename(self._path(name), self._path(other), options)

    def replace(self, name: str, data: bytes) -> None:
        part = f"{name}.{uuid.uuid4().hex}.part"
        self._write(part, data)
        self._move(part, name, "OVERWRITE")

    def rename(self, name: str, other: str) -> bool:
        try:
            self._move(name, other, "NONE")
        except Exception:
            if self.exists(name):
                raise
            return False
        return True

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(n for s in self.fs.listStatus(self._path(folder)) if not (n := s.getPath().getName()).startswith(".") and not n.endswith(".part"))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))


def head(spark: SparkSession, path: str, size: int) -> tuple[bytes, int, float]:
    """(the first ``size`` bytes, the length, the time of the last change in seconds) of a file anywhere."""
    own = mounted(spark, path)
    if own is not None:
        with open(own, "rb") as f:
            data, told = f.read(size), os.fstat(f.fileno())
        return data, told.st_size, told.st_mtime
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    told = fs.getFileStatus(where)
    stream = fs.open(where)
    try:
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, told.getLen())))
    finally:
        stream.close()
    return data, told.getLen(), told.getModificationTime() / 1000


def listed(spark: SparkSession, root: str, max_depth: int | None = None) -> list[str]:
    """Files below a folder of a file system that Python can't open, as Hadoop lists them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, base = [], len(root.rstrip("/"))
    each = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while each.hasNext():
        path = each.next().getPath().toString()
        if max_depth is None or path[base + 1 :].count("/") <= max_depth:
            found.append(path)
    return sorted(found)
