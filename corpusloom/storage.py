"""Folders that the driver and all executors share, and the Hadoop file system under them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


class NoSharedFolder(RuntimeError):
    """spark.checkpoint.dir is unset on a cluster."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a checkpoint folder set by code; a temporary folder only where all runs in one process, an error on a cluster."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise NoSharedFolder("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(_LOCAL[sc.applicationId])
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Files:
    """Small files and folders by Hadoop's API: every path that Spark can read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; an error where there is one."""
        out = self.fs.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def move(self, name: str, to: str) -> bool:
        return self.fs.rename(self.path(name), self.path(to))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def stamp(self) -> str:
        """Sizes and times of what is under the root: another text where data were written anew."""
        out, todo = [], [self.path()]
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    out.append(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}")
        return "|".join(sorted(out))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
