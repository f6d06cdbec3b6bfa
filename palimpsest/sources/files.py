"""Small files on any Hadoop file system, through the JVM."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a driver that is its own executor may do without."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def close() -> None:
        with contextlib.suppress(Exception):
            Files(spark, path).delete("")

    atexit.register(close)
    return path


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.conf, self.base = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), base.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def create(self, name: str, data: bytes) -> None:
        """Writes a new file, whole or not at all; FileExistsError if there is one of that name.

        Two creators at one moment are told apart where rename refuses an existing target, as HDFS does."""
        if self.fs.exists(self._path(name)):
            raise FileExistsError(name)
        part = f"{name}.{self.jvm.java.util.UUID.randomUUID()}.part"
        out = self.fs.create(self._path(part), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not self.fs.rename(self._path(part), self._path(name)):
            self.fs.delete(self._path(part), False)
            raise FileExistsError(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder)) if not x.getPath().getName().endswith(".part"))

    def size(self, folder: str) -> int:
        """Bytes of all files in the folder."""
        return self.fs.getContentSummary(self._path(folder)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def mkdirs(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))
