"""Small files on whatever store a path names, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A directory; reading and listing are whole.

    Creation writes a draft and renames it, which is atomic where a rename is
    (HDFS, local disks).  On an object store without atomic renames two writers
    that commit the same name at the same moment must be kept apart by others.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Entries of the directory, sorted; none where it does not exist."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def folders(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isDirectory())

    def remove(self) -> None:
        """Delete the directory with all it holds."""
        self._fs.delete(self._at(""), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False where one of that name exists already."""
        if self._fs.exists(self._at(name)):
            return False
        draft = self._at(f".{name}.{self._jvm.java.util.UUID.randomUUID().toString()}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            return False
        return True


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, in a local session below a temporary folder. It goes with the session's JVM."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyrank-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return str(path.toString())
