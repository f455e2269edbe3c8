"""The folder all executors share, and the few file operations the driver does there."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULT_SHARED = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master, which is one machine, gets a default (tests), a
    cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return (found or DEFAULT_SHARED).rstrip("/")


class Files:
    """A store by a path in it, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def delete_at_exit(self, path: str) -> None:
        """When the driver's JVM ends."""
        self._fs.deleteOnExit(self._path(path))

    def create(self, path: str, text: str) -> bool:
        """A new file with this text; False, and nothing written, where there is one already."""
        if not self._fs.createNewFile(self._path(f"{path}.taken")):
            return False
        self.replace(path, text)
        return True

    def replace(self, path: str, text: str) -> None:
        """The file with this text: written beside it and moved over it, so that a reader sees the old or the new."""
        beside = self._path(f"{path}.{uuid.uuid4().hex}.new")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(beside, self._path(path)):
            self._fs.delete(self._path(path), False)
            if not self._fs.rename(beside, self._path(path)):
                raise OSError(f"can't put {path} in place")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/killgrid-{name}-{uuid.uuid4().hex}"
    Files(spark, path).delete_at_exit(path)
    return path
