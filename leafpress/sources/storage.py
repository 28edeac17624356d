"""Folders of any file system that Hadoop knows, seen from the driver: names and small files only."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(self._conf)
        #: With its scheme, as the default file system gives it to a path that has none.
        self.root = self.fs.makeQualified(path).toString()

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, without hidden ones; none if it doesn't exist."""
        found = (s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.exists(folder) else ()
        return sorted(n for n in found if not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, content: str) -> None:
        """A whole file or none: written under another name, then renamed."""
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/.{last}.tmp" if folder else f".{last}.tmp"
        stream = self.fs.create(self.at(hidden), True)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.at(hidden), self.at(name)):
            raise OSError(f"can't publish {name}")

    def set_time(self, name: str, millis: int) -> None:
        """Sets a file's time of change."""
        self.fs.setTimes(self.at(name), millis, -1)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)
