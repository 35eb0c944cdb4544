"""Small files and listings through the Hadoop file system of a path (any store that
Spark reads; never the machine's own folders)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def local(self, path: str) -> str | None:
        """The folder that tasks open as ``path`` themselves; none in other stores."""
        p, fs = self._at(path)
        return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def make(self, path: str) -> bool:
        """A new folder; False when it is there already."""
        p, fs = self._at(path)
        return not fs.exists(p) and fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none when it does not exist."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def states(self, path: str) -> dict[str, tuple[int, int]]:
        """(length, time) by name of the data files of a table (a file or a folder)."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return {}
        out, found = {}, fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                out[s.getPath().toString()] = (s.getLen(), s.getModificationTime())
        return out

    def leaves(self, root: str, depth: int) -> list[str]:
        """Relative names of the folders ``depth`` levels below ``root``."""
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{n}".lstrip("/") for f in found for n in self.names(f"{root}/{f}".rstrip("/"))
                     if "=" in n]
        return found

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Make a whole file appear at ``path``; False when one is there already."""
        fs_package = self._jvm.org.apache.hadoop.fs
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.write(draft, text)
        if self.exists(path):
            self.delete(draft)
            return False
        none = self._gateway.new_array(fs_package.Options.Rename, 0)
        context = fs_package.FileContext.getFileContext(fs_package.Path(path).toUri(), self._conf)
        try:
            context.rename(fs_package.Path(draft), fs_package.Path(path), none)
        except Exception as e:  # py4j wraps the Java exception
            if not self.exists(path):
                raise
            self.delete(draft)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
